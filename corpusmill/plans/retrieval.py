"""Queries of retrieval, preference pairs and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.operators import evaluation as E
from corpusmill.operators import inverted as I
from corpusmill.operators import lexical as L
from corpusmill.operators import packing as K
from corpusmill.operators import preference as P
from corpusmill.operators import retrieval as R
from corpusmill.plans.common import table
from corpusmill.storage import cut

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register a query and its twin."""
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')"
DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"


@query("vector_normalise", f"SELECT vec_id, round(sqrt({DOT.format('embedding', 'embedding')}), 5) AS norm, round((embedding[1] / sqrt({DOT.format('embedding', 'embedding')}))::DOUBLE, 5) AS first FROM embeddings")
def normalise(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return v.select("vec_id", F.round(F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), F.round(F.get(R.unit(F.col("embedding")), 0), 5).alias("first"))


def vectors(spark, sf_dir):
    """Vectors as documents, and those whose id is divisible by 100 as queries."""
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return v, v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("vector"), F.col("label").alias("qlabel"))


DENSE = f"SELECT q.vec_id AS qid, d.vec_id AS doc_id, {DOT.format('d.embedding', 'q.embedding')} AS dense FROM embeddings q JOIN embeddings d ON q.vec_id % 100 = 0"
TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id)::BIGINT AS rank FROM ({DENSE})) WHERE rank <= 5"


@query("dense_top_k", f"SELECT qid, doc_id, rank, round(dense, 4) AS dense FROM ({TOP})")
def dense_top(spark, sf_dir):
    d, q = vectors(spark, sf_dir)
    return R.nearest(d, q, 5).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("dense", 4).alias("dense"))


@query("ivf_top_k", f"SELECT qid, doc_id, rank, round(dense, 4) AS dense FROM ({TOP})")
def ivf(spark, sf_dir):
    """Exact: the lists that a query does not probe at first are read where their bound asks for it."""
    d, q = vectors(spark, sf_dir)
    return I.search(spark, I.build(d, nlist=707), q, 5, 8, exact=True).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("dense", 4).alias("dense"))


@query("ivf_probed")
def ivf_probed(spark, sf_dir):
    """As many lists as rows of the table need for 95 of 100 true neighbours."""
    d, q = vectors(spark, sf_dir)
    index = I.build(d, nlist=707)
    return I.search(spark, index, q, 5, I.calibrate(spark, index, d, 5)).select("qid", "doc_id", "rank")


@query("score_normalised", f"SELECT qid, doc_id, round((dense - min(dense) OVER w) / CASE WHEN max(dense) OVER w > min(dense) OVER w THEN max(dense) OVER w - min(dense) OVER w ELSE 1 END, 6) AS norm FROM ({TOP}) WINDOW w AS (PARTITION BY qid)")
def norm(spark, sf_dir):
    d, q = vectors(spark, sf_dir)
    return R.normalised(R.nearest(d, q, 5), "dense", "norm").select("qid", "doc_id", F.round("norm", 6).alias("norm"))


@query("retrieval_metrics", f"""WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id) AS rank FROM ({DENSE})) WHERE rank <= 10),
rel AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id % 100 = 0),
n AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY qid),
m AS (SELECT h.qid, rank, r.doc_id IS NOT NULL AS hit, n_rel FROM h LEFT JOIN rel r ON r.qid = h.qid AND r.doc_id = h.doc_id JOIN n ON n.qid = h.qid),
g AS (SELECT qid, {", ".join(f"count(*) FILTER (WHERE hit AND rank <= {k}) / {k} AS p{k}, count(*) FILTER (WHERE hit AND rank <= {k}) / any_value(n_rel) AS r{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE hit AND rank <= {k}), 0) / list_sum(list_transform(range(1, least({k}, any_value(n_rel)) + 1), lambda i: 1 / log2(i + 1))) AS g{k}" for k in (1, 3, 5, 10))} FROM m GROUP BY qid)
SELECT {", ".join(f"round(avg(p{k}), 6) AS precision_{k}, round(avg(r{k}), 6) AS recall_{k}, round(avg(g{k}), 6) AS ndcg_{k}" for k in (1, 3, 5, 10))} FROM g""")
def metrics(spark, sf_dir):
    d, q = vectors(spark, sf_dir)
    rel = q.join(d.select("doc_id", "label"), q["qlabel"] == d["label"]).select("qid", "doc_id", F.lit(1).alias("rel"))
    return E.retrieval_metrics(R.nearest(d, q, 10).select("qid", "doc_id", "rank"), rel)


@query("corpus_statistics", f"SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def corpus(spark, sf_dir):
    postings, _, _ = R.lexical_index(table(spark, sf_dir, "documents"))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


BM25 = f"""SELECT qid, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM
(SELECT term, doc_id, any_value(dl) AS dl, count(*) AS tf, count(*) OVER (PARTITION BY term) AS df FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)) GROUP BY term, doc_id) p
JOIN (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({WORDS.format('query')}) AS term FROM {{queries}}) GROUP BY ALL) q USING (term)
CROSS JOIN (SELECT count(*) AS n, avg(len({WORDS.format('text')})) AS avgdl FROM documents) GROUP BY qid, doc_id"""
ITEMS = "(SELECT item_id AS qid, text AS query FROM benchmark)"


@query("bm25_top_k", f"SELECT qid, doc_id, rank, bm25 FROM (SELECT qid, doc_id, round(bm25, 3) AS bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, doc_id)::BIGINT AS rank FROM ({BM25.replace('{queries}', ITEMS)})) WHERE rank <= 10")
def lexical(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    s = R.bm25(table(spark, sf_dir, "documents"), q).withColumn("rounded", F.round("bm25", 6))
    return R.top(s, 10, "rounded").select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("bm25", 3).alias("bm25"))


EVERY_HUNDREDTH = "(SELECT doc_id AS qid, text AS query FROM documents WHERE doc_id % 100 = 0)"


@query("lexical_index_top_k", f"SELECT qid, doc_id, rank, bm25 FROM (SELECT qid, doc_id, round(bm25, 3) AS bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 6) DESC, doc_id)::BIGINT AS rank FROM ({BM25.replace('{queries}', EVERY_HUNDREDTH)})) WHERE rank <= 10")
def indexed(spark, sf_dir):
    """Whole documents as queries, against an index of all."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    found = L.search(L.build(d), d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("text").alias("query")), 10)
    return L.best(found, 10).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("bm25", 3).alias("bm25"))


def knowledge(spark, sf_dir):
    """Documents with vectors, and as queries those whose id is divisible by 100: a vector, a hypothetical one (of the next query, or its own if there is none) and the whole text."""
    v = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents", "doc_id", "text").join(v.select(F.col("vec_id").alias("doc_id"), R.unit(F.col("embedding")).alias("embedding")), "doc_id")
    q = d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("vector"), F.col("text").alias("query"))
    h = q.select((F.col("qid") - 100).alias("qid"), F.col("vector").alias("hypothetical"))
    return d, q.join(h, "qid", "left").withColumn("hypothetical", F.coalesce("hypothetical", "vector"))


@query("hybrid_search")
def hybrid(spark, sf_dir):
    d, q = knowledge(spark, sf_dir)
    return R.hybrid(d, q, 5, F.substring("text", 1, 30))


@query("hyde_search")
def hyde(spark, sf_dir):
    d, q = knowledge(spark, sf_dir)
    return R.hyde(d, q, 5, F.substring("text", 1, 30))


KB = f"SELECT d.doc_id, d.text, list_transform(v.embedding, lambda x: x::DOUBLE) AS e, sqrt({DOT.format('v.embedding', 'v.embedding')}) AS n FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id"


@query("hybrid_candidates", f"""WITH kb AS ({KB}), q AS (SELECT doc_id AS qid, e, n, text AS query FROM kb WHERE doc_id % 100 = 0),
s AS (SELECT qid, k.doc_id, {DOT.format('k.e', 'q.e')} / (k.n * q.n) AS dense FROM q CROSS JOIN kb k),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id) AS r FROM s) WHERE r <= 15)
SELECT qid, count(*)::BIGINT AS n, round(min(dense), 5) AS low, round(max(dense), 5) AS high FROM t GROUP BY qid""")
def candidates(spark, sf_dir):
    d, q = knowledge(spark, sf_dir)
    return R.nearest(d, q, 15).groupBy("qid").agg(F.count("*").alias("n"), F.round(F.min("dense"), 5).alias("low"), F.round(F.max("dense"), 5).alias("high"))


_KB_BM25 = BM25.replace("{queries}", "(SELECT doc_id AS qid, text AS query FROM kb WHERE doc_id % 100 = 0)").replace("FROM documents", "FROM kb")


@query("relevance_gate", f"""WITH kb AS ({KB}), q AS (SELECT doc_id AS qid, e, n FROM kb WHERE doc_id % 100 = 0),
s AS (SELECT qid, k.doc_id, {DOT.format('k.e', 'q.e')} / (k.n * q.n) AS dense FROM q CROSS JOIN kb k),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id) AS r FROM s) WHERE r <= 15),
b AS (SELECT qid, doc_id, bm25 / max(bm25) OVER (PARTITION BY qid) AS lex FROM ({_KB_BM25}))
SELECT t.qid, t.doc_id FROM t LEFT JOIN b ON b.qid = t.qid AND b.doc_id = t.doc_id WHERE NOT (dense < {R.GATE} AND coalesce(lex, 0) < {R.WEAK_LEXICAL})""")
def gate(spark, sf_dir):
    """Dense hits that the gate lets pass, lexical scores as shares of the query's best."""
    d, q = knowledge(spark, sf_dir)
    near = cut(R.nearest(d, q, 15), "near")
    found = L.search(L.build(d), q.join(near.groupBy("qid").agg(F.collect_list("doc_id").alias("near")), "qid"), 1, wanted="near")
    most = L.best(found, 1).select("qid", F.col("bm25").alias("most"))
    lex = found.where("wanted").join(most, "qid").select("qid", "doc_id", (F.col("bm25") / F.col("most")).alias("lex"))
    x = near.join(lex, ["qid", "doc_id"], "left").na.fill(0.0, ["lex"])
    return x.where(R.passes(F.col("dense"), F.col("lex"))).select("qid", "doc_id")


@query("corpus_lookup", f"SELECT h.qid, h.doc_id, d.text[:50] AS title FROM ({TOP}) h JOIN documents d ON d.doc_id = h.doc_id")
def lookup(spark, sf_dir):
    d, q = vectors(spark, sf_dir)
    return R.nearest(d, q, 5).join(table(spark, sf_dir, "documents", "doc_id", F.substring("text", 1, 50).alias("title")), "doc_id").select("qid", "doc_id", "title")


#: Candidates from line items, one question for each order.
CANDIDATES = "SELECT l_orderkey AS question, l_linenumber * 1000000 + l_partkey AS ord, l_quantity / 4 AS quality, round(l_discount * 100) / 2 AS hallucination, round(l_tax * 100) / 2 AS overreach, 5 + (l_partkey % 11) * 0.5 AS readability FROM lineitem"


def pair_candidates(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("question"), (c("l_linenumber") * 1000000 + c("l_partkey")).alias("ord"), (c("l_quantity") / 4).alias("quality"), (F.round(c("l_discount") * 100) / 2).alias("hallucination"), (F.round(c("l_tax") * 100) / 2).alias("overreach"), (5 + (c("l_partkey") % 11) * F.lit(0.5)).alias("readability"))


@query("candidate_scores", f"SELECT question, ord, round(0.4 * quality + 0.2 * readability - 0.2 * hallucination - 0.2 * overreach, 6) AS overall FROM ({CANDIDATES})")
def scores(spark, sf_dir):
    return pair_candidates(spark, sf_dir).select("question", "ord", F.round(P.overall(F.col("quality"), F.col("readability"), F.col("hallucination"), F.col("overreach")), 6).alias("overall"))


PAIRS = f"""WITH c AS ({CANDIDATES}), x AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY quality DESC, ord) AS r, count(*) OVER (PARTITION BY question) AS n FROM c),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY hallucination + overreach, r) AS z FROM x WHERE n > 1 AND r <= 3 AND quality >= 7 AND hallucination <= 3 AND overreach <= 3 AND readability >= 7) WHERE z = 1),
y AS (SELECT x.question, g.ord AS chosen, x.ord AS rejected, g.quality - x.quality AS gap, g.hallucination + g.overreach AS cs, x.hallucination + x.overreach AS rs,
  CASE WHEN g.quality - x.quality < 2 THEN -1000 ELSE g.quality - x.quality + 0.8 * x.hallucination + 0.8 * x.overreach - 0.3 * abs(x.readability - 6) END AS s
  FROM x JOIN g ON g.question = x.question AND (x.quality, x.hallucination, x.overreach, x.readability) <> (g.quality, g.hallucination, g.overreach, g.readability) WHERE x.readability BETWEEN 5 AND 7),
b AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY s DESC, rejected) AS z FROM y WHERE s > 0)
SELECT question, chosen, rejected, round(gap, 6) AS gap FROM b WHERE z = 1 AND gap >= 2 AND (cs < rs OR gap >= 4)"""


@query("preference_pairs", PAIRS)
def pairs(spark, sf_dir):
    return P.select_pairs(pair_candidates(spark, sf_dir), "question", "ord").withColumn("gap", F.round("gap", 6))


@query("preference_statistics", f"SELECT count(*)::BIGINT AS pairs, round(avg(gap), 6) AS mean_gap, round(count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS success FROM ({PAIRS})")
def pair_stats(spark, sf_dir):
    p = pairs(spark, sf_dir).agg(F.count("*").alias("pairs"), F.round(F.avg("gap"), 6).alias("mean_gap"))
    n = table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("n"))
    return p.join(F.broadcast(n)).select("pairs", "mean_gap", F.round(F.col("pairs") / F.col("n"), 6).alias("success"))


@query("strategy_fan_out", "SELECT item_id, s AS strategy FROM benchmark, (VALUES ('plain'), ('careful'), ('brief')) t(s)")
def fan_out(spark, sf_dir):
    return table(spark, sf_dir, "benchmark", "item_id").select("item_id", F.explode(F.array(*[F.lit(s) for s in ("plain", "careful", "brief")])).alias("strategy"))


SPLIT = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@query("sequence_truncate", f"SELECT doc_id, md5(array_to_string({SPLIT}[:64], ' ')) AS out, least(len({SPLIT}), 64)::BIGINT AS n FROM documents WHERE len({SPLIT}) >= 4")
def truncate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t")).where("size(t) >= 4").select("doc_id", K.truncated(F.col("t"), 64).alias("t"))
    return d.select("doc_id", F.md5(F.array_join("t", " ").cast("binary")).alias("out"), F.size("t").cast("long").alias("n"))


@query("sequence_pack", f"""WITH t AS (SELECT doc_id, unnest(list_append({SPLIT}, '</s>')) AS w, unnest(range(len({SPLIT}) + 1)) AS i FROM documents), p AS (SELECT w, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM t)
SELECT (p // 512)::BIGINT AS chunk, md5(string_agg(w, ' ' ORDER BY p)) AS out FROM p GROUP BY chunk HAVING count(*) = 512""")
def packed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return K.pack(d, "doc_id", "t", 512, "</s>").select("chunk", F.md5(F.array_join("tokens", " ").cast("binary")).alias("out"))


@query("batch_padding", "SELECT doc_id, batch, longest, n, (longest - n)::BIGINT AS ignored FROM (SELECT doc_id, doc_id // 8 AS batch, length(text)::BIGINT AS n, max(length(text)) OVER (PARTITION BY doc_id // 8)::BIGINT AS longest FROM documents)")
def padding(spark, sf_dir):
    from pyspark.sql import Window as W

    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), F.when(F.length("text") > 0, F.sequence(F.lit(1), F.length("text"))).otherwise(F.array().cast("array<int>")).alias("ids")).withColumn("longest", F.max(F.size("ids")).over(W.partitionBy("batch")))
    x = d.withColumn("p", K.padded(F.col("ids"), F.col("longest"), 0))
    return x.select("doc_id", "batch", F.size("p.ids").cast("long").alias("longest"), F.aggregate("p.mask", F.lit(0), lambda a, m: a + m).cast("long").alias("n"), F.size(F.filter("p.labels", lambda y: y == K.IGNORED)).cast("long").alias("ignored"))


@query("running_offsets", "SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents")
def offsets(spark, sf_dir):
    return K.running_total(table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")), "doc_id", "n").select("doc_id", "before")
