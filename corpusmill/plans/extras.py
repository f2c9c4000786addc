"""Queries of keywords, hooks, corpus-level metrics, per-query limits and event-time windows (X12, X27, H01-H10, G05, R10, R13, P05, P06, P14, Z04, and extensions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.operators import evaluation as E
from corpusmill.operators import hooks as H
from corpusmill.operators import keywords as K
from corpusmill.operators import retrieval as R
from corpusmill.plans.common import table
from corpusmill.plans.conversations import PAIRS, pairs
from corpusmill.plans.evaluation import _GEN, _overlap_sql, bleu_sql, generated
from corpusmill.plans.retrieval import DENSE, vectors

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register a query and its twin."""
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


SPLIT = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@query("keywords_tf_idf", f"""WITH d AS (SELECT doc_id, {SPLIT} AS w FROM documents), t AS (SELECT doc_id, any_value(size) AS size, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM d) GROUP BY doc_id, word),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word), s AS (SELECT doc_id, word, round(tf / size * ln(((SELECT count(*) FROM d) + 1) / (df + 1)), 9) AS score FROM t JOIN f USING (word))
SELECT doc_id, word, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, word)::BIGINT AS rank FROM s) WHERE rank <= 3""")
def tf_idf(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return K.tf_idf(d, "doc_id", "w", 3).select("doc_id", "word", F.col("rank").cast("long").alias("rank"))


@query("keywords_text_rank")
def text_rank(spark, sf_dir):
    d = table(spark, sf_dir, "benchmark").select("item_id", tokens(F.lower("text")).alias("w"))
    return K.text_rank(d, "item_id", "w", 5)


@query("hook_annotator", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'long' ELSE 'short' END AS label, (length(text) % 10)::DOUBLE AS safety FROM documents")
def annotator(spark, sf_dir):
    def annotate(rows):
        return [{"label": "long" if len(r["text"]) > 1000 else "short", "safety": float(len(r["text"]) % 10)} for r in rows]

    return H.call(table(spark, sf_dir, "documents", "doc_id", "text"), annotate, "label string, safety double", workers=4).drop("text")


@query("hook_tokenizer", f"SELECT doc_id, len({SPLIT})::BIGINT AS n FROM documents")
def own_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(H.tokenizer(str.split)(F.col("text"))).cast("long").alias("n"))


@query("sentiment_neutral", "SELECT doc_id, 0.5::DOUBLE AS positive, 0.5::DOUBLE AS negative FROM documents")
def sentiment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in H.neutral_sentiment().items()])


@query("bleu_corpus", f"WITH gen AS ({_GEN}), h AS (SELECT sum(len(g)) AS lg, sum(len(t)) AS lt, sum(len(g)) AS n1, sum(greatest(len(g) - 1, 0)) AS n2 FROM gen), a AS (SELECT sum(hit) AS h1 FROM {_overlap_sql(1)}), b AS (SELECT sum(hit) AS h2 FROM {_overlap_sql(2)}) SELECT round(CASE WHEN lg > lt THEN 1 ELSE exp(1 - lt / lg) END * exp((ln(h1 / n1) + ln(h2 / n2)) / 2), 6) AS bleu FROM h, a, b")
def corpus_bleu(spark, sf_dir):
    return E.corpus_bleu(generated(spark, sf_dir), "id", "g", "t", 2).withColumnRenamed("bleu_2", "bleu")


@query("rouge_characters", f"""WITH gen AS (SELECT id, list_filter(string_split(array_to_string(g, ''), ''), lambda x: x <> '') AS g, list_filter(string_split(array_to_string(t, ''), ''), lambda x: x <> '') AS t FROM ({_GEN}))
SELECT gen.id, round(CASE WHEN coalesce(hit, 0) > 0 THEN 2 * hit / (len(g) + len(t)) ELSE 0 END, 6) AS rouge_1 FROM gen LEFT JOIN {_overlap_sql(1)} o ON o.id = gen.id""")
def char_rouge(spark, sf_dir):
    chars = lambda c: F.filter(F.split(F.array_join(c, ""), ""), lambda x: x != "")
    return E.rouge(generated(spark, sf_dir).select("id", chars("g").alias("g"), chars("t").alias("t")), "id", "g", "t", 1)


@query("dense_k_of_each_query", f"SELECT qid, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id)::BIGINT AS rank FROM ({DENSE})) WHERE rank <= qid // 100 % 4 + 1")
def own_k(spark, sf_dir):
    d, q = vectors(spark, sf_dir)
    return R.nearest(d, q, 4).where(F.col("rank") <= F.floor(F.col("qid") / 100) % 4 + 1).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"))


KS = (1, 3, 5, 10)


def answers_and_hits(spark, sf_dir):
    """Turns as answers to the turns before; the ten nearest rows of each hundredth one, relevant if of its label."""
    d, q = vectors(spark, sf_dir)
    near = R.nearest(d, q, 10).join(q.select("qid", "qlabel"), "qid").join(d.select("doc_id", "label"), "doc_id")
    return generated(spark, sf_dir), near.select("qid", "rank", (F.col("label") == F.col("qlabel")).cast("int").alias("label"))


def _rag_sql() -> str:
    mean = lambda n: f"(SELECT avg(CASE WHEN hit > 0 THEN hit / ng ELSE 0 END) AS rouge_{n}_p, avg(CASE WHEN hit > 0 THEN hit / nt ELSE 0 END) AS rouge_{n}_r, avg(CASE WHEN hit > 0 THEN 2 * hit / (ng + nt) ELSE 0 END) AS rouge_{n}_f FROM (SELECT gen.id, coalesce(hit, 0) AS hit, greatest(len(g) - {n - 1}, 0) AS ng, greatest(len(t) - {n - 1}, 0) AS nt FROM gen LEFT JOIN {_overlap_sql(n)} o ON o.id = gen.id))"
    at = ", ".join(f"avg(h{k} / {k}) AS p_{k}, avg(CASE WHEN n > 0 THEN h{k} / n ELSE 0 END) AS r_{k}, avg(CASE WHEN b{k} > 0 THEN d{k} / b{k} ELSE 0 END) AS ndcg_{k}" for k in KS)
    of = ", ".join(f"sum(label) FILTER (WHERE rank <= {k}) AS h{k}, sum(label / log2(rank + 1)) FILTER (WHERE rank <= {k}) AS d{k}, sum(label / log2(ideal + 1)) FILTER (WHERE ideal <= {k}) AS b{k}" for k in KS)
    parts = [f"(SELECT {', '.join(f'avg(bleu_{n}) AS bleu_{n}' for n in (1, 2, 3, 4))} FROM ({bleu_sql(_GEN)}))", mean(1), mean(2), f"(SELECT {at} FROM (SELECT qid, sum(label) AS n, {of} FROM i GROUP BY qid))"]
    names = [[f"bleu_{n}" for n in (1, 2, 3, 4)], *[[f"rouge_{n}_{x}" for x in "prf"] for n in (1, 2)], [f"{x}_{k}" for k in KS for x in ("p", "r", "ndcg")]]
    rows = " UNION ALL ".join(f"SELECT '{c}' AS metric, round({c}, 6) AS value FROM {part}" for part, cs in zip(parts, names, strict=True) for c in cs)
    return f"""WITH gen AS ({_GEN}),
h AS (SELECT h.qid, h.rank, (a.label = b.label)::INT AS label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id) AS rank FROM ({DENSE})) h JOIN embeddings a ON a.vec_id = h.qid JOIN embeddings b ON b.vec_id = h.doc_id WHERE rank <= 10),
i AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY label DESC, rank) AS ideal FROM h) {rows}"""


@query("rag_evaluation", _rag_sql())
def rag(spark, sf_dir):
    texts, hits = answers_and_hits(spark, sf_dir)
    return E.rag_bundle(texts, hits, longest=False)


@query("rag_evaluation_longest")
def rag_longest(spark, sf_dir):
    """The whole bundle, longest common subsequences besides."""
    return E.rag_bundle(*answers_and_hits(spark, sf_dir))


@query("preference_render", f"SELECT conv_id, turn, md5('<|im_start|>user' || chr(10) || q || '<|im_end|>' || chr(10)) AS prompt, md5(a || '<|im_end|>') AS chosen FROM ({PAIRS})")
def render(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", F.md5(F.concat(F.lit("<|im_start|>user\n"), "q", F.lit("<|im_end|>\n")).cast("binary")).alias("prompt"), F.md5(F.concat("a", F.lit("<|im_end|>")).cast("binary")).alias("chosen"))


@query("window_tumbling", "SELECT event_type, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.unix_timestamp("w.start").alias("start"), "n")


@query("window_sessions", "SELECT user_id, count(*)::BIGINT AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts >= p + INTERVAL 30 MINUTE GROUP BY user_id")
def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))
