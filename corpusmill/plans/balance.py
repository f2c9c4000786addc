"""Queries of sampling, balancing, splitting and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import balance as B
from corpusmill.operators import dedup as D
from corpusmill.plans.common import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register a query and its twin."""
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def docs(spark, sf_dir):
    """Documents without texts."""
    return table(spark, sf_dir, "documents", "doc_id", "lang", "source")


RANKED = "SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS f, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS total FROM documents"
SMART = "CASE WHEN target IS NULL THEN 1 WHEN n >= target THEN (h <= target)::INT ELSE target // n + (h <= target % n)::INT END"
UNDER = "CASE WHEN target IS NULL THEN 1 WHEN n > target THEN (h <= target)::INT ELSE 1 END"
OVER = "CASE WHEN target IS NULL THEN 1 WHEN n >= target THEN (f <= target)::INT ELSE target // n + (h <= target % n)::INT END"


def balanced(copies: str, target: str) -> str:
    """The twin of ``resample``."""
    return f"SELECT doc_id, lang, unnest(range(c))::BIGINT AS copy FROM (SELECT *, {copies} AS c FROM (SELECT *, {target} AS target FROM ({RANKED})))"


def out(df):
    """The columns that are compared."""
    return df.select("doc_id", "lang", F.col("copy").cast("long").alias("copy"))


COUNTS = {"en": 100, "de": 300, "xx": 5}
TARGET = "CASE lang WHEN 'en' THEN 100 WHEN 'de' THEN 300 END"
for _s, _c in (("smart", SMART), ("oversample", OVER), ("undersample", UNDER)):
    QUERIES[f"balance_counts_{_s}"] = (lambda s: lambda spark, sf_dir: out(B.balance(docs(spark, sf_dir), "lang", "doc_id", "counts", target_counts=COUNTS, strategy=s)))(_s)
    ORACLES[f"balance_counts_{_s}"] = balanced(_c, TARGET)
QUERIES["balance_ratios"] = lambda spark, sf_dir: out(B.balance(docs(spark, sf_dir), "lang", "doc_id", "ratios", target_ratios={"en": 0.5, "de": 0.25, "fr": 0.25}))
ORACLES["balance_ratios"] = balanced(SMART, "CASE lang WHEN 'en' THEN trunc(total * 0.5::DOUBLE)::BIGINT WHEN 'de' THEN trunc(total * 0.25::DOUBLE)::BIGINT WHEN 'fr' THEN trunc(total * 0.25::DOUBLE)::BIGINT END")
QUERIES["balance_uniform"] = lambda spark, sf_dir: out(B.balance(docs(spark, sf_dir), "lang", "doc_id", "uniform"))
ORACLES["balance_uniform"] = balanced(SMART, "min(n) OVER ()")
QUERIES["balance_min"] = lambda spark, sf_dir: out(B.balance(docs(spark, sf_dir), "lang", "doc_id", "min", min_samples=250))
ORACLES["balance_min"] = balanced(SMART, "greatest(n, 250)")
QUERIES["balance_max"] = lambda spark, sf_dir: out(B.balance(docs(spark, sf_dir), "lang", "doc_id", "max", max_samples=120))
ORACLES["balance_max"] = balanced(UNDER, "least(n, 120)")


@query("balance_draws", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS f, count(*) OVER (PARTITION BY lang) AS n FROM documents), t AS (SELECT DISTINCT lang, n, max(n) OVER () * 2 AS target FROM r),
p AS (SELECT lang, ('0x' || substr(md5('42|' || lang || '|' || i), 1, 15))::BIGINT % n + 1 AS pick FROM (SELECT lang, n, unnest(range(target - n)) AS i FROM t)), c AS (SELECT lang, pick, count(*) AS k FROM p GROUP BY ALL)
SELECT doc_id, r.lang, unnest(range(1 + coalesce(k, 0)))::BIGINT AS copy FROM r LEFT JOIN c ON c.lang = r.lang AND c.pick = r.f""")
def draws(spark, sf_dir):
    """All languages brought to twice the largest by draws with replacement."""
    d = docs(spark, sf_dir)
    sizes = B.class_sizes(d, "lang")
    targets = sizes.join(F.broadcast(sizes.agg((2 * F.max("n")).alias("target")))).select("lang", "target")  # one row
    return out(B.resample(d, "lang", "doc_id", targets, "draw"))


@query("balance_statistics", f"SELECT lang, any_value(n)::BIGINT AS original, any_value(target)::BIGINT AS target, sum(c)::BIGINT AS final FROM (SELECT *, {SMART} AS c FROM (SELECT *, least(n, 120) AS target FROM ({RANKED}))) GROUP BY lang")
def statistics(spark, sf_dir):
    d = docs(spark, sf_dir)
    sizes = B.class_sizes(d, "lang")
    final = B.balance(d, "lang", "doc_id", "max", max_samples=120).groupBy("lang").agg(F.count("*").alias("final"))
    return sizes.join(final, "lang", "left").select("lang", F.col("n").alias("original"), F.least("n", F.lit(120)).cast("long").alias("target"), F.coalesce("final", F.lit(0)).alias("final"))


@query("sample_seeded", "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def sampled(spark, sf_dir):
    return B.sample(table(spark, sf_dir, "documents", "doc_id"), 50, "doc_id")


@query("split_random", "SELECT doc_id, CASE WHEN p <= n - r THEN 'train' WHEN p <= n - ceil(r / 2) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, ceil(n * 0.2) AS r FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS p, count(*) OVER () AS n FROM documents))")
def split(spark, sf_dir):
    return B.random_split(table(spark, sf_dir, "documents", "doc_id"), "doc_id").select("doc_id", "split")


@query("split_stratified", "SELECT conv_id, k, CASE WHEN p <= t THEN 'train' WHEN p <= t + v THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, greatest(1, n * 85 // 100) AS t, CASE WHEN n > 2 THEN greatest(1, n * 10 // 100) ELSE 0 END AS v FROM (SELECT conv_id, k, row_number() OVER (PARTITION BY k ORDER BY md5('42|' || conv_id), conv_id) AS p, count(*) OVER (PARTITION BY k) AS n FROM (SELECT conv_id, count(*)::BIGINT AS k FROM conversations GROUP BY conv_id)))")
def stratified(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("k"))
    return B.stratified_split(c, "k", "conv_id")


@query("hold_out", "SELECT doc_id, p > n - ceil(n * 0.1) AS held_out FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS p, count(*) OVER () AS n FROM documents)")
def held(spark, sf_dir):
    return B.hold_out(table(spark, sf_dir, "documents", "doc_id"), "doc_id").select("doc_id", "held_out")


@query("shortest_first_pool", "SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY length(text), conv_id, turn LIMIT 30")
def shortest(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").orderBy(F.length("text"), "conv_id", "turn").limit(3 * 10).select("conv_id", "turn")


@query("first_successes", "SELECT doc_id FROM documents WHERE length(text) >= 2000 ORDER BY doc_id LIMIT 25")
def successes(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.length("text") >= 2000).orderBy("doc_id").limit(25).select("doc_id")


@query("shuffle_candidates", "SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id)::BIGINT AS place FROM documents")
def shuffled(spark, sf_dir):
    return B.place(table(spark, sf_dir, "documents", "doc_id"), None, B.hash_order("doc_id", 7), "doc_id").select("doc_id", "place")


@query("construction_input", "SELECT conv_id, turn, q FROM (SELECT conv_id, turn, trim(text) AS q, row_number() OVER (PARTITION BY trim(text) ORDER BY conv_id, turn) AS r FROM conversations WHERE role = 'user' AND trim(text) <> '') WHERE r = 1 ORDER BY conv_id, turn LIMIT 40 OFFSET 10")
def construction(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("q")).where("q <> ''")
    return D.keep_first(c, ["q"], ["conv_id", "turn"]).orderBy("conv_id", "turn").offset(10).limit(40)


for _name, _expr, _sql in (("raw", lambda c: c, "text"), ("strip", F.trim, "trim(text)"), ("fold", lambda c: F.lower(F.trim(c)), "lower(trim(text))")):
    QUERIES[f"keep_first_{_name}"] = (lambda e: lambda spark, sf_dir: D.keep_first(table(spark, sf_dir, "documents", "doc_id", "text").withColumn("k", F.md5(e(F.col("text")).cast("binary"))), ["k"], ["doc_id"]).select("doc_id"))(_expr)
    ORACLES[f"keep_first_{_name}"] = f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_sql}"


@query("dedup_by_id", "SELECT arg_min(doc_id, doc_id) AS doc_id, source FROM documents GROUP BY source")
def by_id(spark, sf_dir):
    return D.keep_first(docs(spark, sf_dir), ["source"], ["doc_id"]).select("doc_id", "source")


@query("dedup_statistics", "SELECT count(*)::BIGINT AS total, count(DISTINCT text)::BIGINT AS kept, (count(*) - count(DISTINCT text))::BIGINT AS duplicates, round(100.0 * (count(*) - count(DISTINCT text)) / count(*), 6) AS rate FROM documents")
def dedup_stats(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("kept"))
    return n.select("total", "kept", (F.col("total") - F.col("kept")).alias("duplicates"), F.round(100 * (F.col("total") - F.col("kept")) / F.col("total"), 6).alias("rate"))


@query("union_keep_first", "SELECT q, arg_min(src, (src, conv_id, turn)) AS src FROM (SELECT lower(trim(text)) AS q, 1 AS src, conv_id, turn FROM conversations WHERE role = 'user' UNION ALL SELECT lower(trim(text)), 2, conv_id, turn FROM conversations) WHERE q <> '' GROUP BY q")
def union_first(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("q", F.lower(F.trim("text")))
    both = c.where("role = 'user'").withColumn("src", F.lit(1)).unionByName(c.withColumn("src", F.lit(2))).where("q <> ''")
    return D.keep_first(both, ["q"], ["src", "conv_id", "turn"]).select("q", "src")


@query("union_all", "SELECT lang, count(*)::BIGINT AS n FROM (SELECT lang FROM documents UNION ALL SELECT lang FROM documents WHERE doc_id % 2 = 0) GROUP BY lang")
def union_all(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.unionByName(d.where("doc_id % 2 = 0")).groupBy("lang").agg(F.count("*").alias("n"))


@query("difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def difference(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_anti")


@query("anti_join_used_questions", "SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id < 40 AND t.role = 'user' AND trim(t.text) = trim(c.text))")
def unused(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("q", F.trim("text"))
    return c.join(c.where("conv_id < 40").select("q"), "q", "left_anti").select("conv_id", "turn")


@query("used_index_filter", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def unused_index(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id")
    return d.join(d.where("doc_id % 3 = 0"), "doc_id", "left_anti")


@query("positional_zip", "SELECT d.doc_id, e.label FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) d JOIN (SELECT label, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings) e USING (r)")
def zipped(spark, sf_dir):
    d = B.ranked(table(spark, sf_dir, "documents", "doc_id"), None, "doc_id", "r")
    e = B.ranked(table(spark, sf_dir, "embeddings", "vec_id", "label"), None, "vec_id", "r")
    return d.join(e, "r").select("doc_id", "label")


@query("set_sizes", "SELECT conv_id, len(list_distinct(u))::BIGINT AS n_distinct, len(list_intersect(u, a))::BIGINT AS n_both, len(list_distinct(list_concat(u, a)))::BIGINT AS n_either FROM (SELECT conv_id, flatten(list(string_split(text, ' ')) FILTER (WHERE role = 'user')) AS u, flatten(list(string_split(text, ' ')) FILTER (WHERE role = 'assistant')) AS a FROM conversations GROUP BY conv_id) WHERE u IS NOT NULL AND a IS NOT NULL")
def set_sizes(spark, sf_dir):
    w = lambda r: F.flatten(F.collect_list(F.when(F.col("role") == r, F.split("text", " "))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(w("user").alias("u"), w("assistant").alias("a"), F.count_if(F.col("role") == "assistant").alias("k"), F.count_if(F.col("role") == "user").alias("m")).where("k > 0 AND m > 0")
    return c.select("conv_id", F.size(F.array_distinct("u")).cast("long").alias("n_distinct"), F.size(F.array_intersect("u", "a")).cast("long").alias("n_both"), F.size(F.array_union("u", "a")).cast("long").alias("n_either"))


@query("ordered_distinct", "SELECT conv_id, array_to_string(list(role ORDER BY f), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def ordered_distinct(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["role"])), ",").alias("roles"))


@query("head_cap", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def head(spark, sf_dir):
    return docs(spark, sf_dir).where("lang = 'en'").orderBy("doc_id").limit(100).select("doc_id")


@query("grouped_report", "SELECT event_type, week, n, mean, round(100.0 * n / sum(n) OVER (PARTITION BY event_type), 6) AS percent FROM (SELECT event_type, date_trunc('week', ts)::DATE::VARCHAR AS week, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2)")
def report(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type", F.to_date(F.date_trunc("week", "ts")).cast("string").alias("week")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("event_type")), 6))
