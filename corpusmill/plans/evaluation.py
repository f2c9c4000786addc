"""Queries of gates, summaries, grades and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.operators import conversation as C
from corpusmill.operators import evaluation as E
from corpusmill.operators import quantiles as Q
from corpusmill.operators import retrieval as R
from corpusmill.plans.common import table
from corpusmill.plans.conversations import ORACLES as CONV
from corpusmill.plans.conversations import EPISODES, call_counts, episodes, reasons

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register a query and its twin."""
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


#: Five scores of 0 to 10 for labelled documents; the others are not annotated.
SCORES = {"safety": "(doc_id * 7 + 3) % 11", "relevance": "(doc_id * 5 + 8) % 11", "authenticity": "(doc_id * 3 + 6) % 11", "uncertainty": "(doc_id * 2 + 1) % 11", "helpfulness": "(doc_id * 4 + 9) % 11"}
ANNOTATED = "SELECT d.doc_id, d.lang, d.source, l.doc_id IS NOT NULL AS annotated, l.quality, l.toxic, " + ", ".join(f"CASE WHEN l.doc_id IS NOT NULL THEN (({e.replace('doc_id', 'd.doc_id')}) * 1.0)::DOUBLE END AS {k}" for k, e in SCORES.items()) + " FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def annotated(spark, sf_dir):
    """Documents with the annotations of the labelled ones."""
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels").withColumn("annotated", F.lit(True))
    x = d.join(lab, "doc_id", "left").withColumn("annotated", F.coalesce("annotated", F.lit(False)))
    return x.withColumns({k: F.when(F.col("annotated"), F.expr(e).cast("double")) for k, e in SCORES.items()})


def gate():
    """The gate over the five columns."""
    return E.score_gate(*[F.col(k) for k in SCORES])


GATED = f"""SELECT *, CASE WHEN NOT annotated THEN 'no_scores' WHEN safety < 6 THEN 'safety' WHEN relevance < 7 THEN 'relevance' WHEN authenticity < 6 THEN 'authenticity' WHEN uncertainty > 7 THEN 'uncertainty'
 WHEN helpfulness < 6 THEN 'helpfulness' WHEN (safety + relevance + authenticity + 10 - uncertainty + helpfulness) / 5 < 6.5 THEN 'overall' END AS reason, (safety + relevance + authenticity + 10 - uncertainty + helpfulness) / 5 AS overall FROM ({ANNOTATED})"""


@query("annotation_join", f"SELECT doc_id, annotated, safety FROM ({ANNOTATED})")
def joined(spark, sf_dir):
    return annotated(spark, sf_dir).select("doc_id", "annotated", "safety")


@query("score_gate", f"SELECT doc_id, reason IS NULL AS passed, overall, reason FROM ({GATED})")
def gated(spark, sf_dir):
    return annotated(spark, sf_dir).select("doc_id", gate().alias("g")).select("doc_id", "g.passed", "g.overall", "g.reason")


@query("quality_gate_annotated_only", f"SELECT doc_id FROM ({GATED}) WHERE NOT annotated OR reason IS NULL")
def gate_annotated(spark, sf_dir):
    return annotated(spark, sf_dir).withColumn("g", gate()).where("NOT annotated OR g.passed").select("doc_id")


@query("filter_report", f"SELECT coalesce(reason, 'passed') AS outcome, count(*)::BIGINT AS n, round(coalesce(avg(overall), 0), 6) AS overall FROM ({GATED}) GROUP BY 1")
def filter_report(spark, sf_dir):
    return annotated(spark, sf_dir).withColumn("g", gate()).groupBy(F.coalesce("g.reason", F.lit("passed")).alias("outcome")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("g.overall"), F.lit(0.0)), 6).alias("overall"))


STATS = "SELECT metric, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round({std}(value), 6) AS std, min(value) AS min, max(value) AS max, round(median(value), 6) AS median FROM ({rows}) GROUP BY metric"
ROWS = " UNION ALL ".join(f"SELECT '{k}' AS metric, {k} AS value FROM a WHERE {k} IS NOT NULL" for k in SCORES)


@query("score_statistics", f"WITH a AS ({ANNOTATED}) " + STATS.format(std="stddev_pop", rows=ROWS))
def score_stats(spark, sf_dir):
    return E.statistics(annotated(spark, sf_dir), *SCORES)


@query("judge_statistics", f"WITH a AS ({ANNOTATED}) " + STATS.format(std="stddev_samp", rows=ROWS))
def judge_stats(spark, sf_dir):
    return E.statistics(annotated(spark, sf_dir), *SCORES, sample=True)


@query("judge_safety_rates", "SELECT count(*)::BIGINT AS total, count(quality)::BIGINT AS valid, round(avg(toxic), 6) AS overreach_rate, round(avg((quality = 0)::INT), 6) AS hallucination_rate FROM (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)")
def judge_rates(spark, sf_dir):
    valid = F.col("quality").isNotNull()
    return annotated(spark, sf_dir).agg(F.count("*").alias("total"), F.count("quality").alias("valid"), E.rate(F.col("toxic") == 1, valid).alias("overreach_rate"), E.rate(F.col("quality") == 0, valid).alias("hallucination_rate"))


@query("label_distribution", "SELECT lang AS label, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang")
def label_distribution(spark, sf_dir):
    return E.distribution(table(spark, sf_dir, "documents"), "lang")


@query("label_distribution_default", "SELECT label, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'other' ELSE l.quality::VARCHAR END AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY label")
def default_distribution(spark, sf_dir):
    return E.distribution(annotated(spark, sf_dir).withColumn("q", F.col("quality").cast("string")), "q")


@query("tool_call_distribution", f"SELECT n, count(*)::BIGINT AS conversations, n = 0 AS direct, n = 1 AS single FROM ({CONV['tool_call_count']}) GROUP BY n")
def tool_distribution(spark, sf_dir):
    return call_counts(spark, sf_dir).groupBy("n").agg(F.count("*").alias("conversations")).select("n", "conversations", (F.col("n") == 0).alias("direct"), (F.col("n") == 1).alias("single"))


@query("qa_evaluation_report", """SELECT count(*)::BIGINT AS total, count(l.doc_id)::BIGINT AS evaluated, count(*) FILTER (WHERE quality = 1 AND toxic = 0)::BIGINT AS passed, count(*) FILTER (WHERE toxic = 1)::BIGINT AS overreach, count(*) FILTER (WHERE quality = 0)::BIGINT AS hallucination,
 round(100.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 0) / nullif(count(l.doc_id), 0), 6) AS pass_rate, round(100.0 * count(*) FILTER (WHERE toxic = 1) / nullif(count(l.doc_id), 0), 6) AS overreach_rate FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def qa_report(spark, sf_dir):
    ok, seen = (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("annotated")
    return annotated(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(seen).alias("evaluated"), F.count_if(ok).alias("passed"), F.count_if(F.col("toxic") == 1).alias("overreach"), F.count_if(F.col("quality") == 0).alias("hallucination"),
                                        E.rate(ok, seen, 100.0).alias("pass_rate"), E.rate(F.col("toxic") == 1, seen, 100.0).alias("overreach_rate"))


@query("problem_samples", "SELECT doc_id, kind, question FROM (SELECT d.doc_id, unnest(list_filter([CASE WHEN toxic = 1 THEN 'overreach' END, CASE WHEN quality = 0 THEN 'hallucination' END], lambda x: x IS NOT NULL)) AS kind, CASE WHEN length(text) > 100 THEN text[:100] || '...' ELSE text END AS question FROM documents d JOIN labels l ON l.doc_id = d.doc_id)")
def problems(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    kinds = F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("overreach")), F.when(F.col("quality") == 0, F.lit("hallucination"))))
    return d.select("doc_id", F.explode(kinds).alias("kind"), F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text")).alias("question"))


@query("evaluation_outputs", "SELECT doc_id, true AS in_all, coalesce(quality = 1 AND toxic = 0, false) AS in_passed, coalesce(NOT (quality = 1 AND toxic = 0), false) AS in_problem FROM (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)")
def outputs(spark, sf_dir):
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return annotated(spark, sf_dir).select("doc_id", F.lit(True).alias("in_all"), F.coalesce(ok, F.lit(False)).alias("in_passed"), F.coalesce(~ok, F.lit(False)).alias("in_problem"))


@query("model_grade", f"SELECT round(avg(overall), 6) AS score, CASE WHEN avg(overall) >= 4.5 THEN 'EXCELLENT' WHEN avg(overall) >= 3.5 THEN 'GOOD' WHEN avg(overall) >= 2.5 THEN 'ACCEPTABLE' ELSE 'POOR' END AS level, count(*) FILTER (WHERE p)::BIGINT AS n_passed, CASE WHEN bool_and(p) THEN any_value(lv) ELSE 'FAIL' END AS overall FROM (SELECT (SELECT avg(overall) / 2 FROM ({GATED})) AS overall, unnest([(SELECT avg(toxic) FROM labels) <= 0.1, (SELECT avg((quality = 0)::INT) FROM labels) <= 0.1]) AS p, 'x' AS lv)")
def model_grade(spark, sf_dir):
    a = annotated(spark, sf_dir).withColumn("g", gate()).agg((F.avg("g.overall") / 2).alias("score"), F.avg("toxic").alias("overreach"), F.avg((F.col("quality") == 0).cast("int")).alias("hallucination"))
    g = E.grade(a, [("overreach", "overreach", "<=", 0.1), ("hallucination", "hallucination", "<=", 0.1)], "score")
    return a.select(F.round("score", 6).alias("score")).join(F.broadcast(g.select("level", F.size(F.filter("checks", lambda c: c["passed"])).cast("long").alias("n_passed"), "overall")))


JUDGED = "SELECT toxic = 1 AS overreach, quality = 0 AS hallucination, toxic = 1 AND quality = 0 AS red_flag_omission, toxic = 1 AND quality = 1 AS prescription, 1 + 4 * quality AS score FROM labels"


def judged(spark, sf_dir):
    """Labels as judgements: four flags and a score from 1 to 5."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return table(spark, sf_dir, "labels").select(toxic.alias("overreach"), (~good).alias("hallucination"), (toxic & ~good).alias("red_flag_omission"), (toxic & good).alias("prescription"), (1 + 4 * F.col("quality")).alias("score"))


@query("model_grade_checks")
def model_checks(spark, sf_dir):
    """All six checks: perplexity of line items, ROUGE-L of turns, safety of labels."""
    ppl = table(spark, sf_dir, "lineitem").agg(F.avg(F.exp(F.col("l_discount") * 20)).alias("perplexity"))
    rouge = E.rouge_parts(E.longest_common(generated(spark, sf_dir), "id", "g", "t"), "l").select(F.nullif("l_f", F.lit(0.0)).alias("rouge_l"))  # 0 is no value
    values = E.safety_summary(judged(spark, sf_dir)).join(F.broadcast(ppl)).join(F.broadcast(rouge))  # one row each
    return E.graded(values, E.MODEL_CHECKS)


_CHECK_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS name, {c}::DOUBLE AS value, {b}::DOUBLE AS bound, {c} {op} {b} AS passed FROM v" for n, c, op, b in E.AGENT_CHECKS)


@query("agent_grade_checks", f"""WITH e AS (SELECT user_id, day, bool_and(event_type <> 'error') AND bool_or(event_type = 'purchase') AS ok, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS n FROM ({EPISODES}) GROUP BY ALL),
v AS (SELECT * FROM (SELECT avg(ok::INT) AS format_rate, avg((n > 4)::INT) AS excessive_rate FROM e), (SELECT avg(overreach::INT) AS overreach, avg(hallucination::INT) AS hallucination, avg(red_flag_omission::INT) AS red_flag_omission, avg(prescription::INT) AS prescription, avg(score) AS score FROM ({JUDGED}))),
c AS ({_CHECK_ROWS})
SELECT name, round(value, 6) AS value, bound, passed, NULL::VARCHAR AS grade FROM c UNION ALL
SELECT 'overall', round(score, 6), NULL, (SELECT bool_and(passed) FROM c), CASE WHEN NOT (SELECT bool_and(passed) FROM c) THEN 'FAIL' WHEN score >= 4.5 THEN 'EXCELLENT' WHEN score >= 3.5 THEN 'GOOD' WHEN score >= 2.5 THEN 'ACCEPTABLE' ELSE 'POOR' END FROM v""")
def agent_checks(spark, sf_dir):
    """All six checks: format and searches of the episodes of events, safety of labels."""
    n = F.size(F.filter("turns", lambda t: t["tool"].isNotNull()))
    e = episodes(spark, sf_dir).select(C.format_check(F.col("turns")).alias("f"), C.tool_check(F.col("turns"), n).alias("t"))
    rates = e.agg(F.avg(F.col("f.compliant").cast("int")).alias("format_rate"), F.avg(F.col("t.excessive").cast("int")).alias("excessive_rate"))
    return E.graded(E.safety_summary(judged(spark, sf_dir)).join(F.broadcast(rates)), E.AGENT_CHECKS)  # one row each


@query("agent_grade", "SELECT round(f, 6) AS format_rate, round(x, 6) AS excess_rate, CASE WHEN f >= 0.85 AND x <= 0.15 THEN 'PASS' ELSE 'FAIL' END AS overall FROM (SELECT avg((event_type <> 'error')::INT) AS f, avg((value > 50)::INT) AS x FROM events)")
def agent_grade(spark, sf_dir):
    a = table(spark, sf_dir, "events").agg(F.avg((F.col("event_type") != "error").cast("int")).alias("f"), F.avg((F.col("value") > 50).cast("int")).alias("x"))
    g = E.grade(a, [("format", "f", ">=", 0.85), ("excess", "x", "<=", 0.15)])
    return a.select(F.round("f", 6).alias("format_rate"), F.round("x", 6).alias("excess_rate")).join(F.broadcast(g.select("overall")))


#: A loss table from line items: loss from the discount, tokens from the quantity.
LOSS = "SELECT l_orderkey, l_linenumber, l_discount * 20 AS loss, l_quantity AS n FROM lineitem"


@query("perplexity_summary", f"SELECT round(avg(exp(loss)), 6) AS mean, round(median(exp(loss)), 6) AS median, round(stddev_pop(exp(loss)), 5) AS std, round(min(exp(loss)), 6) AS min, round(max(exp(loss)), 6) AS max, round(exp(sum(loss * n) / sum(n)), 6) AS weighted, round(exp(least(avg(loss), 20)), 6) AS batch FROM ({LOSS})")
def perplexity(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 20).alias("loss"), F.col("l_quantity").alias("n"))
    p, r = F.exp("loss"), lambda c, d=6: F.round(c, d)
    middle = Q.quantiles(x.select(F.lit(1).alias("all"), p.alias("p")), "all", "p", [0.5]).select(r(F.col("quantile")).alias("median"))
    return x.agg(r(F.avg(p)).alias("mean"), r(F.stddev_pop(p), 5).alias("std"), r(F.min(p)).alias("min"), r(F.max(p)).alias("max"), r(F.exp(F.sum(F.col("loss") * F.col("n")) / F.sum("n"))).alias("weighted"), r(F.exp(F.least(F.avg("loss"), F.lit(20.0)))).alias("batch")).join(F.broadcast(middle))  # one row each


PRICES = [0.01, 0.25, 0.5, 0.75, 0.99]


@query("quantiles_by_group", "SELECT l_returnflag AS flag, share, round(quantile, 4) AS quantile FROM (SELECT l_returnflag, unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS share, unnest(quantile_cont(l_extendedprice::DOUBLE, [0.01, 0.25, 0.5, 0.75, 0.99])) AS quantile FROM lineitem GROUP BY l_returnflag)")
def price_quantiles(spark, sf_dir):
    return Q.quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", PRICES).select(F.col("l_returnflag").alias("flag"), "share", F.round("quantile", 4).alias("quantile"))


#: Predictions: the label's guess is wrong where the vector's id ends in 7.
GUESS = "SELECT vec_id, label, CASE WHEN vec_id % 10 = 7 THEN (label + 1) % 10 ELSE label END AS guess FROM embeddings"


def guesses(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "label").withColumn("guess", F.when(F.col("vec_id") % 10 == 7, (F.col("label") + 1) % 10).otherwise(F.col("label")))


@query("accuracy", f"SELECT round(avg((label = guess)::INT), 6) AS accuracy, round(count(*) FILTER (WHERE label = guess AND label <> 3) / count(*) FILTER (WHERE label <> 3), 6) AS masked FROM ({GUESS})")
def accuracy(spark, sf_dir):
    same = F.col("label") == F.col("guess")
    return guesses(spark, sf_dir).agg(E.rate(same).alias("accuracy"), E.rate(same, F.col("label") != 3).alias("masked"))


@query("precision_recall_f1", f"""WITH x AS ({GUESS}), c AS (SELECT label AS c, count(*) AS t, count(*) FILTER (WHERE label = guess) AS tp FROM x GROUP BY 1), g AS (SELECT guess AS c, count(*) AS g FROM x GROUP BY 1),
m AS (SELECT t, CASE WHEN coalesce(g, 0) > 0 THEN tp / g ELSE 0 END AS p, tp / t AS r FROM c LEFT JOIN g USING (c))
SELECT round(sum(p * t) / sum(t), 6) AS precision, round(sum(r * t) / sum(t), 6) AS recall, round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * t) / sum(t), 6) AS f1 FROM m""")
def prf(spark, sf_dir):
    return E.precision_recall_f1(guesses(spark, sf_dir), "label", "guess")


@query("reward_metrics", "SELECT round(avg((l_quantity > l_linenumber * 10)::INT), 6) AS accuracy, round(avg(l_quantity - l_linenumber * 10), 6) AS margin, round(avg(l_tax - l_discount), 6) AS kl, round(stddev_samp(l_quantity), 6) AS std FROM lineitem")
def rewards(spark, sf_dir):
    a, b = F.col("l_quantity"), F.col("l_linenumber") * 10
    return table(spark, sf_dir, "lineitem").agg(E.rate(a > b).alias("accuracy"), F.round(F.avg(a - b), 6).alias("margin"), F.round(F.avg(F.col("l_tax") - F.col("l_discount")), 6).alias("kl"), F.round(F.stddev_samp(a), 6).alias("std"))


@query("repair_counters", f"SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS valid, count(reason)::BIGINT AS invalid FROM ({CONV['conversation_invalid_reason']})")
def counters(spark, sf_dir):
    return reasons(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count("reason").alias("invalid"))


@query("supplement_plan", """WITH d AS (SELECT count(*) AS total, count(*) FILTER (WHERE n = 2) AS direct, count(*) FILTER (WHERE n = 4) AS single FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)),
n AS (SELECT *, greatest(0, (110 * 0.22)::DOUBLE::INT - direct) AS a, greatest(0, trunc(110 * 0.13)::INT - single) AS b FROM (SELECT total, direct, single FROM d)),
s AS (SELECT *, 110 - total - a - b AS rest, (110 - total) / greatest(a + b, 1) AS scale FROM (SELECT total, greatest(0, trunc(110 * 0.22)::INT - direct) AS a, greatest(0, trunc(110 * 0.13)::INT - single) AS b FROM d))
SELECT CASE WHEN rest < 0 THEN trunc(a * scale) ELSE a END::BIGINT AS raw_direct, CASE WHEN rest < 0 THEN trunc(b * scale) ELSE b END::BIGINT AS raw_single, greatest(0, CASE WHEN rest < 0 THEN trunc(a * scale) ELSE a END)::BIGINT AS direct_answer, greatest(0, CASE WHEN rest < 0 THEN trunc(b * scale) ELSE b END)::BIGINT AS single_search FROM s""")
def plan(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return supplement(n.agg(F.count("*").alias("total"), F.count_if(F.col("n") == 2).alias("direct"), F.count_if(F.col("n") == 4).alias("single")), 110)


def supplement(counts, target: int, direct: float = 0.22, single: float = 0.13):
    """How many rows to add for the wanted shares, scaled down when over the target; never fewer than none."""
    x = counts.withColumns({"a": F.greatest(F.lit(0), F.lit(int(target * direct)) - F.col("direct")), "b": F.greatest(F.lit(0), F.lit(int(target * single)) - F.col("single"))})
    scale = (target - F.col("total")) / F.greatest(F.col("a") + F.col("b"), F.lit(1))
    cut = lambda c: F.when(target - F.col("total") - F.col("a") - F.col("b") < 0, (F.col(c) * scale).cast("long")).otherwise(F.col(c))
    return x.select(cut("a").cast("long").alias("raw_direct"), cut("b").cast("long").alias("raw_single"), F.greatest(F.lit(0), cut("a")).cast("long").alias("direct_answer"), F.greatest(F.lit(0), cut("b")).cast("long").alias("single_search"))


@query("vitals_out_of_range", "SELECT e.event_id, t.kind, e.value > t.high AS is_high, e.value < t.low AS is_low FROM events e JOIN (VALUES ('view', 'temperature', 3.0, 9.0), ('click', 'glucose', 1.0, 6.1)) t(event_type, kind, low, high) ON e.event_type = t.event_type AND (e.value < t.low OR e.value > t.high)")
def vitals(spark, sf_dir):
    t = spark.createDataFrame([("view", "temperature", 3.0, 9.0), ("click", "glucose", 1.0, 6.1)], "event_type string, kind string, low double, high double")
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value").join(F.broadcast(t), "event_type").where("value < low OR value > high")
    return e.select("event_id", "kind", (F.col("value") > F.col("high")).alias("is_high"), (F.col("value") < F.col("low")).alias("is_low"))


@query("cosine_matrix", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0")
def cosine_matrix(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), R.unit(F.col("embedding")).alias("e"))
    q = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("e").alias("q"))
    return R.dense(v, q, "e", "q").select(F.col("qid").alias("a"), F.col("doc_id").alias("b"), F.round("dense", 5).alias("cosine"))


def generated(spark, sf_dir):
    """User turns as guesses and the next assistant turns as references, as tokens."""
    from corpusmill.plans.conversations import pairs

    return pairs(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), tokens(F.col("q")).alias("g"), tokens(F.col("a")).alias("t"))


_GEN = f"SELECT conv_id || '-' || turn AS id, list_filter(string_split_regex(q, '\\s+'), lambda x: x <> '') AS g, list_filter(string_split_regex(a, '\\s+'), lambda x: x <> '') AS t FROM ({CONV['qa_pairs']})"


def _overlap_sql(n, gen="gen"):
    gram = lambda c: f"unnest(list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' ')))"
    side = lambda c: f"(SELECT id, w, count(*) AS k FROM (SELECT id, {gram(c)} AS w FROM {gen}) WHERE w IS NOT NULL GROUP BY id, w)"
    return f"(SELECT id, sum(least(coalesce(x.k, 0), coalesce(y.k, 0))) AS hit FROM {side('g')} x FULL JOIN {side('t')} y USING (id, w) GROUP BY id)"


for _n in (1, 2):
    QUERIES[f"rouge_{_n}"] = (lambda n: lambda spark, sf_dir: E.rouge(generated(spark, sf_dir), "id", "g", "t", n))(_n)
    ORACLES[f"rouge_{_n}"] = f"WITH gen AS ({_GEN}) SELECT gen.id, round(CASE WHEN coalesce(hit, 0) > 0 THEN 2 * hit / (greatest(len(g) - {_n - 1}, 0) + greatest(len(t) - {_n - 1}, 0)) ELSE 0 END, 6) AS rouge_{_n} FROM gen LEFT JOIN {_overlap_sql(_n)} o ON o.id = gen.id"

QUERIES["rouge_l"] = lambda spark, sf_dir: E.rouge_l(generated(spark, sf_dir), "id", "g", "t")
_FOUR = ", ".join(f"CASE WHEN h{n} > 0 THEN h{n} ELSE 0.1 END / greatest(lg - {n - 1}, 1) AS p{n}" for n in (1, 2, 3, 4))


def bleu_sql(gen):
    """SQL of the four sentence scores of ``gen`` (id, g, t)."""
    hits = " ".join(f"LEFT JOIN {_overlap_sql(n)} o{n} ON o{n}.id = gen.id" for n in (1, 2, 3, 4))
    score = ", ".join(f"round(CASE WHEN lg = 0 OR h1 = 0 THEN 0 ELSE bp * exp(({' + '.join(f'ln(p{i})' for i in range(1, n + 1))}) / {n}) END, 6) AS bleu_{n}" for n in (1, 2, 3, 4))
    return f"""WITH gen AS ({gen}), p AS (SELECT gen.id, len(g) AS lg, len(t) AS lt, {", ".join(f"coalesce(o{n}.hit, 0) AS h{n}" for n in (1, 2, 3, 4))} FROM gen {hits}),
s AS (SELECT *, CASE WHEN lg = 0 THEN 0 WHEN lg > lt THEN 1 ELSE exp(1 - lt / lg) END AS bp, {_FOUR} FROM p) SELECT id, {score} FROM s"""


QUERIES["bleu_4"] = lambda spark, sf_dir: E.bleu(generated(spark, sf_dir), "id", "g", "t")
ORACLES["bleu_4"] = bleu_sql(_GEN)


def segmented_bleu(spark, sf_dir):
    """Means of the four scores over segmented turns, a blank one taken as a placeholder."""
    from corpusmill.functions.text import words_and_cjk
    from corpusmill.plans.conversations import pairs

    words = lambda c: F.when(F.trim(c) == "", F.array(F.lit("空"))).otherwise(words_and_cjk(F.col(c)))
    p = pairs(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), words("q").alias("g"), words("a").alias("t"))
    return E.mean_bleu(E.bleu(p, "id", "g", "t"))


_SEGMENTED = f"SELECT conv_id || '-' || turn AS id, {{q}} AS g, {{a}} AS t FROM ({CONV['qa_pairs']})".format(**{c: f"CASE WHEN trim({c}) = '' THEN ['空'] ELSE regexp_extract_all(lower({c}), '[\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{Nd}}}}\\p{{{{Pc}}}}]+') END".replace("{{", "{").replace("}}", "}") for c in "qa"})
QUERIES["bleu_segmented"] = segmented_bleu
ORACLES["bleu_segmented"] = f"SELECT {', '.join(f'round(avg(bleu_{n}), 5) AS bleu_{n}' for n in (1, 2, 3, 4))} FROM ({bleu_sql(_SEGMENTED)})"


def characters(spark, sf_dir):
    """The turns as characters, white space left out."""
    chars = lambda c: F.filter(F.split(F.array_join(c, ""), ""), lambda x: x != "")
    return generated(spark, sf_dir).select("id", chars("g").alias("g"), chars("t").alias("t"))


_CHARS = f"SELECT id, list_filter(string_split(array_to_string(g, ''), ''), lambda x: x <> '') AS g, list_filter(string_split(array_to_string(t, ''), ''), lambda x: x <> '') AS t FROM ({_GEN})"
QUERIES["rouge_characters_2"] = lambda spark, sf_dir: E.rouge(characters(spark, sf_dir), "id", "g", "t", 2)
ORACLES["rouge_characters_2"] = f"WITH gen AS ({_CHARS}) SELECT gen.id, round(CASE WHEN coalesce(hit, 0) > 0 THEN 2 * hit / (greatest(len(g) - 1, 0) + greatest(len(t) - 1, 0)) ELSE 0 END, 6) AS rouge_2 FROM gen LEFT JOIN {_overlap_sql(2)} o ON o.id = gen.id"
QUERIES["rouge_characters_l"] = lambda spark, sf_dir: E.rouge_l(characters(spark, sf_dir), "id", "g", "t")
QUERIES["bleu_corpus_characters"] = lambda spark, sf_dir: E.corpus_bleu(characters(spark, sf_dir), "id", "g", "t")
ORACLES["bleu_corpus_characters"] = f"""WITH gen AS ({_CHARS}), n AS (SELECT sum(len(g)) AS lg, sum(len(t)) AS lt, {", ".join(f"sum(greatest(len(g) - {n - 1}, 0)) AS n{n}" for n in (1, 2, 3, 4))} FROM gen)
SELECT round(CASE WHEN lg > lt THEN 1 ELSE exp(1 - lt / lg) END * exp(({" + ".join(f"ln((SELECT sum(hit) FROM {_overlap_sql(n)}) / n{n})" for n in (1, 2, 3, 4))}) / 4), 6) AS bleu_4 FROM n"""
QUERIES["bleu"] = lambda spark, sf_dir: E.bleu(generated(spark, sf_dir), "id", "g", "t", 2)
ORACLES["bleu"] = f"""WITH gen AS ({_GEN}), p AS (SELECT gen.id, len(g) AS lg, len(t) AS lt, coalesce(a.hit, 0) AS h1, coalesce(b.hit, 0) AS h2 FROM gen LEFT JOIN {_overlap_sql(1)} a ON a.id = gen.id LEFT JOIN {_overlap_sql(2)} b ON b.id = gen.id),
s AS (SELECT *, CASE WHEN lg = 0 THEN 0 WHEN lg > lt THEN 1 ELSE exp(1 - lt / lg) END AS bp, CASE WHEN h1 > 0 THEN h1 ELSE 0.1 END / greatest(lg, 1) AS p1, CASE WHEN h2 > 0 THEN h2 ELSE 0.1 END / greatest(lg - 1, 1) AS p2 FROM p)
SELECT id, round(CASE WHEN lg = 0 OR h1 = 0 THEN 0 ELSE bp * p1 END, 6) AS bleu_1, round(CASE WHEN lg = 0 OR h1 = 0 THEN 0 ELSE bp * exp((ln(p1) + ln(p2)) / 2) END, 6) AS bleu_2 FROM s"""
