"""Queries of judges, evaluators, embedders, generators and the search tool (H03-H06, H08); the models here are rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import judges as J
from corpusmill.plans.common import table

QUERIES, ORACLES = {}, {}


def query(name, sql):
    """Register a query and its twin."""
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


@query("judge_replies", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{"score": ' || (doc_id % 5) || '}' END AS judgement, doc_id % 3 <> 0 AS parse_error FROM documents""")
def judge_replies(spark, sf_dir):
    def model(rows):
        return [("Verdict:\n{\"score\": %d}\nThat is all." % (r["doc_id"] % 5), "none", "{\"score\": }")[r["doc_id"] % 3] for r in rows]

    return J.judge(table(spark, sf_dir, "documents", "doc_id", "text"), model, workers=4).select("doc_id", "judgement", "parse_error")


@query("qa_evaluated", """SELECT doc_id, doc_id % 4 < 2 AS evaluated, CASE WHEN doc_id % 4 < 2 THEN doc_id % 4 = 0 END AS eval_pass, CASE WHEN doc_id % 4 < 2 THEN doc_id % 4 = 1 END AS eval_has_overreach,
CASE WHEN doc_id % 4 < 2 THEN false END AS eval_has_hallucination, CASE WHEN doc_id % 4 < 2 THEN false END AS eval_red_flag_omission FROM documents""")
def qa_evaluated(spark, sf_dir):
    replies = ('{"pass": true}', 'So: {"pass": false, "has_overreach": true, "details": "a } b"}', "{}", "no object")
    return J.evaluate(table(spark, sf_dir, "documents", "doc_id"), lambda rows: [replies[r["doc_id"] % 4] for r in rows]).drop("evaluation")


@query("embedder_hook", "SELECT doc_id, length(text)::DOUBLE AS x, (doc_id % 7)::DOUBLE AS y FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def embedder_hook(spark, sf_dir):
    d = J.embed(table(spark, sf_dir, "documents", "doc_id", "text"), lambda texts: [[len(t)] for t in texts], workers=4)
    return J.embed(d).select("doc_id", F.get("embedding", 0).alias("x"), (F.col("doc_id") % 7).cast("double").alias("y"))


@query("generator_by_strategy", "SELECT item_id, s::BIGINT AS strategy, md5(upper(text[s + 1:]) || s) AS response FROM (SELECT item_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS text FROM benchmark), range(3) t(s)")
def generator_by_strategy(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark", "item_id", "text").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    made = J.generate(items, lambda rows, s: [f"  {r['text'][s['skip']:].upper()}{s['skip']}\n" for r in rows], [{"skip": i} for i in range(3)])
    return made.select("item_id", F.col("strategy").cast("long").alias("strategy"), F.md5(F.col("response").cast("binary")).alias("response"))


@query("search_tool_calls", """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN n_name END AS query, CASE WHEN c_custkey % 5 <> 0 THEN n_nationkey::BIGINT END AS found
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def search_tool_calls(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    args = F.when(F.col("c_custkey") % 5 != 0, F.to_json(F.struct(F.concat(F.lit(" "), "n_name").alias("query")))).when(F.col("c_custkey") % 2 == 0, "{}").otherwise("no object")
    calls = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", args.alias("arguments"))
    out = J.answer_calls(calls, lambda q: q.join(nation, F.col("query") == F.col("n_name")).select("qid", F.col("n_nationkey").cast("long").alias("found")), "c_custkey")
    return out.select("c_custkey", "query", F.get("hits", 0)["found"].alias("found"))
