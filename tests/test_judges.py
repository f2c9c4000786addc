"""Replies, evaluations and calls of the search tool on odd input."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import judges


def test_replies(spark):
    rows = [(1, None), (2, ""), (3, "a {\"x\": {\"y\": 1}} b"), (4, "{\"x\": 1} and {\"y\": 2}"), (5, "{}"), (6, "}{"), (7, "line\n{\"pass\":\n true}\n"), (8, "{}] [{}"), (9, "{}} {{}"), (10, "{}, {}")]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = {r.id: (r.judgement, r.parse_error) for r in judges.judgements(df).collect()}
    assert [got.pop(i) for i in (8, 9, 10)] == [(None, True)] * 3
    assert got == {1: (None, None), 2: (None, True), 3: ('{"x": {"y": 1}}', False), 4: (None, True), 5: ("{}", False), 6: (None, True), 7: ('{"pass":\n true}', False)}
    got = {r.id: (r.evaluated, r.eval_pass, r.eval_has_overreach) for r in judges.evaluations(df).collect()}
    assert got[7] == (True, True, False) and got[3] == (True, False, False)
    assert all(got[i] == (False, None, None) for i in (1, 2, 4, 5, 6))


def test_a_judge_that_fails_leaves_nulls(spark):
    def model(rows):
        raise ValueError

    out = judges.judge(spark.range(3).coalesce(1), model, wait=0.0).collect()
    assert [(r.judgement, r.parse_error) for r in out] == [(None, None)] * 3


def test_embedding_without_a_model(spark):
    df = spark.createDataFrame([(1, [1.0])], "id int, embedding array<double>")
    assert judges.embed(df) is df
    with pytest.raises(ValueError):
        judges.embed(df, out="other")


def test_search_tool(spark):
    told = json.loads(judges.tool_schema())
    assert told["name"] == "search" and told["parameters"]["required"] == ["query"]
    args = ['{"query": "a"}', '{"query": " a "}', '{"query": " "}', "{}", "broken", None, '{"query": "none"}']
    calls = spark.createDataFrame(list(enumerate(args)), "call_id int, arguments string")
    asked = []

    def search(q):
        asked.extend(q.collect())
        return q.where("query = 'a'").withColumn("doc_id", F.explode(F.array(F.lit(2), F.lit(1))))

    got = {r.call_id: (r.query, r.hits and [h.doc_id for h in r.hits]) for r in judges.answer_calls(calls, search).collect()}
    assert len(asked) == 2
    assert got == {0: ("a", [1, 2]), 1: ("a", [1, 2]), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("none", None)}
