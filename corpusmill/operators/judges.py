"""Judges, evaluators, embedders, generators and a search tool: what a hook's replies become.

The model behind each is the caller's; ``hooks.call`` sends it batches.  Replies
are read by column expressions, so a table of stored replies is read alike.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import hooks

#: The members of an evaluation that filters read, and their columns.
FLAGS = {"pass": "eval_pass", "has_overreach": "eval_has_overreach", "has_hallucination": "eval_has_hallucination", "red_flag_omission": "eval_red_flag_omission"}


def reply_object(raw: Column) -> Column:
    """The JSON object of a reply, from its first brace to its last; null if there is none or it is broken.

    The parser reads one value and ignores what follows it.  Nothing follows if
    the text is a value both inside an array and inside an object.  An object
    that repeats a member counts as broken.
    """
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    whole = lambda before, after: F.try_parse_json(F.concat(F.lit(before), found, F.lit(after))).isNotNull()
    return F.when((found != "") & whole("[", "]") & whole('{"_": ', "}"), found)


def judgements(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with ``judgement`` (the reply's object) and ``parse_error``; both null where no reply came."""
    found = reply_object(F.col(raw))
    return df.withColumns({"judgement": found, "parse_error": F.when(F.col(raw).isNotNull(), found.isNull())})


def judge(df: DataFrame, model: Callable[[list[dict]], list[str]], **how) -> DataFrame:
    """``df`` with ``raw``, ``judgement`` and ``parse_error``; ``model`` takes rows and gives replies."""
    return judgements(hooks.call(df, lambda rows: [{"raw": x} for x in model(rows)], "raw string", **how))


def evaluations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with ``evaluation``, ``evaluated`` and a column for each of ``FLAGS``.

    A member that the object lacks is false; without an object, or with an empty
    one, a row is not evaluated, and its flags are null.
    """
    found = reply_object(F.col(raw))
    some = F.coalesce(F.size(F.json_object_keys(found)) > 0, F.lit(False))
    flag = lambda member: F.when(F.col("evaluated"), F.coalesce(F.get_json_object("evaluation", f"$.{member}").try_cast("boolean"), F.lit(False)))
    df = df.withColumns({"evaluation": F.when(some, found), "evaluated": some})
    return df.withColumns({column: flag(member) for member, column in FLAGS.items()})


def evaluate(df: DataFrame, model: Callable[[list[dict]], list[str]], workers: int = 3, batch: int = 10, **how) -> DataFrame:
    """``df`` with the results of an evaluator of questions and answers; ``model`` takes rows and gives replies."""
    return evaluations(hooks.call(df, lambda rows: [{"raw": x} for x in model(rows)], "raw string", batch=batch, workers=workers, **how)).drop("raw")


def embed(df: DataFrame, model: Callable[[list[str]], list] | None = None, text: str = "text", out: str = "embedding", batch: int = 256, **how) -> DataFrame:
    """``df`` with the vectors that ``model`` gives for its texts; without a model the column that is there already."""
    if model is None:
        if out not in df.columns:
            raise ValueError(f"no model, and no column {out}")
        return df
    return hooks.call(df, lambda rows: [{out: [float(x) for x in v]} for v in model([r[text] or "" for r in rows])], f"{out} array<double>", batch=batch, **how)


def generate(df: DataFrame, model: Callable[[list[dict], dict], list[str]], strategies: list[dict], batch: int = 32, **how) -> DataFrame:
    """A row for each row of ``df`` and each strategy: ``strategy`` (its place) and ``response``, without white space at its ends.

    Rows of a strategy reach the model together, with that strategy.
    """
    def run(rows: list[dict]) -> list[dict]:
        out: list[dict] = [{}] * len(rows)
        for s in sorted({r["strategy"] for r in rows}):
            own = [i for i, r in enumerate(rows) if r["strategy"] == s]
            for i, reply in zip(own, model([rows[i] for i in own], strategies[s]), strict=True):
                out[i] = {"response": reply.strip()}
        return out

    each = df.withColumn("strategy", F.explode(F.array(*[F.lit(i) for i in range(len(strategies))])))
    return hooks.call(each, run, "response string", batch=batch, **how)


def tool_schema(name: str = "search", description: str = "Searches the knowledge base.", **members: str) -> str:
    """What a model is told of a tool: its name, description and required text members, as JSON."""
    members = members or {"query": "What to search for"}
    given = {k: {"type": "string", "description": v} for k, v in members.items()}
    return json.dumps({"name": name, "description": description, "parameters": {"type": "object", "properties": given, "required": list(members)}}, ensure_ascii=False)


def answer_calls(calls: DataFrame, search: Callable[[DataFrame], DataFrame], key: str = "call_id", arguments: str = "arguments") -> DataFrame:
    """``(key, query, hits)``: each call with the rows that ``search`` finds for its query.

    ``search`` takes ``(qid, query)`` and gives the few best rows of each, with its
    ``qid``; equal queries are searched once.  Arguments that are no object, or have no text
    under ``query``, give a null query and no hits.
    """
    wanted = F.trim(F.get_json_object(F.col(arguments), "$.query"))
    asked = calls.select(key, F.when(wanted != "", wanted).alias("query"))
    found = search(asked.where("query IS NOT NULL").select(F.xxhash64("query").alias("qid"), "query").distinct())
    rest = [c for c in found.columns if c != "qid"]
    hits = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("hits"))
    return asked.join(hits, F.xxhash64("query") == F.col("qid"), "left").select(key, "query", "hits")
