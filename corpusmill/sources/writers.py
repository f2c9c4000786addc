"""Writers of split files, reports and knowledge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splits(df: DataFrame, path: str, split: str = "split", kind: str = "json") -> None:
    """One folder for each split, as JSON lines, CSV with a header, or Parquet."""
    out = df.write.mode("overwrite").partitionBy(split)
    out.option("header", True).csv(path) if kind == "csv" else getattr(out, kind)(path)


def conversations(df: DataFrame, path: str, meta: bool = True, alpaca: bool = False, compression: str | None = None) -> None:
    """Chat rows as JSON lines, with or without ``_meta``; or as instruction, input and output."""
    if alpaca:
        of = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), 0)["content"]
        rows = df.select(of("user").alias("instruction"), F.lit("").alias("input"), F.element_at(F.filter("messages", lambda m: m["role"] == "assistant"), -1)["content"].alias("output"), *(["_meta"] if meta and "_meta" in df.columns else []))
    else:
        rows = df if meta or "_meta" not in df.columns else df.drop("_meta")
    out = rows.write.mode("append")
    (out.option("compression", compression) if compression else out).json(path)


def three_ways(df: DataFrame, path: str, passed: str) -> None:
    """All rows, those that passed, and the others."""
    for name, rows in (("all", df), ("passed", df.where(passed)), ("problem", df.where(~F.coalesce(F.col(passed), F.lit(False))))):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def knowledge(docs: DataFrame, path: str) -> None:
    """Documents, their index tables, and one row about them.

    Texts are cut into terms once: the terms and the row are counted from the
    tables written before.
    """
    from corpusmill.operators.retrieval import lexical_index

    read = docs.sparkSession.read
    postings, _, _ = lexical_index(docs, "contents")
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    postings = read.schema(postings.schema).parquet(f"{path}/postings")
    postings.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    known = read.schema(docs.schema).parquet(f"{path}/docs").agg(F.count("*").alias("n"), F.count("contents").alias("known"))
    words = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))  # both are single rows
    stats = known.join(F.broadcast(words)).select("n", (F.col("words") / F.nullif("known", F.lit(0))).alias("avgdl"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def union_csv(frames: list[DataFrame], path: str) -> None:
    """Frames with different columns as one CSV, columns sorted."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.select(*sorted(out.columns)).write.mode("overwrite").option("header", True).csv(path)
