"""Streams: append, first of a key, windows and sessions."""

from pyspark.sql import functions as F

from corpusmill.storage import new_path
from corpusmill.streaming import append


def test_streams(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    src = lambda: append.source(spark, sf, "events.parquet", schema)
    out = new_path(spark, "s")
    append.drain(append.window_counts(src(), "ts", "event_type", "1 day"), out)
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = spark.read.parquet(out)
    want = batch.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert closed.count() > 0 and closed.join(want, ["start", "event_type", "n"]).count() == closed.count()
    out = new_path(spark, "s")
    append.drain(append.first_seen(src(), ["user_id"], "ts", "40 days"), out)
    assert spark.read.parquet(out).count() == batch.select("user_id").distinct().count()
    out = new_path(spark, "s")
    append.drain(append.session_counts(src(), "ts", "user_id"), out)
    assert spark.read.parquet(out).count() > 0
