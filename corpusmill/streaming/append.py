"""Incremental work over files that arrive: append, first of each key, and windows by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def source(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def timed(df: DataFrame, time: str, late: str) -> DataFrame:
    """``df`` with a watermark on ``time``, which becomes a timestamp of the session's zone."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def drain(df: DataFrame, out: str, mode: str = "append", state: str | None = None) -> None:
    """Write all that is there now as Parquet, exactly once over restarts, and stop.

    What was done is kept in ``state``, a folder that lasts: beside ``out`` if none
    is named.  A later call with the same folders takes only what is new.
    """
    q = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state or out.rstrip("/") + "-state").trigger(availableNow=True).start()
    q.awaitTermination()


def copy_stream(spark: SparkSession, folder: str, pattern: str, schema, out: str, state: str | None = None) -> None:
    """Append the files that have arrived since the last call to ``out``."""
    drain(source(spark, folder, pattern, schema), out, state=state)


def first_seen(df: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(df, time, late).dropDuplicatesWithinWatermark(keys)


def window_counts(df: DataFrame, time: str, key: str, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows of each key in tumbling or sliding windows of event time."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return timed(df, time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_counts(df: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each key in sessions that a gap ends."""
    return timed(df, time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
