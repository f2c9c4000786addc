"""Sequences for training: truncation, padding, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.storage import cut

IGNORED = -100


def truncated(ids: Column, longest: int) -> Column:
    """The first ``longest`` ids."""
    return F.slice(ids, 1, longest)


def padded(ids: Column, size: Column, pad: int) -> Column:
    """``(ids, mask, labels)`` of a length, labels of padding ignored."""
    fill = F.greatest(size - F.size(ids), F.lit(0))
    return F.struct(F.concat(ids, F.array_repeat(F.lit(pad), fill)).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), fill)).alias("mask"), F.concat(ids, F.array_repeat(F.lit(IGNORED), fill)).alias("labels"))


def running_total(df: DataFrame, order: str, value: str, out: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows by ``order``.

    In two levels: rows are ranged by ``order`` into parts, sums of parts are
    added up (one row each), and each part adds up its own rows.
    """
    parts = cut(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"), F.min(order).alias("_first"))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_offset")
    own = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(out, F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")


def pack(df: DataFrame, order: str, tokens: str, length: int, end) -> DataFrame:
    """``(chunk, tokens)``: all rows' tokens, an end mark behind each, in pieces of ``length``; the rest is dropped.

    Rows send pieces of their arrays, not single tokens.
    """
    x = df.select(order, F.concat(F.col(tokens), F.array(F.lit(end))).alias("_t")).withColumn("_n", F.size("_t").cast("long"))
    x = running_total(x, order, "_n")
    first, last = F.floor(F.col("before") / length), F.floor((F.col("before") + F.col("_n") - 1) / length)
    x = x.withColumn("chunk", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("chunk") * length - F.col("before"), F.lit(0))
    x = x.withColumn("piece", F.slice("_t", (start + 1).cast("int"), F.lit(length) - F.greatest(F.col("before") - F.col("chunk") * length, F.lit(0)).cast("int")))
    y = x.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "piece"))).alias("p"))
    return y.select("chunk", F.flatten(F.transform("p", lambda z: z["piece"])).alias("tokens")).where(F.size("tokens") == length)
