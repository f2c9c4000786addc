"""Exact quantiles of any number of rows.

A mergeable sketch of bounded size brackets the wanted rank, and a counting pass
says how many rows lie below and inside the bracket.  While a bracket holds more
rows than ``most``, a sketch of its inside narrows it; at last its values are
counted one by one and the wanted ranks are read off.  No buffer and no task
holds more than the sketch, or ``most`` values of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.storage import cut, discard

#: Cells of a sketch's grid, the accuracy of a sketch (a fraction of a cell), and brackets that are broadcast.
GRID, ACCURACY, SENT = 64, 4096, 10_000


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float], most: int = 100_000) -> DataFrame:
    """``(group, share, quantile)`` for each group and share, interpolated between neighbouring values.

    Null values count for nothing, and a group of nulls alone is left out; NaN is
    the greatest value; a null group is a group; ties and repeated rows count as
    often as they occur; an empty table gives an empty one.
    """
    x = rows.select(F.col(f"`{group}`").alias("g"), F.col(f"`{value}`").cast("double").alias("v")).where("v IS NOT NULL")
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    at = F.explode(F.array(*[F.struct(F.lit(s).alias("share")) for s in shares])).alias("x")
    first = x.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", grid, ACCURACY).alias("grid"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.col("share") * (F.col("n") - 1)
    first = first.select("*", at).select("*", "x.share").select("g", "share", "n", "grid", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.floor(place).alias("lo"), F.ceil(place).alias("hi"))
    state = cut(first, "brackets")
    while not state.where((F.col("inside") > most) & (F.col("low") < F.col("high"))).isEmpty():
        cell = lambda rank: F.floor((F.col(rank) - F.col("below")) / F.col("inside") * GRID)
        narrow = F.col("inside") > most
        low = F.when(narrow & (cell("lo") >= 1), F.get("grid", (cell("lo") - 1).cast("int"))).otherwise(F.col("low"))
        high = F.when(narrow & (cell("hi") + 2 <= GRID), F.get("grid", (cell("hi") + 2).cast("int"))).otherwise(F.col("high"))
        told = state.select("g", "share", "n", "lo", "hi", low.alias("low"), high.alias("high"))
        within = F.col("v").between(F.col("low"), F.col("high"))
        new = _met(x, told).groupBy("g", "share", "n", "lo", "hi", "low", "high").agg(
            F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(within).alias("inside"), F.percentile_approx(F.when(within, F.col("v")), grid, ACCURACY).alias("grid"))
        old, state = state, cut(new, "brackets")
        discard(old)
    counted = _met(x, state.select("g", "share", "lo", "hi", "low", "high", "below")).where("v BETWEEN low AND high")
    counted = counted.groupBy("g", "share", "lo", "hi", "below", "v").agg(F.count("*").alias("c"))
    last = F.col("below") + F.sum("c").over(W.partitionBy("g", "share").orderBy("v")) - 1  # the rank of a value's last row
    counted = counted.withColumn("last", last).withColumn("first", F.col("last") - F.col("c") + 1)
    holds = lambda rank: F.max(F.when(F.col(rank).between(F.col("first"), F.col("last")), F.col("v")))
    found = counted.groupBy("g", "share").agg(holds("lo").alias("a"), holds("hi").alias("b"))
    out = found.join(state.select(F.col("g").alias("g2"), F.col("share").alias("s2"), "n"), F.col("g").eqNullSafe(F.col("g2")) & (F.col("share") == F.col("s2")))
    part = place - F.floor(place)
    return out.select(F.col("g").alias(group), "share", F.when(part == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * part).alias("quantile"))


def _met(x: DataFrame, brackets: DataFrame) -> DataFrame:
    """Rows with the brackets of their group; few brackets are broadcast."""
    if brackets.count() <= SENT:
        brackets = F.broadcast(brackets)
    return x.join(brackets.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2"))).drop("g2")
