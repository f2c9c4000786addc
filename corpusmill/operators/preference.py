"""Preference pairs: score candidates, choose one and reject one for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The bounds and weights of the selection.
CHOSEN = {"quality": 7.0, "hallucination": 3.0, "overreach": 3.0, "readability": 7.0}
READABLE, TOP, GAP, CENTRE = (5.0, 7.0), 3, 2.0, 6.0
# End of the fixed values.


def overall(q: Column, r: Column, h: Column, o: Column) -> Column:
    """The score of a candidate."""
    return 0.4 * q + 0.2 * r - 0.2 * h - 0.2 * o


def select_pairs(candidates: DataFrame, question: str, order: str, least_gap: float = GAP, top: int = TOP) -> DataFrame:
    """``(question, chosen, rejected, gap)``: ``order`` of the two candidates and their difference in quality.

    Candidates have ``quality``, ``hallucination``, ``overreach`` and
    ``readability``.  Chosen is the safest of the best ``top`` that are good
    enough; rejected, of the others by value that are half readable, the one of
    the greatest contrast.  A chosen one that isn't safer needs twice the gap.
    """
    scores = ["quality", "hallucination", "overreach", "readability"]
    x = candidates.select(question, order, *scores)
    best = W.partitionBy(question).orderBy(F.desc("quality"), order)
    x = x.withColumns({"_rank": F.row_number().over(best), "_n": F.count("*").over(W.partitionBy(question))}).where("_n > 1").drop("_n")
    good = x.where((F.col("_rank") <= top) & (F.col("quality") >= CHOSEN["quality"]) & (F.col("hallucination") <= CHOSEN["hallucination"]) & (F.col("overreach") <= CHOSEN["overreach"]) & (F.col("readability") >= CHOSEN["readability"]))
    good = good.groupBy(question).agg(F.min_by(F.struct(order, *scores), F.struct((F.col("hallucination") + F.col("overreach")), "_rank")).alias("c"))
    y = x.join(good, question).where(~F.struct(*scores).eqNullSafe(F.struct(*[F.col(f"c.{s}") for s in scores])) & F.col("readability").between(*READABLE))
    gap = F.col("c.quality") - F.col("quality")
    contrast = F.when(gap < GAP, -1000.0).otherwise(gap + 0.8 * F.col("hallucination") + 0.8 * F.col("overreach") - 0.3 * F.abs(F.col("readability") - CENTRE))
    y = y.withColumns({"_gap": gap, "_s": contrast}).where("_s > 0")
    z = y.groupBy(question).agg(F.min_by(F.struct(F.col("c." + order).alias("chosen"), F.col(order).alias("rejected"), F.col("_gap").alias("gap"), (F.col("c.hallucination") + F.col("c.overreach")).alias("cs"), (F.col("hallucination") + F.col("overreach")).alias("rs")), F.struct(-F.col("_s"), order)).alias("p")).select(question, "p.*")
    return z.where((F.col("gap") >= least_gap) & ((F.col("cs") < F.col("rs")) | (F.col("gap") >= 2 * least_gap))).select(question, "chosen", "rejected", "gap")
