"""Connected components of an undirected graph, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.storage import cut, discard


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(id, component)`` for every vertex that occurs in ``edges``.

    The component is named by its smallest vertex.  Each round lets every
    vertex take the smallest label among its own and its neighbours' labels,
    then follows labels one step (pointer jumping), so that the number of
    rounds grows with the logarithm of the diameter in the usual case.  Labels
    are written to the shared folder after each round.  The minimum is combined
    before the shuffle, and the joins read plain exchanges on both sides, so a
    vertex with very many neighbours is split by adaptive execution.  Null ends
    and loops are ignored; a vertex with only loops is not returned.
    """
    both = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    both = cut(both.select("x", "y").union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    moved = None
    while True:  # each round lowers a label or is the last
        near = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("near")), "y").groupBy("x").agg(F.min("near").alias("near"))
        step = labels.join(near, "x", "left").select("x", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("next"))
        before, moved = moved, cut(step.join(jump, "label", "left").select("x", "was", F.least("label", "next").alias("label")), "labels")
        if before is not None:
            discard(before)
        labels = moved.select("x", "label")
        if moved.where("was <> label").isEmpty():
            return labels.select(F.col("x").alias("id"), F.col("label").alias("component"))
