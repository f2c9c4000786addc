"""Sampling, class balancing and splitting, by hash order and so the same on any layout.

A row's place in its class is its rank by ``md5(seed | id)``.  Ranks need one
shuffle by label; a class that holds most rows would be one task, so ranks are
taken in two steps: within hash ranges of bounded size, then by the sizes of the
ranges before (``place``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.storage import cut


def hash_order(key: str | Column, seed: int = 42) -> Column:
    """The order that stands for a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key if isinstance(key, Column) else F.col(key)).cast("binary"))


def place(df: DataFrame, label: str | None, order: Column, tie: str, out: str = "place", ranges: int = 4096) -> DataFrame:
    """``df`` with the rank from 1 of each row in its class by ``order``, then ``tie``.

    ``order`` must be hexadecimal text: its first three letters name a range.
    """
    part = [F.col(label)] if label else []
    df = df.withColumn("_o", order).withColumn("_r", F.substring("_o", 1, max(1, round(math.log(ranges, 16)))))
    sizes = df.groupBy(*part, "_r").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*(part or [F.lit(1)])).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy(*part, "_r").orderBy("_o", tie))
    keys = [c for c in ([label] if label else []) + ["_r"]]
    joined = df.withColumn("_k", rank).alias("d").join(before.drop("_n").alias("b"), [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return joined.select("d.*", "b._before").withColumn(out, (F.col("_k") + F.col("_before")).cast("long")).drop("_o", "_r", "_k", "_before")


def ranked(df: DataFrame, label: str | None, key: str, out: str = "place") -> DataFrame:
    """``df`` with the rank from 1 of each row in its class by ``key`` itself.

    Rows are dealt by ranges of (class, key), as many as there are shuffle
    partitions, so neither a large class nor crowded keys make one task.
    """
    part = [F.col(label)] if label else []
    df = cut(df.repartitionByRange(*part, F.col(key)).withColumn("_r", F.spark_partition_id()), "ranged")
    sizes = df.groupBy(*part, "_r").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*(part or [F.lit(1)])).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    keys = ([label] if label else []) + ["_r"]
    x = df.withColumn("_k", F.row_number().over(W.partitionBy(*part, "_r").orderBy(key))).alias("d")
    x = x.join(before.drop("_n").alias("b"), [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return x.select("d.*", "b._before").withColumn(out, (F.col("_k") + F.col("_before")).cast("long")).drop("_r", "_k", "_before")


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def resample(df: DataFrame, label: str, key: str, targets: DataFrame, strategy: str = "smart", seed: int = 42) -> DataFrame:
    """``df`` with each class brought to its target; ``copy`` counts a row's replicas from 0.

    ``targets``: (label, target).  A label without a target keeps its rows; one
    without rows is left out.  ``oversample`` repeats rows evenly, and where a
    class has its target already keeps as many first rows in key order;
    ``undersample`` takes rows in hash order; ``smart`` does what is needed;
    ``draw`` is as ``oversample``, but what a class lacks is drawn with replacement.
    """
    if strategy == "draw":
        return drawn(df, label, key, targets, seed)
    if strategy not in ("oversample", "undersample", "smart"):
        raise ValueError(f"unknown strategy: {strategy}")
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_size")).join(targets.select(F.col(label).alias("_l"), F.col("target").alias("_target")), "_l", "left")
    x = ranked(place(df, label, hash_order(key, seed), key, "_hash"), label, key, "_first") if strategy == "oversample" else place(df, label, hash_order(key, seed), key, "_hash").withColumn("_first", F.col("_hash"))
    x = x.join(few(sizes), x[label] == sizes["_l"])
    even = F.floor(F.col("_target") / F.col("_size")) + (F.col("_hash") <= F.col("_target") % F.col("_size")).cast("int")
    down = (F.col("_hash") <= F.col("_target")).cast("int")
    over = F.when(F.col("_size") >= F.col("_target"), (F.col("_first") <= F.col("_target")).cast("int")).otherwise(even)
    under = F.when(F.col("_size") > F.col("_target"), down).otherwise(1)
    smart = F.when(F.col("_size") >= F.col("_target"), down).otherwise(even)
    copies = F.when(F.col("_target").isNull(), 1).otherwise({"oversample": over, "undersample": under, "smart": smart}[strategy]).cast("int")
    x = x.withColumn("_copies", copies).where("_copies > 0")
    return x.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).select(*df.columns, "copy")


def drawn(df: DataFrame, label: str, key: str, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``df`` and, of each class below its target, as many draws with replacement as it lacks; ``copy`` counts a row's replicas from 0.

    Draw i takes the row whose rank by key is the hash of (seed, class, i) modulo
    the class's size.  Each row makes the draws whose number is its own rank modulo
    that size, so they are spread as the rows are; draws of one row are counted
    before they meet it.  Classes at their target keep the first rows in key order,
    those without a target all; rows without a class are left out.
    """
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_size")).join(targets.select(F.col(label).alias("_l"), F.col("target").alias("_target")), "_l", "left")
    x = ranked(df, label, key, "_first")
    x = x.join(few(sizes), x[label] == sizes["_l"])
    own = F.col("_first") - 1
    many = F.ceil((F.col("_target") - F.col("_size") - own) / F.col("_size"))
    number = x.where(F.col("_target") - F.col("_size") > own).select("_l", "_size", own.alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("_j"))
    number = number.withColumn("_i", F.col("_j") * F.col("_size") + F.col("_own"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "_l", "_i").cast("binary")), 1, 15), 16, 10).cast("long")
    picked = number.select(F.col("_l").alias("_pl"), (F.pmod(hashed, F.col("_size")) + 1).alias("_pick")).groupBy("_pl", "_pick").agg(F.count("*").alias("_drawn"))
    x = x.join(picked, (F.col("_l") == F.col("_pl")) & (F.col("_first") == F.col("_pick")), "left")
    full = F.col("_size") >= F.col("_target")
    copies = F.when(full, (F.col("_first") <= F.col("_target")).cast("long")).otherwise(1 + F.coalesce("_drawn", F.lit(0)))
    x = x.withColumn("_copies", copies).where("_copies > 0")
    return x.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int")))).select(*df.columns, "copy")


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, marked for broadcast if it has no more rows than ``most``."""
    return F.broadcast(df) if df.count() <= most else df


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows of each class."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def ratio_targets(df: DataFrame, label: str, ratios: dict, total: int | None = None) -> DataFrame:
    """Targets from shares, brought to a sum of 1 if that is off by more than a hundredth."""
    s = sum(ratios.values())
    ratios = ratios if 0.99 <= s <= 1.01 else {k: v / s for k, v in ratios.items()}
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in ratios.items() for x in (k, float(v))]), F.col(label))
    size = df.agg(F.count("*").alias("_total")) if total is None else df.sparkSession.range(1).select(F.lit(total).alias("_total"))
    return df.select(label).distinct().join(F.broadcast(size)).select(label, (F.col("_total") * share).cast("long").alias("target")).where("target IS NOT NULL")


def balance(df: DataFrame, label: str, key: str, method: str, seed: int = 42, **config) -> DataFrame:
    """One of five methods: counts, ratios, uniform, min, max."""
    spark, sizes = df.sparkSession, class_sizes(df, label)
    if method == "counts":
        targets = spark.createDataFrame(list(config["target_counts"].items()), f"{label} string, target long")
        return resample(df, label, key, targets, config.get("strategy", "smart"), seed)
    if method == "ratios":
        return resample(df, label, key, ratio_targets(df, label, config["target_ratios"], config.get("total_samples")), config.get("strategy", "smart"), seed)
    if method == "uniform":
        if config.get("target_count") is not None:
            return resample(df, label, key, sizes.select(label, F.lit(config["target_count"]).alias("target")), "smart", seed)
        least = sizes.agg(F.min("n").alias("target"))
        return resample(df, label, key, sizes.select(label).join(F.broadcast(least)), "smart", seed)
    if method == "min":
        return resample(df, label, key, sizes.select(label, F.greatest("n", F.lit(config["min_samples"])).alias("target")), "smart", seed)
    if method == "max":
        return resample(df, label, key, sizes.select(label, F.least("n", F.lit(config["max_samples"])).alias("target")), "undersample", seed)
    raise ValueError(f"unknown method: {method}")


def random_split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: train, val, test of 80, 10 and 10 percent in exact sizes."""
    n = df.agg(F.count("*").alias("_n"))
    x = place(df, None, hash_order(key, seed), key).join(F.broadcast(n))
    rest = F.ceil(F.col("_n") * F.lit("0.2").cast("decimal(2,1)"))
    test = F.ceil(rest / 2)
    return x.withColumn("split", F.when(F.col("place") <= F.col("_n") - rest, "train").when(F.col("place") <= F.col("_n") - test, "val").otherwise("test")).drop("place", "_n")


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``split``, 85, 10 and 5 percent within each stratum; small ones keep a row for training, then for validation."""
    x = place(df, label, hash_order(key, seed), key)
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    x = x.join(few(sizes), x[label].eqNullSafe(sizes["_l"]))
    train = F.greatest(F.lit(1), F.floor(F.col("_n") * 85 / 100))
    valid = F.when(F.col("_n") > 2, F.greatest(F.lit(1), F.floor(F.col("_n") * 10 / 100))).otherwise(0)
    return x.withColumn("split", F.when(F.col("place") <= train, "train").when(F.col("place") <= train + valid, "valid").otherwise("test")).select(*df.columns, "split")


def hold_out(df: DataFrame, key: str, percent: int = 10, seed: int = 42) -> DataFrame:
    """``df`` with ``held_out``: the last ``percent`` of the hash order, rounded up."""
    n = df.agg(F.count("*").alias("_n"))
    x = place(df, None, hash_order(key, seed), key).join(F.broadcast(n))
    return x.withColumn("held_out", F.col("place") > F.col("_n") - F.ceil(F.col("_n") * percent / 100)).drop("place", "_n")
