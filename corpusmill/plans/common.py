"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or the given columns of it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scalar(name: str, key: str, value, columns):
    """A query of one table: ``key`` and columns made from ``value(df)``, a column expression."""

    def query(spark, sf_dir: str) -> DataFrame:
        made = columns(value() if callable(value) else F.col(value))
        return table(spark, sf_dir, name).select(key, *[c.alias(k) for k, c in made.items()])

    return query
