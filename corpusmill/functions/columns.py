"""Helpers for columns that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict) -> DataFrame:
    """``df`` with ``columns``, evaluated once whatever follows.

    A filter on a plain projection is rewritten onto its inputs, which copies
    costly expressions into every test.  Nothing is moved through a generator:
    this one yields a single row.
    """
    taken = {x.lower() for x in columns}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
