"""Where callables of the user run: annotators, judges, embedders, generators, tokenizers.

A hook is a function of a list of dictionaries that gives a list of the same
length.  Rows reach it in batches; ``workers`` bounds how many batches run at a
time in the whole job, for services that allow so many calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.batches import pieces
from corpusmill.storage import cut, new_path

#: Rows of one task where ``workers`` bounds how many tasks there are at a time.
TASK_ROWS = 20_000

def call(df: DataFrame, hook: Callable[[list[dict]], list[dict]], schema: str, batch: int = 10, workers: int | None = None, tries: int = 3, wait: float = 1.0, limit_error: type[Exception] | None = None) -> DataFrame:
    """``df`` with the columns of ``schema`` that the hook gives; null where all tries failed.

    A failed batch is tried again after ``wait`` seconds, after 2, 4, ... times
    that if the error is ``limit_error`` (a service's limit on calls).  With
    ``workers``, more than ``TASK_ROWS`` rows for each are written and called for
    in waves of so many tasks, one after the other.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    keep = [c for c in df.columns if c not in names]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame[keep]
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found = None
                for n in range(tries):
                    try:
                        found = hook(part.to_dict("records"))
                        break
                    except Exception as e:
                        time.sleep(wait * 2**n if limit_error is not None and isinstance(e, limit_error) else wait)
                rows = found if found is not None else [{}] * len(part)
                made = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], part.index, object) for n in names})
                yield pd.concat([part, made], axis=1)

    df = df.select(*keep)
    made = lambda rows: (rows.repartition(workers) if workers else rows).mapInPandas(run, f"{kinds}, {schema}")
    waves = -(-df.count() // (workers * TASK_ROWS)) if workers else 1
    if waves <= 1:
        return made(df)
    path = new_path(df.sparkSession, "waves")
    df.withColumn("_wave", F.pmod(F.monotonically_increasing_id(), F.lit(waves))).write.partitionBy("_wave").parquet(path)
    return reduce(DataFrame.union, [cut(made(df.sparkSession.read.schema(df.schema).parquet(f"{path}/_wave={i}")), "called") for i in range(waves)])


def tokenizer(function: Callable[[str], list[str]]):
    """A column function from a Python tokenizer, by batches in pieces, so that a task holds the tokens of a few texts."""
    from pyspark.sql.types import ArrayType, StringType

    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        held = pa.RecordBatch.from_arrays([texts], names=["t"])
        made = [pa.array([[] if t is None else list(function(t)) for t in b.column(0).to_pylist()], pa.list_(pa.string())) for b in pieces([held], "t")]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))

    return run


def neutral_sentiment() -> dict:
    """The fallback where no sentiment library is at hand."""
    return {"positive": F.lit(0.5), "negative": F.lit(0.5)}


def overlay(base: dict, over: dict) -> dict:
    """A configuration with a scenario laid over it, dictionaries merged at every depth."""
    return base | {k: overlay(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}
