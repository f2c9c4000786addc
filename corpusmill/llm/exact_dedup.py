"""Exact de-duplication by a content sort.

Texts are normalised, sampled splitters deal the rows into ranges of content,
and Spark's external sort places equal texts side by side.  A task reads its
range once, holds each text against its neighbour in full, and names the row
that stays.  The order is that of the content's first characters, then of a
hash of all of it, then of the content; splitters hold the first two alone, so
what is sampled to the driver has a bound for each partition, and then of the
rows' ranks, so any number of copies is dealt over several ranges.

The runs at the two ends of a range may go on in the next one.  They are
written with their text, at most a few for each partition, and met by their
full texts; all rows of these runs then take what their whole group says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import free_name, settle
from corpusmill.storage import cut

#: What normalising deletes: space and the control characters 9 to 13.
DELETED = r"[\x20\x09-\x0D]+"
#: Characters of the content that a splitter holds.
LEAD = 48


def normalise(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), DELETED, "")


class _Run:
    """Rows of one text in one range, in the order of their ranks; the first is the best of them."""

    def __init__(self, text: str, place: tuple, size: int):
        self.text, self.place, self.length = text, place, size
        self.keys: list = []
        self.digest = hashlib.sha256(text.encode()).hexdigest()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    """The runs of a sorted range; neighbours are compared in full, all of a batch at once."""
    run = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column("norm")
        starts = [0, *(i + 1 for i in pc.indices_nonzero(pc.not_equal(text.slice(1), text.slice(0, n - 1))).to_pylist()), n]
        keys = batch.column("key")
        for a, b in zip(starts, starts[1:], strict=False):
            own = text[a].as_py()
            if run is None or run.text != own:
                if run is not None:
                    yield run
                run = _Run(own, (batch.column("lead")[a].as_py(), batch.column("hash")[a].as_py()), batch.column("size")[a].as_py())
            run.keys.append(keys.slice(a, b - a))
    if run is not None:
        yield run


def _told(kind: pa.DataType):
    """What a task does with its range: rows ``(key, head, n, sha, first, edge, size, norm)``.

    ``edge`` names a run that may go on in another range; its first row bears the text.
    """
    names = ["key", "head", "n", "sha", "first", "edge", "size", "norm"]

    def rows(run: _Run, edge: int | None) -> pa.RecordBatch:
        keys = pa.concat_arrays(run.keys) if len(run.keys) > 1 else run.keys[0]
        n = len(keys)
        only = lambda x, t: pa.array([x] + [None] * (n - 1), t)
        return pa.RecordBatch.from_arrays([
            keys, pa.repeat(keys[0], n), pa.repeat(pa.scalar(n, pa.int64()), n), pa.repeat(pa.scalar(run.digest), n), pa.array([True] + [False] * (n - 1)),
            pa.repeat(pa.scalar(edge, pa.int64()), n), only(run.length, pa.int64()), only(run.text if edge is not None else None, pa.string())], names=names)

    def run(batches):
        part, made, first, last, done = TaskContext.get().partitionId(), 0, None, [], []
        for x in _runs(batches):
            first = first or x.place
            if x.place == first:  # may have begun in the range before
                yield rows(x, (part << 32) + made)
                made += 1
                continue
            if last and last[0].place != x.place:  # what was the last so far is whole
                done += [rows(y, None) for y in last]
                last = []
                if sum(y.num_rows for y in done) > 5000:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done = []
            last.append(x)
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        for x in last:  # may go on in the range after
            yield rows(x, (part << 32) + made)
            made += 1

    return run


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``df``: ``key``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are the same after all white space is deleted.  Of
    equal texts the row with the most code points in the original text stays,
    then the one with the smallest key; exactly one, also of repeated rows.
    Defined results: a null text counts as empty, and all texts without other
    characters than white space are one group; a null key is greater than every
    other, so a row without a key stays only if all of its group are without;
    very long texts are compared whole; other columns are not read, whatever
    their names; an empty table gives an empty one.  Keys may be of any type
    with an order.
    """
    rows = settle(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), {
        "norm": normalise(F.col("text")), "size": F.coalesce(F.length("text"), F.lit(0)).cast("long")}).drop("text")
    rows = rows.withColumn("lead", F.substring("norm", 1, LEAD)).withColumn("hash", F.xxhash64("norm"))
    rank = [F.desc("size"), F.asc_nulls_last("key")]
    dealt = rows.repartitionByRange("lead", "hash", *rank).sortWithinPartitions("lead", "hash", "norm", *rank)
    kind = rows.schema["key"].dataType.simpleString()
    told = dealt.select("key", "norm", "size", "lead", "hash").mapInArrow(
        _told(None), f"key {kind}, head {kind}, n long, sha string, first boolean, edge long, size long, norm string")
    told = cut(told, "content-sort")
    ends = told.where("norm IS NOT NULL").select("edge", "norm", "n", "size", F.col("head").alias("head"))
    best = F.struct(-F.col("size"), F.col("head").isNull(), F.col("head"), F.col("edge"))
    whole = ends.groupBy("norm").agg(F.sum("n").alias("all"), F.min(best).alias("best"))
    whole = ends.join(whole, "norm").select("edge", "all", F.col("best.head").alias("keep"), (F.col("edge") == F.col("best.edge")).alias("leads"))
    # Edges are a few for each partition of the sort, and bear no text here.
    out = told.drop("norm", "size").join(F.broadcast(whole), "edge", "left")
    inner = F.col("edge").isNull()
    return out.select(
        F.col("key").alias(key), F.when(inner, F.col("head")).otherwise(F.col("keep")).alias("keep_id"), F.when(inner, F.col("n")).otherwise(F.col("all")).alias("group_size"),
        (F.col("first") & (inner | F.col("leads"))).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows are found again by their key, length and content's hash; of rows equal in
    all three, which differ in white space or other columns at most, the first in
    the order of their JSON stays.
    """
    at, size = free_name(df.columns, "_sha"), free_name([*df.columns, "_sha"], "_size")
    kept = exact_groups(df, key, text).where("kept").select(F.col(f"`{key}`").alias(f"{at}_key"), F.col("text_sha256").alias(at))
    marked = df.withColumn(at, F.sha2(normalise(F.col(f"`{text}`")).cast("binary"), 256)).withColumn(size, F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)))
    left = marked.join(kept.withColumnRenamed(at, f"{at}2"), (F.col(at) == F.col(f"{at}2")) & F.col(f"`{key}`").eqNullSafe(F.col(f"{at}_key")), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return left.groupBy(f"`{key}`", at).agg(F.min_by(whole, F.struct(-F.col(size), F.to_json(whole))).alias("row")).select("row.*")


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents; null, empty, long and repeated texts as ``exact_groups`` says."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm)::BIGINT AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id NULLS LAST)
"""
