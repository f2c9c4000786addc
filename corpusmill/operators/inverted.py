"""A stored inverted-file index of vectors.

``build`` writes two tables: centres, and vectors in packed blocks partitioned by
the list (cluster) that they are nearest to.  Centres are fitted on a bounded
sample; every vector is indexed, also those appended later.  ``search`` reads
the probed lists alone, by partition pruning; a task multiplies a packed block
with the block of queries that probe its list, and sends k rows for each query.
``calibrate`` measures on queries of its own how many lists have to be probed
for a wanted share of the true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.retrieval import nearest, top
from corpusmill.storage import cut, discard, new_path

#: Vectors of a packed block, and of a block of queries that probe a list.
BLOCK, QUERY_BLOCK = 512, 128


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float) if len(column) else np.empty((0, 0))


def _packed(key: str, size: int, vector: str = "vector"):
    """Rows ``(list, key, vector)``, sorted by list, as blocks ``(ids, numbers, list)`` of one list each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("list").to_numpy()
            if not len(lists):
                continue
            cuts = np.append(np.flatnonzero(np.diff(lists, prepend=lists[0] - 1)), len(lists))
            ids, numbers, of = [], [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                for at in range(int(a), int(b), size):
                    n = min(size, int(b) - at)
                    ids.append(batch.column(key).slice(at, n))
                    numbers.append(_vectors(batch.column(vector).slice(at, n)).astype("<f8").tobytes())
                    of.append(int(lists[a]))
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.concat_arrays(ids)), pa.array(numbers, pa.binary()), pa.array(of, pa.int32())], names=["ids", "numbers", "list"])

    return run


def _nearest_lists(centres: np.ndarray, n: int):
    """Rows ``(id, vector)`` to the ``n`` lists whose centres are nearest to each."""
    norms = (centres**2).sum(1) / 2

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                far = norms - _vectors(batch.column(1)) @ centres.T
                lists = np.argsort(far, axis=1, kind="stable")[:, :n] if n > 1 else far.argmin(1)[:, None]
                yield _dealt(batch, np.repeat(np.arange(batch.num_rows), lists.shape[1]), lists.ravel())

    return run


def _possible_lists(centres: np.ndarray, radii: np.ndarray, n: int):
    """Rows ``(id, vector, least)`` to all lists but the ``n`` nearest that may hold a vector whose product is not below ``least``."""
    norms = (centres**2).sum(1) / 2

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                q, least = _vectors(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
                inner = q @ centres.T
                open_ = inner + np.sqrt((q**2).sum(1))[:, None] * radii >= least[:, None] - 1e-9
                np.put_along_axis(open_, np.argsort(norms - inner, axis=1, kind="stable")[:, :n], False, 1)
                rows, lists = np.nonzero(open_)
                yield _dealt(batch, rows, lists)

    return run


def _dealt(batch: pa.RecordBatch, rows: np.ndarray, lists: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *[batch.column(i).take(pa.array(rows)) for i in range(2)]], names=["list", "id", "vector"])


def _lists(rows: DataFrame, deal) -> DataFrame:
    """``(list, id, vector)`` from rows ``(id, vector)``."""
    return rows.mapInArrow(deal, f"list int, id {rows.schema['id'].dataType.simpleString()}, vector array<double>")


def build(docs: DataFrame, path: str | None = None, nlist: int = 1024, key: str = "doc_id", vector: str = "embedding", seed: int = 42, sample: int = 100_000) -> str:
    """The folder of a new index of ``docs``: ``nlist`` lists at most, a tenth of the rows.

    Centres are fitted on at most ``sample`` rows; all rows are indexed but those
    without a key or vector.  An empty table gives an index without lists.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = docs.sparkSession
    path = path or new_path(spark, "index")
    rows = docs.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    n = rows.count()
    cores = spark.sparkContext.defaultParallelism
    some = rows if n <= sample else rows.orderBy(F.xxhash64("id")).limit(sample)
    if n > sample or rows.rdd.getNumPartitions() < cores:  # a limit leaves one partition, and the fit would be one task
        some = cut(some.repartition(cores, "id"), "sample")
    size, centres = min(nlist, n // 10), []
    if n and size < 2:  # one list around the mean
        centres = [np.array([r.a for r in rows.select(F.posexplode("vector")).groupBy("pos").agg(F.avg("col").alias("a")).orderBy("pos").collect()])]
    elif n:
        made = some.select(array_to_vector("vector").alias("v"))
        centres = KMeans(k=size, seed=seed, featuresCol="v", maxIter=8).fit(made).clusterCenters()
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>").write.parquet(f"{path}/centres")
    if n:
        append(spark, path, docs, key, vector)
    return path


def append(spark: SparkSession, path: str, docs: DataFrame, key: str = "doc_id", vector: str = "embedding") -> None:
    """Add rows to the index; its centres stay.  Adaptive execution splits lists that hold very many rows."""
    rows = docs.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    centres = centres_of(spark, path)
    told = _lists(rows, _nearest_lists(centres, 1)).hint("rebalance", F.col("list")).sortWithinPartitions("list")
    packed = cut(told.mapInArrow(_packed("id", BLOCK), f"ids array<{kind}>, numbers binary, list int"), "packed")
    packed.write.mode("append").partitionBy("list").parquet(f"{path}/vectors")
    far = packed.select("list", "numbers").mapInArrow(_radii(centres), "list int, radius double")
    far.groupBy("list").agg(F.max("radius").alias("radius")).write.mode("append").parquet(f"{path}/radii")
    discard(packed)


def _radii(centres: np.ndarray):
    """How far a packed block's vectors lie from the centre of their list."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0).to_pylist()
            far = [float(np.sqrt(((np.frombuffer(x.as_buffer(), "<f8").reshape(-1, centres.shape[1]) - centres[i]) ** 2).sum(1).max())) for i, x in zip(lists, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(far, pa.float64())], names=["list", "radius"])

    return run


def centres_of(spark: SparkSession, path: str) -> np.ndarray:
    """The centres, as many as ``nlist``."""
    return np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()], float)


def _multiplied(k: int):
    """Packed vectors against packed queries: ``k`` rows a query and block of vectors, fewer where a task has seen better ones."""

    def run(batches):
        seen: dict = {}
        for batch in batches:
            for ids, numbers, asked, against in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                ids, asked = ids.values, asked.values
                x = np.frombuffer(numbers.as_buffer(), "<f8").reshape(len(ids), -1)
                scores = np.frombuffer(against.as_buffer(), "<f8").reshape(len(asked), -1) @ x.T
                bound = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(asked), -np.inf)
                names = asked.to_pylist()
                bound = np.maximum(bound, [seen.get(q, -np.inf) for q in names])
                if len(ids) >= k:
                    seen.update(zip(names, bound.tolist(), strict=True))
                j, i = np.nonzero(scores >= bound[:, None])
                if len(j) > k:  # of equal products no more than k, those of the smallest ids
                    place = np.empty(len(ids), np.int64)
                    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                    order = np.lexsort((place[i], -scores[j, i], j))
                    j, i = j[order], i[order]
                    some = np.arange(len(j)) - np.searchsorted(j, j) < k
                    j, i = j[some], i[some]
                if len(j):
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(j)), ids.take(pa.array(i)), pa.array(scores[j, i])], names=["qid", "doc_id", "dense"])

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, nprobe: int, query: str = "vector", exact: bool = False) -> DataFrame:
    """``(qid, doc_id, dense, rank)``: the ``k`` best of the ``nprobe`` lists nearest to each query; ties by doc_id.

    With ``exact`` the k-th of them then bounds what is left: no vector of a list
    exceeds its centre's product by more than the query's length times the list's
    radius, and the lists that may hold a better one are read as well.  Queries are
    dealt to the lists that they probe and packed, at most ``QUERY_BLOCK`` of them
    against a packed block at a time.
    """
    centres = centres_of(spark, path)
    asked = queries.select(F.col("qid").alias("id"), F.col(query).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    kind = asked.schema["id"].dataType.simpleString()
    if not len(centres):
        return spark.createDataFrame([], f"qid {kind}, doc_id {kind}, dense double, rank int")
    stored = spark.read.parquet(f"{path}/vectors")
    types = f"qid {kind}, doc_id {stored.schema['ids'].dataType.elementType.simpleString()}, dense double"

    def probe(told: DataFrame) -> DataFrame:
        told = told.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list")
        blocks = cut(told.mapInArrow(_packed("id", QUERY_BLOCK), f"ids array<{kind}>, numbers binary, list int"), "probes")
        probed = [r[0] for r in blocks.select("list").distinct().collect()]  # no more than there are lists
        part = stored if len(probed) == len(centres) else stored.where(F.col("list").isin(probed)) if probed else stored.where("false")
        met = part.join(blocks.select("list", F.col("ids").alias("asked"), F.col("numbers").alias("against")), "list")
        return top(met.select("ids", "numbers", "asked", "against").mapInArrow(_multiplied(k), types), k, "dense")

    n = min(nprobe, len(centres))
    hits = probe(_lists(asked, _nearest_lists(centres, n)))
    if not exact or n == len(centres):
        return hits
    hits = cut(hits, "hits")
    least = hits.where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("dense").alias("least"))
    radii = np.zeros(len(centres))
    for r in spark.read.parquet(f"{path}/radii").groupBy("list").agg(F.max("radius").alias("radius")).collect():
        radii[r["list"]] = r.radius
    more = asked.join(least, "id", "left").select("id", "vector", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    return top(hits.drop("rank").union(probe(_lists(more, _possible_lists(centres, radii, n))).drop("rank")), k, "dense")


def calibrate(spark: SparkSession, path: str, docs: DataFrame, k: int, share: float = 0.95, queries: int = 200, key: str = "doc_id", vector: str = "embedding") -> int:
    """The least number of lists to probe that finds ``share`` of the true ``k`` neighbours.

    Measured on at most ``queries`` rows of ``docs``, taken by the hash of their
    key: each true neighbour asks for as many lists as come before its own.
    """
    centres = centres_of(spark, path)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(vector).cast("array<double>").alias("embedding")).where("doc_id IS NOT NULL AND embedding IS NOT NULL")
    asked = cut(rows.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(queries).select(F.col("doc_id").alias("qid"), F.col("embedding").alias("vector")), "calibration")
    true = nearest(rows, asked, k).select("qid", "doc_id").join(rows, "doc_id").join(asked, "qid").select("vector", "embedding").collect()
    discard(asked)
    if not true or not len(centres):
        return 1
    q, d = (np.array([r[i] for r in true], float) for i in (0, 1))
    norms = (centres**2).sum(1) / 2
    own, far = (norms - d @ centres.T).argmin(1), norms - q @ centres.T
    before = np.sort((far < far[np.arange(len(own)), own][:, None]).sum(1))
    return int(before[int(np.ceil(share * len(before))) - 1]) + 1
