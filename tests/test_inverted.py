"""The stored inverted-file index on vectors of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import inverted as I
from corpusmill.operators.retrieval import nearest


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(y) for y in x]) for i, x in enumerate(v)], "doc_id long, embedding array<double>").repartition(6)


def queries(d):
    return d.where("doc_id % 100 = 0").selectExpr("doc_id AS qid", "embedding AS vector")


def pairs(df):
    return {(r.qid, r.doc_id) for r in df.collect()}


@pytest.fixture(scope="module")
def clusters(spark):
    """12,000 vectors around 150 places."""
    rng = np.random.default_rng(2)
    places = rng.normal(size=(150, 16))
    v = places[rng.integers(0, 150, 12_000)] + 0.25 * rng.normal(size=(12_000, 16))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_a_tenth_of_the_lists_finds_nine_in_ten(spark, clusters):
    d = table(spark, clusters)
    path = I.build(d, nlist=120)
    q = queries(d)
    true = pairs(nearest(d, q, 5))
    assert len(I.centres_of(spark, path)) == 120 and len(true) == 600
    found = I.search(spark, path, q, 5, 12)
    assert len(pairs(found) & true) >= 0.9 * len(true) and found.groupBy("qid").count().where("count <> 5").isEmpty()
    assert pairs(I.search(spark, path, q, 5, 1, exact=True)) == true and pairs(I.search(spark, path, q, 5, 120)) == true
    assert I.calibrate(spark, path, d, 5, 0.9) <= 12


def test_all_rows_are_stored_by_list_and_more_may_be_appended(spark, clusters):
    a, b = table(spark, clusters[:1500]), table(spark, clusters[1500:2500], 1500)
    path = I.build(a, nlist=50)
    I.append(spark, path, b)
    stored = spark.read.parquet(f"{path}/vectors")
    assert stored.selectExpr("explode(ids) AS id").distinct().count() == 2500 and "list" in stored.columns
    one = stored.where("list = 3")
    assert "PartitionFilters: [isnotnull(list" in one._jdf.queryExecution().toString()
    every = a.union(b)
    q = queries(every)
    assert pairs(I.search(spark, path, q, 3, 4, exact=True)) == pairs(nearest(every, q, 3))


def test_one_place_of_very_many_vectors_and_ties(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([np.tile([1.0, 0, 0, 0], (3000, 1)), rng.normal(size=(500, 4))])
    d = table(spark, v)
    path = I.build(d, nlist=20)
    got = {(r.qid, r["rank"]): r.doc_id for r in I.search(spark, path, d.where("doc_id < 2").selectExpr("doc_id AS qid", "embedding AS vector"), 4, 2, exact=True).collect()}
    want = {(r.qid, r["rank"]): r.doc_id for r in nearest(d, d.where("doc_id < 2").selectExpr("doc_id AS qid", "embedding AS vector"), 4).collect()}
    assert got == want


def test_empty_and_null(spark):
    d = spark.createDataFrame([(None, [1.0]), (1, None)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0])], "qid long, vector array<double>")
    assert I.search(spark, I.build(d), q, 3, 2).count() == 0
    one = spark.createDataFrame([(1, [1.0]), (2, [3.0])], "doc_id long, embedding array<double>")
    assert [(r.doc_id, r["rank"]) for r in I.search(spark, I.build(one), q, 3, 2).collect()] == [(2, 1), (1, 2)]


def test_sample_is_fitted_by_all_cores(spark, monkeypatch):
    """A sample of a larger table, which a limit brings into one partition, and a table of one partition."""
    from pyspark.ml.clustering import KMeans

    parts, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    docs = spark.range(0, 900, 1, 1).select(F.col("id").alias("doc_id"), F.array(*[F.sin(F.col("id") * i).cast("float") for i in range(1, 5)]).alias("embedding"))
    for sample in (300, 100_000):
        I.build(docs, nlist=5, sample=sample)
    assert min(parts) >= spark.sparkContext.defaultParallelism and len(parts) == 2
