"""The lexical index: the same scores as the plain search, and blocks that need not be read."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import lexical as L
from corpusmill.operators import retrieval as R


def expected(spark, docs, queries, k):
    s = R.bm25(docs, queries).withColumn("rounded", F.round("bm25", 6))
    return {(r.qid, r["rank"]): (r.doc_id, round(r.bm25, 6)) for r in R.top(s, k, "rounded").collect()}


def found(out, k):
    return {(r.qid, r["rank"]): (r.doc_id, round(r.bm25, 6)) for r in L.best(out, k).collect()}


def same(a, b):
    assert set(a) == set(b)
    for x in a:
        assert a[x][0] == b[x][0] and a[x][1] == pytest.approx(b[x][1], abs=2e-6), x


@pytest.fixture(scope="module")
def texts(spark):
    """Documents of topics: those of one share rare words, all share common ones; copies, empty and null texts."""
    random.seed(4)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(3000):
        topic = i // 10
        rows.append((i, " ".join(random.choices(common, k=60) + [f"t{topic}w{random.randint(0, 30)}" for _ in range(40)])))
    rows += [(5000 + i, rows[7][1]) for i in range(20)] + [(6000, ""), (6001, None), (None, "c1 c2"), (6002, "c1 c1 c1")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()


def test_same_as_the_plain_search_and_few_blocks_read(spark, texts):
    q = texts.where("doc_id % 100 = 7").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))
    out = L.search(L.build(texts), q, 5)
    same(found(out, 5), expected(spark, texts.where("doc_id IS NOT NULL"), q, 5))
    read, blocks = out.where("doc_id IS NULL").agg(F.sum("read"), F.sum("blocks")).first()
    assert 0 < read < 0.25 * blocks


@pytest.mark.parametrize("k, block_bytes, docs", [(1, 300, 64), (40, 4000, 7), (4000, 1 << 24, 1024)])
def test_any_blocks_segments_and_k(spark, texts, monkeypatch, k, block_bytes, docs):
    monkeypatch.setattr(L, "SEGMENT_DOCS", docs)
    some = texts.where("doc_id < 400 OR doc_id >= 5000")
    asked = [(1, "c1 t3w1 t3w1 absent"), (2, ""), (3, "c1 c2 c3 c4 t9w2"), (4, "nothing here"), (5, None), (6, "C1 t0w5 " + " ".join(f"t{i}w3" for i in range(40)))]
    q = spark.createDataFrame(asked, "qid long, query string")
    same(found(L.search(L.build(some), q, k, block_bytes=block_bytes), k), expected(spark, some, q, k))


def test_wanted_documents_are_scored(spark, texts):
    some = texts.where("doc_id < 300").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    q = spark.createDataFrame([("q", "c1 c2 t3w1", ["d5", "d31", "d299", "dx"])], "qid string, query string, near array<string>")
    out = L.search(L.build(some), q, 2, wanted="near")
    every = {r.doc_id: r.bm25 for r in R.bm25(some, q).collect()}
    got = {r.doc_id: r.bm25 for r in out.where("wanted").collect()}
    assert set(got) == {d for d in ("d5", "d31", "d299") if d in every} and all(got[d] == pytest.approx(every[d]) for d in got)


def test_segments_may_be_appended(spark, texts):
    a, b = texts.where("doc_id % 2 = 0 AND doc_id < 600"), texts.where("doc_id % 2 = 1 AND doc_id < 600")
    (s1, t1), (s2, t2) = L.build(a), L.build(b)
    index = s1.union(s2), t1.union(t2).groupBy("term").agg(F.sum("df").alias("df"))
    q = spark.createDataFrame([(1, "c1 t3w1 t4w2"), (2, "t5w5 c9")], "qid long, query string")
    same(found(L.search(index, q, 9), 9), expected(spark, a.union(b), q, 9))


def test_empty_tables(spark, texts):
    q = spark.createDataFrame([(1, "c1")], "qid long, query string")
    assert L.search(L.build(texts.where("doc_id < 0")), q, 3).count() == 0
    assert L.search(L.build(texts.where("doc_id < 9")), q.where("qid < 0"), 3).count() == 0


def test_segments_without_a_better_document_are_passed_over(spark, texts, monkeypatch):
    """A query is held against the segments that may hold a better document than is known, or a wanted one, alone."""
    import pyarrow as pa

    monkeypatch.setattr(L, "SEGMENT_DOCS", 30)
    segments, _ = L.build(texts.where("doc_id IS NOT NULL").coalesce(1).sortWithinPartitions("doc_id"))
    batches, calls = segments.drop("texts", "words", "df").toArrow().to_batches(), []
    search = L._Segment.search
    monkeypatch.setattr(L._Segment, "search", lambda self, *a: calls.append(1) or search(self, *a))
    queries = [{"qid": t, "terms": [f"t{t}w{i}" for i in range(9)] + ["c1"], "weights": [6.0] * 9 + [0.1], "least": 5.0, "wanted": [17]} for t in range(0, 300, 10)]

    class Sent:
        value = L._asked(queries, None)

    out = [r for b in L._task(Sent, 3, 100.0, (pa.int64(), pa.int64()))(batches) for r in b.to_pylist()]
    assert {r["qid"] for r in out if r["wanted"]} == set(range(0, 300, 10)) and {r["qid"] for r in out if r["wanted"] is False} == set(range(0, 300, 10))
    assert len(segments.collect()) >= 100 and len(calls) <= 11 * len(queries)  # of ten documents of a topic, and the wanted one


@pytest.mark.parametrize("abreast, dense, terms, postings", [(256, 64, 4096, 1 << 20), (7, 2, 5, 50)])
def test_where_little_is_spared_queries_are_scored_in_one_pass(spark, monkeypatch, abreast, dense, terms, postings):
    """Whole documents without topics as queries, with wanted ones, copies and empty texts: each goes to the tasks once, and not in three passes."""
    for name, value in (("SEGMENT_DOCS", 64), ("ABREAST", abreast), ("DENSE", dense), ("DENSE_TERMS", terms), ("POSTINGS", postings)):
        monkeypatch.setattr(L, name, value)
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(random.choices(words, range(400, 0, -1), k=random.randint(1, 90)))) for i in range(500)]
    docs = spark.createDataFrame([*rows, *[(600 + i, rows[9][1]) for i in range(20)], (700, ""), (701, None)], "doc_id long, text string").repartition(4)
    q = docs.where("doc_id % 4 = 1 OR doc_id >= 700").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"), F.expr("array(doc_id, 605, 700)").alias("near"))
    sent, asked = [], L._asked
    monkeypatch.setattr(L, "_asked", lambda queries, heaviest: sent.append(len(queries)) or asked(queries, heaviest))
    out = L.search(L.build(docs), q, 5, wanted="near")
    want = expected(spark, docs, q, 5)
    same(found(out, 5), want)
    every = {(r.qid, r.doc_id): r.bm25 for r in R.bm25(docs, q).collect()}
    got = {(r.qid, r.doc_id): r.bm25 for r in out.where("wanted").collect()}
    assert set(got) == {x for x in every if x[1] in (x[0], 605)} and all(got[x] == pytest.approx(every[x]) for x in got)
    assert sum(sent) <= len({x[0] for x in want}) + 2 * L.TRIAL


def test_length_of_a_vector_is_taken_once(spark):
    """In time that grows with the numbers, not with their square."""
    import time

    wide = spark.range(200).select("id", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: (i + F.col("id")).cast("float")).alias("v")).localCheckpoint()
    start = time.monotonic()
    sums = wide.select(R.dot(R.unit(F.col("v")), R.unit(F.col("v"))).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1) and time.monotonic() - start < 20
    odd = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, []), (3, [3.0, 4.0]), (4, [1.0, None])], "id int, v array<float>")
    assert [r.u for r in odd.select("id", R.unit(F.col("v")).alias("u")).orderBy("id").collect()] == [[0.0, 0.0], None, [], [0.6, 0.8], [None, None]]
