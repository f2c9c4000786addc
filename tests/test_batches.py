"""Batches in pieces: every row once, in order, and bounded bytes."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions.batches import pieces
from corpusmill.operators import evaluation, hooks
from corpusmill.operators import segmentation as G


def test_pieces_hold_bounded_bytes():
    texts = ["", None, "a" * 50, "é" * 30, "b" * 500, "c", None, "d" * 99, "e"]
    words = [["x"] * len(t or "") if t != "" else None for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(words, pa.list_(pa.string()))], names=["id", "text", "words"])
    for batch in (batch, batch.slice(2, 6), batch.slice(9)):
        for columns, most in ((("text",), 100), (("words",), 900), (("text", "words"), 1000)):
            got = list(pieces([batch], *columns, most=most))
            assert [x for b in got for x in b.to_pylist()] == batch.to_pylist()
            for b in got:
                size = sum(len((r["text"] or "").encode()) if c == "text" else 9 * len(r["words"] or []) for r in b.to_pylist() for c in columns)
                assert b.num_rows == 1 or size <= most


def test_segments_come_in_pieces(spark):
    """Rows beyond a piece are segmented like the others."""
    docs = spark.createDataFrame([(i, "abab" * 20_000) for i in range(12)], "doc_id long, text string").coalesce(1)
    words = spark.createDataFrame([("ab", 3), ("ba", 1)], "word string, n long")
    out = G.segment(docs, words, mode="full")
    assert [len(r.words) for r in out.orderBy("doc_id").collect()] == [2 * 40_000 - 1] * 12


def test_tokenizer_and_longest_common_in_pieces(spark):
    """Null, empty and long rows; lists of one batch are not held together."""
    texts = ["a b", None, "", "x " * 300_000, "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.n for r in docs.select("id", F.size(hooks.tokenizer(str.split)(F.col("text"))).alias("n")).collect()}
    assert got == {i: len((t or "").split()) for i, t in enumerate(texts)}
    pairs = [(0, ["a", "b"], ["b", "a"]), (1, None, ["a"]), (2, [], []), (3, ["q"] * 40_000, ["q"] * 10), (4, ["x"], ["x"])]
    found = evaluation.longest_common(spark.createDataFrame(pairs, "id long, g array<string>, t array<string>").coalesce(1), "id", "g", "t")
    assert {r.id: (r.hit, r.n_guess, r.n_truth) for r in found.collect()} == {0: (1, 2, 2), 1: (0, 0, 1), 2: (0, 0, 0), 3: (10, 40_000, 10), 4: (1, 1, 1)}


def test_calls_of_few_workers_come_in_waves(spark, monkeypatch):
    """Whatever the rows, a task gets no more than some; each row is called for once."""
    monkeypatch.setattr(hooks, "TASK_ROWS", 50)
    docs = spark.range(0, 1010, 1, 7).withColumnRenamed("id", "doc_id")
    size = lambda rows: [{"task": __import__("pyspark").TaskContext.get().taskAttemptId()} for _ in rows]
    got = hooks.call(docs, size, "task long", workers=2).collect()
    assert sorted(r.doc_id for r in got) == list(range(1010))
    sizes = Counter(r.task for r in got)
    assert max(sizes.values()) <= 60 and len(sizes) >= 20


def test_few_segments_in_a_file(spark, monkeypatch):
    """A file of the lexical index holds some segments, however many a task makes."""
    from corpusmill.operators import lexical

    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 10)
    segments, _ = lexical.build(spark.range(0, 1000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text")))
    files = segments.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) >= 100 and max(r["count"] for r in files) <= lexical.FILE_SEGMENTS
