"""The quality classifier as registered, on odd tables."""

import random
import zlib

from corpusmill.llm import catalog


def test_registered_query_on_odd_rows(spark, tmp_path):
    random.seed(2)
    good = lambda: "The house of the garden is " + " ".join(random.choice(["small", "old", "green", "near", "with", "and"]) for _ in range(40)) + "."
    bad = lambda: " ".join(random.choice(["###", "BUY", "now", "$$$"]) for _ in range(30))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)]
    marks = [(i, i % 2) for i in range(400)] + [(None, 1)]
    rows += [(None, good()), (None, None), (500, ""), (501, None), (502, good() * 3000), (7, rows[7][1])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = catalog.queries()["op10_quality_classifier"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    assert len({(r.score, r.predicted) for r in got if r.doc_id == 7}) == 1 and len({r.score for r in got if r.doc_id in (500, 501)}) == 1
