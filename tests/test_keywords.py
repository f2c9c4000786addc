"""Keywords by TF-IDF: what is shuffled, and rows that bounds alone do not settle."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import keywords as K


def expected(docs, k):
    n, of = len(docs), {}
    for key, words in docs:
        if words:
            of.setdefault((key, len(words)), Counter()).update(words)
    df = Counter(w for c in of.values() for w in c)
    best = {}
    for (key, size), c in of.items():
        best.setdefault(key, []).extend((-round(tf / size * math.log((n + 1) / (df[w] + 1)), 9), w) for w, tf in c.items())
    return {(key, i + 1): w for key, x in best.items() for i, (_, w) in enumerate(sorted(x)[:k])}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(3000)]
    rows = [(i, rng.choices(common, k=rng.randint(0, 60)) + rng.choices(rare, k=rng.randint(0, 9))) for i in range(600)]
    rows += [(700, []), (701, None), (702, ["c1"] * 5), (703, ["c1", "c2"]), (704, ["c2", "c1"])]
    return rows + [(705, ["r1", "c1", "r1"])] * 2 + [(706, ["r7"]), (706, ["r7", "c3"])]  # keys that repeat, of one length and of two


@pytest.mark.parametrize("known, piece", [(50_000, 1 << 22), (20, 1 << 22), (1, 300), (60, 2000)])
def test_same_as_plain_counts(spark, monkeypatch, docs, known, piece):
    monkeypatch.setattr(K, "KNOWN", known)
    monkeypatch.setattr(K, "PIECE", piece)
    got = K.tf_idf(spark.createDataFrame(docs, "id long, w array<string>").repartition(3), "id", "w", 3)
    assert {(r.id, r["rank"]): r.word for r in got.collect()} == expected(docs, 3)


def test_words_that_cannot_win_are_not_rows(spark):
    """A text of many frequent words sends its few rare ones."""
    known = spark.createDataFrame([(f"c{i}", 900 - i) for i in range(500)], "word string, n long").toArrow()
    docs = spark.range(40).select("id", F.lit(510).alias("_size"), F.concat(F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.concat(F.lit("c"), i)), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat_ws("-", F.lit("r"), "id", i))).alias("w"))
    sent = docs.mapInArrow(K._candidates(known, 1000, 3), "id long, _size int, word string, _tf long")
    assert {r.id: r.n for r in sent.where("word LIKE 'r-%'").groupBy("id").agg(F.count("*").alias("n")).collect()} == {i: 10 for i in range(40)}
    assert sent.count() == 400


def test_empty_table(spark):
    assert K.tf_idf(spark.createDataFrame([], "id long, w array<string>"), "id", "w", 3).collect() == []
