"""Word segmentation against all paths, and texts whose spaces come back."""

import hashlib
import random

import pytest

from corpusmill import catalog
from corpusmill.operators import segmentation as G


def paths(run, known):
    """All ways to cut a run into words, with their scores."""
    if not run:
        yield 0.0, ()
    for end in range(1, len(run) + 1):
        w = run[:end]
        s = known.score.get(w, known.unknown if end == 1 else None)
        if s is not None:
            for rest, way in paths(run[end:], known):
                yield s + rest, (w, *way)


@pytest.mark.parametrize("seed", range(5))
def test_best_path_and_all_words(seed):
    random.seed(seed)
    letters = "abc中文"[: 2 + seed]
    counts = {"".join(random.choice(letters) for _ in range(random.randint(1, 5))): random.randint(1, 99) for _ in range(15)}
    known = G.Words(counts)
    for _ in range(120):
        run = "".join(random.choice(letters + "x") for _ in range(random.randint(1, 10)))
        got = known.cut(run, "precise")
        value = sum(known.score.get(w, known.unknown) for w in got)
        assert "".join(got) == run and value == pytest.approx(max(s for s, _ in paths(run, known)))
        inside = [run[i:j] for i in range(len(run)) for j in range(i + 2, len(run) + 1) if run[i:j] in counts]
        full = known.cut(run, "full")
        assert [w for w in full if len(w) > 1] == inside
        covered = {k for i in range(len(run)) for j in range(i + 2, len(run) + 1) if run[i:j] in counts for k in range(i, j)}
        assert sorted(w for w in full if len(w) == 1) == sorted(run[i] for i in range(len(run)) if i not in covered)
        search, at = known.cut(run, "search"), 0
        for w in got:
            short = [w[i : i + n] for n in (2, 3) if len(w) > n for i in range(len(w) - n + 1) if w[i : i + n] in counts]
            assert search[at : at + len(short) + 1] == [*short, w]
            at += len(short) + 1
        assert at == len(search)


@pytest.mark.parametrize("abreast", [1, 24, 10**9])
def test_runs_at_once_equal_runs_one_by_one(monkeypatch, abreast):
    """Many runs of one piece, ties, long ones and letters of several bytes: the words that the plain code finds, in its order."""
    monkeypatch.setattr(G, "ABREAST", abreast)
    for seed in range(6):
        random.seed(seed)
        letters = "abC中É𝒜İΣ"[: 2 + seed]
        counts = {"".join(random.choice(letters.lower()) for _ in range(random.randint(1, 6))): random.choice([1, 1, 2, 4, 99]) for _ in range(40)}
        known, lattice = G.Words(counts), G.Lattice(counts)
        runs = ["".join(random.choice(letters + "x") for _ in range(random.choice([1, 3, 10, 40, 700]))) for _ in range(60)]
        for mode in G.MODES:
            got = G._texts(runs, *lattice.cut(runs, mode)).to_pylist()
            assert got == [w for r in runs for w in known.cut(r, mode)]
    assert G.Lattice({}).cut(["ab"], "precise")[0].tolist() == [0, 1] and G._texts([], *lattice.cut([], "search")).to_pylist() == []


def test_a_piece_is_cut_at_once(spark, monkeypatch):
    """No run is cut by itself: that took most of the time of the three queries."""
    docs = spark.createDataFrame([(i, "heart rate. blood") for i in range(50)], "doc_id long, text string").coalesce(1)
    calls = []
    lattice = G.Lattice({"heart": 3, "rate": 2, "blood": 1})
    monkeypatch.setattr(G.Words, "cut", lambda *x: calls.append(x))
    assert [w for r in G.segment(docs, spark.createDataFrame([("heart", 3), ("rate", 2), ("blood", 1)], "word string, n long")).collect() for w in r.words] == ["heart", "rate", "blood"] * 50
    assert not calls and len(lattice.cut(["heartrate"] * 50, "precise")[0]) == 100


def test_spaces_come_back(spark):
    random.seed(1)
    words = ["heart", "rate", "pressure", "blood", "Éclair", "patient", "中药", "治疗", "the", "therapy"]
    texts = [" ".join(random.choice(words) for _ in range(40)) + "." for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (100, None), (101, ""), (102, " .,")], "doc_id long, text string").repartition(3)
    known = G.dictionary(docs)
    assert {r.word for r in known.collect()} == {w.lower() for w in words}
    joined = docs.selectExpr("doc_id", "replace(text, ' ', '') AS text", "1 AS words")
    got = {r.doc_id: r.words for r in G.segment(joined, known).collect()}
    assert all(got[i] == t.rstrip(".").split() for i, t in enumerate(texts)) and got[100] == got[101] == got[102] == []
    with pytest.raises(ValueError):
        G.segment(joined, known, most=3)
    with pytest.raises(ValueError):
        G.segment(joined, known, mode="other")
    assert G.segment(joined.where("doc_id < 0"), known).count() == 0 and G.segment(joined, known.where("false")).where("doc_id = 0").first().words[:5] == list(texts[0].replace(" ", "")[:5])


def test_registered_queries(spark, sf):
    """Whole documents: a row each, of the words that the plain code finds."""
    import re
    from collections import Counter

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(w for t in texts.values() for w in re.findall(r"\w+", t.lower()) if len(w) <= 24)
    known = G.Words(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:200_000]))
    for mode in G.MODES:
        got = {r.doc_id: (r.n_words, r.words) for r in catalog.queries()[f"segment_{mode}"](spark, sf).collect()}
        assert set(got) == set(texts)
        for i in sorted(texts)[:60]:
            want = [w for r in G.RUN.finditer(texts[i].replace(" ", "")) for w in known.cut(r.group(), mode)]
            assert got[i] == (len(want), hashlib.md5(" ".join(want).encode()).hexdigest())
