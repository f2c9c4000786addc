"""Quantiles of brackets against all values; the bundle of answers and hits against plain code."""

import math
import random

import numpy as np
import pytest

from corpusmill import catalog
from corpusmill.operators import evaluation as E
from corpusmill.operators.quantiles import quantiles


@pytest.mark.parametrize("most", [60, 100_000])
def test_quantiles_of_any_bracket(spark, most):
    random.seed(6)
    rows = [("even", float(i)) for i in range(3000)] + [("ties", float(random.choice([1, 1, 1, 2, 5]))) for _ in range(2000)]
    rows += [("wide", random.lognormvariate(0, 9)) for _ in range(4000)] + [("few", x) for x in (3.0, None, -1.0)] + [(None, 7.5), ("none", None), ("two", 1.0), ("two", 2.0), ("same", 4.0)] + [("same", 4.0)] * 999
    shares = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {(r.g, r.share): r.quantile for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", shares, most).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g, _ in rows}
    assert set(got) == {(g, s) for g, v in groups.items() if v for s in shares}
    for (g, s), q in got.items():
        assert q == pytest.approx(float(np.quantile(groups[g], s)), rel=1e-12), (g, s)


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).count() == 0


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_bundle_of_answers(spark, sf):
    got = {r.metric: r.value for r in catalog.queries()["rag_evaluation_longest"](spark, sf).collect()}
    short = {r.metric: r.value for r in catalog.queries()["rag_evaluation"](spark, sf).collect()}
    assert set(got) - set(short) == {"rouge_l_p", "rouge_l_r", "rouge_l_f"} and all(got[m] == v for m, v in short.items())
    from corpusmill.plans.evaluation import generated

    pairs = [(lcs(r.g, r.t), len(r.g), len(r.t)) for r in generated(spark, sf).collect()]
    mean = lambda f: sum(f(*p) if p[0] else 0.0 for p in pairs) / len(pairs)
    assert got["rouge_l_p"] == pytest.approx(mean(lambda h, g, t: h / g), abs=2e-6) and got["rouge_l_r"] == pytest.approx(mean(lambda h, g, t: h / t), abs=2e-6)
    assert got["rouge_l_f"] == pytest.approx(mean(lambda h, g, t: 2 * h / (g + t)), abs=2e-6)


def test_ranked_relevance_with_grades(spark):
    labels = {"a": [0, 2, 1, 0], "b": [0, 0], "c": [3]}
    hits = spark.createDataFrame([(q, i + 1, x) for q, v in labels.items() for i, x in enumerate(v)], "qid string, rank int, label int")
    got = E.ranked_relevance(hits, (1, 3)).first()
    gain = lambda v, k: sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(v[:k]))
    for k in (1, 3):
        ndcg = [gain(v, k) / gain(sorted(v)[::-1], k) if any(v) else 0.0 for v in labels.values()]
        assert got[f"ndcg_{k}"] == pytest.approx(sum(ndcg) / 3)
        assert got[f"p_{k}"] == pytest.approx(sum(sum(x > 0 for x in v[:k]) / k for v in labels.values()) / 3)
        assert got[f"r_{k}"] == pytest.approx(sum(sum(x > 0 for x in v[:k]) / max(1, sum(x > 0 for x in v)) for v in labels.values()) / 3)


def test_all_checks_of_a_model(spark, sf):
    q = catalog.queries()
    got = {r["name"]: r for r in q["model_grade_checks"](spark, sf).collect()}
    bundle = {r.metric: r.value for r in q["rag_evaluation_longest"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/labels.parquet").collect()
    share = lambda f: sum(map(f, rows)) / len(rows)
    want = {
        "perplexity": (q["perplexity_summary"](spark, sf).first()["mean"], 30.0, True), "rouge_l": (bundle["rouge_l_f"], 0.3, False),
        "overreach": (share(lambda r: r.toxic == 1), 0.1, True), "hallucination": (share(lambda r: r.quality == 0), 0.1, True),
        "red_flag_omission": (share(lambda r: r.toxic == 1 and r.quality == 0), 0.05, True), "prescription": (share(lambda r: r.toxic == 1 and r.quality == 1), 0.05, True)}
    assert set(got) == {*want, "overall"}
    for name, (value, bound, low) in want.items():
        assert got[name].value == pytest.approx(value, abs=2e-6) and got[name].bound == bound and got[name].passed == (value <= bound if low else value >= bound)
    mean = 1 + 4 * share(lambda r: r.quality)
    level = "EXCELLENT" if mean >= 4.5 else "GOOD" if mean >= 3.5 else "ACCEPTABLE" if mean >= 2.5 else "POOR"
    assert got["overall"].value == pytest.approx(mean, abs=2e-6) and got["overall"].grade == (level if all(got[n].passed for n in want) else "FAIL")


def test_overlaps_are_counted_in_rows(spark, monkeypatch):
    """Any tokens, lengths and pieces; rows of one key are matched together; no n-gram is a row of a shuffle."""
    from collections import Counter

    rng = random.Random(8)
    side = lambda: None if rng.random() < 0.1 else [rng.choice("abcdé") for _ in range(rng.randint(0, 30))]
    rows = [(i, side(), side()) for i in range(200)] + [(7, side(), side()), (7, ["a"] * 9, ["a"] * 5), (300, [], []), (301, ["b"] * 3000, ["b"] * 2000), (None, ["a"], ["a"])]
    df = spark.createDataFrame(rows, "id long, g array<string>, t array<string>").repartition(3)
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w or []) - n + 1))
    for piece in (200, 1 << 20):
        whole = E._row_overlaps
        monkeypatch.setattr(E, "_row_overlaps", lambda most, p=piece, whole=whole: whole(most, p))
        got = E.overlaps(df, "id", "g", "t", 4).collect()
        monkeypatch.setattr(E, "_row_overlaps", whole)
        assert len(got) == len(rows)
        for r in got:
            for n in range(1, 5):
                own = [(grams(g, n), grams(t, n)) for i, g, t in rows if i == r.id]
                a, b = (sum((x[j] for x in own), Counter()) for j in (0, 1))
                assert r.hits[n - 1] == (0 if r.id is None else sum((a & b).values())), (r.id, n)
    many = spark.createDataFrame([(0, [f"w{i}" for i in range(5000)], [f"w{i}" for i in range(1, 5001)])], "id long, g array<string>, t array<string>")
    assert E.overlaps(many, "id", "g", "t", 9).first().hits == [4999 - n for n in range(9)]  # more tokens than numbers of n-grams have room for


def test_overlaps_send_no_ngrams(spark):
    """The plan has no shuffle of n-grams: the rows of one key each are met where they lie."""
    df = spark.range(10).selectExpr("id", "split('a b c', ' ') g", "split('b c d', ' ') t")
    plan = E.overlap(df, "id", "g", "t", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
