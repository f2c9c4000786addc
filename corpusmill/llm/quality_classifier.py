"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown by boosting on a bounded sample of labelled rows; each
path from the root to a node is a conjunctive rule.  A logistic model with an
absolute penalty on its weights (lasso, by accelerated proximal gradient)
keeps few of them.  The kept rules and weights are compiled into one column
expression, so scoring is a projection in the scan's stage: no shuffle, no
user function, every row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.quality_rules import STOP_WORDS, SYMBOLS
from corpusmill.llm.text import free_name, ratio, settle, words

#: The statistics that rules are made of.
STATISTICS = ("n_words", "mean_word_chars", "symbol_ratio", "stop_word_ratio", "distinct_ratio", "dup_line_ratio", "upper_ratio", "digit_ratio", "words_per_line", "bare_ratio")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one double column for each of ``STATISTICS``; all 0 for null and empty texts."""
    w, lines, value = free_name(df.columns, "_words"), free_name(df.columns, "_lines"), free_name(df.columns, "_value")
    df = df.withColumn(value, F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(w, words(F.col(f"`{text}`")))
    df = df.withColumn(lines, F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(w)
    kept = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    chars = F.length(F.array_join(w, ""))
    return settle(df, {
        "n_words": n.cast("double"),
        "mean_word_chars": ratio(chars, n),
        "symbol_ratio": ratio(kept("[^" + SYMBOLS + "]+"), n),
        "stop_word_ratio": ratio(F.size(F.filter(w, lambda x: x.isin(*dict.fromkeys(STOP_WORDS)))), n),
        "distinct_ratio": ratio(F.size(F.array_distinct(w)), n),
        "dup_line_ratio": ratio(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "upper_ratio": ratio(kept("[^A-Z]+"), chars),
        "digit_ratio": ratio(kept("[^0-9]+"), chars),
        "words_per_line": ratio(n, F.size(lines)),
        "bare_ratio": ratio(F.size(F.filter(w, lambda x: ~x.rlike("[A-Za-z0-9\\x80-\\x{10FFFF}]"))), n),
    }).drop(w, lines, value)


@dataclass(frozen=True)
class Condition:
    """``statistic <= bound`` or, if not ``below``, ``statistic > bound``."""

    statistic: str
    below: bool
    bound: float


@dataclass
class RuleEnsemble:
    """Rules with weights, and the intercept."""

    rules: list = field(default_factory=list)
    intercept: float = 0.0

    def column(self) -> Column:
        """The score, between 0 and 1."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & ((F.col(c.statistic) <= c.bound) if c.below else (F.col(c.statistic) > c.bound))
            total = total + F.when(test, float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _tree(x, grad, hess, depth, least, path=()):
    """Rules of a tree fitted to gradients; also adds its step to each row."""
    step = np.zeros(len(x))
    rules = [path] if path else []
    total_g, total_h = grad.sum(), hess.sum()
    best = (1e-6, None, None)
    if depth and len(x) >= 2 * least:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, h = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
            ok = np.flatnonzero(v[1:] > v[:-1])
            ok = ok[(ok + 1 >= least) & (len(v) - ok - 1 >= least)]
            if len(ok):
                gain = g[ok] ** 2 / (h[ok] + 1) + (total_g - g[ok]) ** 2 / (total_h - h[ok] + 1) - total_g**2 / (total_h + 1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], f, float((v[ok[i]] + v[ok[i] + 1]) / 2))
    if best[1] is None:
        return rules, step + total_g / (total_h + 1)
    left = x[:, best[1]] <= best[2]
    for side, below in ((left, True), (~left, False)):
        more, step[side] = _tree(x[side], grad[side], hess[side], depth - 1, least, (*path, Condition(STATISTICS[best[1]], below, best[2])))
        rules += more
    return rules, step


def _lasso(matrix, y, penalty, rounds=1500):
    """Weights and intercept of a logistic model with an absolute penalty on the weights."""
    n, d = matrix.shape
    z = np.hstack([matrix, np.ones((n, 1))])
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1e-9)
    w = look = np.zeros(d + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ look, -30, 30)))
        new = look - step * (z.T @ (p - y)) / n
        new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * penalty, 0)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look = new + (last - 1) / t * (new - w)
        w = new
    return w[:d], float(w[d])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, least: int = 8, penalty: float = 0.0005, rate: float = 0.3) -> RuleEnsemble:
    """The ensemble of rows of statistics and labels 0 or 1."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    total = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        found, step = _tree(x, y - p, p * (1 - p), depth, least)
        rules |= dict.fromkeys(found)
        total += rate * step
    place = {s: i for i, s in enumerate(STATISTICS)}
    hold = lambda c: x[:, place[c.statistic]] <= c.bound if c.below else x[:, place[c.statistic]] > c.bound
    matrix = np.array([np.logical_and.reduce([hold(c) for c in r]) for r in rules], float).T
    weights, intercept = _lasso(matrix, y.astype(float), penalty)
    return RuleEnsemble([(r, w) for r, w in zip(rules, weights, strict=True) if w], intercept)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled rows, those of the smallest hash of ``key``.

    ``max_rows`` bounds what reaches the driver and what is broadcast.  Labels
    that are null or other than 0 and 1, and labels of unknown rows, are not
    used; a label that repeats counts once, and of rows that repeat a labelled
    key the one with the smallest statistics.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key", "_label").limit(max_rows)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_key")
    each = statistics(rows, "_text").groupBy("_key", "_label").agg(F.min(F.struct(*STATISTICS)).alias("x"))
    data = each.select("_key", "_label", "x.*").toPandas().sort_values(["_key", "_label"])
    return fit(data[list(STATISTICS)].to_numpy(float), data["_label"].to_numpy(int))


def classify(df: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with its statistics, ``score`` (double) and ``predicted`` (int).

    Defined results: null text counts as empty, and all statistics of an empty
    text are 0, which the rules score like any other row; other columns stay,
    those that bear a name of the result are replaced; repeated rows get equal
    scores; an empty table gives an empty one.
    """
    scored = settle(statistics(df, text), {"score": model.column()})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The contract's scores of all documents, learned from rows that aren't held out.

    A null or empty text is scored as one without words; very long
    texts are measured whole; equal texts have equal scores, repeated rows each; a
    row without a key is not held out, and teaches nothing; an empty table gives an
    empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out)
    return classify(docs, train(docs, labels)).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
