"""Operators for training data that once did a part of the job, over the whole of it."""

import random
from collections import Counter
from math import log

from corpusmill.llm import catalog, token_counts
from tests.llm.test_edges import JSON

QUERIES = catalog.queries()


def test_lm_scores_count_three_words(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: [w.decode("utf-8", "replace") for w in (r.text or "").encode().lower().split()] for r in rows}
    grams = {i: [Counter(tuple(w[j - k : j + 1]) for j in range(k, len(w))) for k in range(3)] for i, w in words.items()}
    total = [sum((g[k] for g in grams.values()), Counter()) for k in range(3)]
    want = {}
    for i, w in words.items():
        c = lambda x, g=grams[i]: total[len(x) - 1][x] - g[len(x) - 1][x]
        s, n, backed = 0.0, max(sum(total[0].values()) - len(w), 1), 0
        for j in range(len(w)):
            top = min(j, 2)
            k = next((k for k in range(top, 0, -1) if c(tuple(w[j - k : j + 1])) > 0), 0)
            s += (log(c(tuple(w[j - k : j + 1])) / c(tuple(w[j - k : j]))) if k else log(max(c((w[j],)), 0.5) / n)) + (top - k) * log(0.4)
            backed += k < top
        want[i] = (len(w), round(s / len(w), 4) if w else 0.0, backed)
    got = {r.doc_id: (r.n_words, round(r.lm_score, 4), r.n_backed_off) for r in QUERIES["op3_lm_scores"](spark, sf).collect()}
    assert {i: (x[0], x[2]) for i, x in got.items()} == {i: (x[0], x[2]) for i, x in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 2e-4 for i in want)


def test_token_counts_of_control_characters_that_are_no_white_space():
    from tokenizers import Tokenizer

    spec = open(JSON, encoding="utf-8").read()
    lib, own = Tokenizer.from_str(spec), token_counts.CountingTokenizer(spec, chunk=7)
    random.seed(3)
    pool = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\x0b", "\t", " ", "'s", "é", "½", "中", "B", "the", "12", "..."]
    texts = ["a\x1cb", "中\x1fb", *("".join(random.choice(pool) for _ in range(random.randint(0, 20))) for _ in range(2000))]
    assert [own.count(s) for s in texts] == [len(lib.encode(s, add_special_tokens=False).ids) for s in texts]
