"""Phrase collocations against plain counting; automata against all substrings."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import collocations as C


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def counts(rows, depth=3):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, depth + 1):
                f.update((lang, *p[i : i + k]) for i in range(len(p) - k + 1))
    return f, n


def plain(rows, least, top=2000, depth=3):
    f, n = counts(rows, depth)
    cands = {c: a for c, a in f.items() if 3 <= len(c) <= depth + 1 and a >= least}
    out = {}
    for (lang, *w), a in cands.items():
        if any(lg == lang and len(v) > len(w) and 2 * m >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (lg, *v), m in cands.items()):
            continue
        score, k = min((1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def got(df, **more):
    return sorted(map(tuple, C.collocations(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_all_substrings(seed):
    random.seed(seed)
    stream = [random.choice([1, 2, 3, 4, 5][: 2 + seed]) for _ in range(random.choice([1, 2, 30, 400]))]
    for context in (0, 1, 2) if len(stream) > 3 else (0,):
        a = C.Automaton(np.array(stream), context)
        want = Counter()
        for end in range(context, len(stream)):
            for k in (1, 2, 3):
                x = stream[max(0, end - k + 1) : end + 1]
                if len(x) == k and 1 not in x:
                    want[tuple(x)] += 1
        found = {}
        for k in (1, 2, 3):
            ids, n = a.phrases(k)
            found |= {tuple(int(x[i]) for x in ids): int(n[i]) for i in range(len(n))}
        assert found == want
        assert len(a.key) <= len(want) and all(1 <= s <= m for s, m in zip(a.shortest.tolist(), a.length.tolist(), strict=True))


def test_phrases_that_end_together_are_one_state():
    a = C.Automaton(np.array([2, 3, 4, 1, 2, 3, 4, 1, 5, 4]))
    told = {(int(k), int(s), int(m), int(c)) for k, s, m, c in zip(a.key, a.shortest, a.length, a.count, strict=True)}
    pack = lambda *w: sum(x << C.BITS * (2 - i) for i, x in enumerate(reversed(w)))
    assert told == {(pack(2, 3, 4), 2, 3, 2), (pack(2, 3), 1, 2, 2), (pack(2), 1, 1, 2), (pack(5, 4), 2, 2, 1), (pack(5), 1, 1, 1), (pack(4), 1, 1, 3)}


def odd_rows():
    random.seed(3)
    words = ["the", "The", "of", "é", "É", "中文", "a\x00b", "🙂", "new", "york", "city", "x-y", "it's"]
    rows = [(" ".join(random.choice(words) + random.choice(["", "", "", ".", ",\n", "\t", " \r "]) for _ in range(random.randint(0, 60))), random.choice(["en", "fr", None, "und", "a\tb", ""])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), (" .,;\n", "xx"), ("new york city " * 20, "zz"), ("new york city " * 20, "zz")] + rows[:20]


def test_odd_tables(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(t, x, 1, "p") for t, x in rows], "text string, lang string, n int, phrase string").repartition(5)
    assert got(df) == plain(rows, 10) and len(plain(rows, 10)) > 30
    assert got(df, least=2, top=7) == plain(rows, 2, 7)
    assert got(df, least=3, top=None, max_words=2) == plain(rows, 3, 10**9, 2)
    assert C.collocations(df.where("n = 2")).count() == 0
    with pytest.raises(ValueError):
        C.collocations(df, max_words=4)


def test_shards_and_blocks_of_any_size():
    """Texts cut into blocks and shards, also inside of pieces: sums over shards are the whole counts."""
    rows = [(t, x) for t, x in odd_rows()] + [("one two three " * 3000 + "two two", "en")]
    want, n = counts(rows)
    for words, size in ((50, 1 << 19), (1000, 64), (37, 16), (10**9, 1)):
        old, (C.SHARD_WORDS, C.BLOCK_BYTES) = (C.SHARD_WORDS, C.BLOCK_BYTES), (words, size)
        try:
            shard, found, total = C.Shard(), Counter(), Counter()
            made = [m for t, x in rows for m in shard.add("und" if x is None else x, t or "")] + [shard.full()]
        finally:
            C.SHARD_WORDS, C.BLOCK_BYTES = old
        assert len(made) > (1 if words > 10**6 else 10) - 1
        for a, names, langs in made:
            for k in (1, 2, 3):
                ids, m = a.phrases(k)
                for i in range(len(m)):
                    found[(langs[ids[0][i]], *(names[x[i]].decode() for x in ids))] += int(m[i])
                    total[langs[ids[0][i]]] += int(m[i]) * (k == 1)
        assert found == want and +total == +n


def test_many_small_shards_on_spark(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    wide = C.phrase_counts(df, least=4, parts=1).collect()
    assert sorted(wide) == sorted(C.phrase_counts(df, least=4, parts=300).collect())
    f, n = counts(rows)
    assert {(r.lang, r.phrase): r.n for r in wide if r.words} == {(x, " ".join(w)): m for (x, *w), m in f.items() if m >= 4}
    assert {r.lang: r.n for r in wide if not r.words} == {x: m for x, m in n.items() if m}


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000
    table = [("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 7), ("en", "", 0, 5 * big)]
    monkeypatch.setattr(C, "phrase_counts", lambda *a, **k: spark.createDataFrame(table, "lang string, phrase string, words int, n long"))
    df = spark.createDataFrame([], "text string, lang string")
    assert got(df) == [("en", 1, "a b", big, big + 1, big + 7, 5 * big, 1000000 * big * big // ((big + 1) * (big + 7)))]
