"""Queries that SQL cannot say, against plain Python over whole tables; readers and operators that no query reaches."""

import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import catalog
from corpusmill.operators import dedup
from corpusmill.sources import readers
from corpusmill.streaming import append

QUERIES = catalog.queries()


def rows(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_longest_common_subsequences(spark, sf):
    turns = {(r.conv_id, r.turn): r for r in rows(spark, sf, "conversations")}
    got = {n: {r.id: r.rouge_l for r in QUERIES[n](spark, sf).collect()} for n in ("rouge_l", "rouge_characters_l")}
    assert len(got["rouge_l"]) > 10
    for key in got["rouge_l"]:
        conv, turn = map(int, key.split("-"))
        nxt = min(t for c, t in turns if c == conv and t > turn)
        words = [turns[conv, t].text.split() for t in (turn, nxt)]
        for n, (g, t) in (("rouge_l", words), ("rouge_characters_l", [list("".join(w))[:] for w in words])):
            if len(g) * len(t) < 4_000_000:
                assert got[n][key] == pytest.approx(2 * lcs(g, t) / max(1, len(g) + len(t)), abs=2e-6), key


@pytest.fixture(scope="module")
def sets(spark, sf):
    return {r.doc_id: Counter(re.findall(r"\w+", r.text.lower())) for r in rows(spark, sf, "documents")}


def similar(a, b):
    i = len(set(a) & set(b))
    return i >= 0.8 * (len(a) + len(b) - i) - 1e-9


def test_greedy_and_component_rules(spark, sf, sets):
    compared = {i: set(w) for i, w in sets.items() if sum(w.values()) >= 3}
    kept, root = [], {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sorted(sets):
        if i in compared:
            for j in compared:
                if j < i and similar(compared[i], compared[j]):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        if i not in compared or not any(j in compared and similar(compared[i], compared[j]) for j in kept):
            kept.append(i)
    assert sorted(r.doc_id for r in QUERIES["near_dedup_greedy"](spark, sf).collect()) == kept
    assert sorted(r.doc_id for r in QUERIES["near_dedup_components"](spark, sf).collect()) == [i for i in sorted(sets) if find(i) == i]


def test_signatures_find_nine_in_ten_pairs(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(300):
        base = [f"w{x}" for x in rng.choice(10**6, 100, False)]
        swap = int(rng.integers(4, 12))  # similarities about 0.8 to 0.92
        data += [(2 * i, base), (2 * i + 1, [*base[swap:], *[f"v{i}_{j}" for j in range(swap)]])]
    df = spark.createDataFrame(data, "id long, w array<string>")
    pairs = lambda x: {(r.a, r.b) for r in x.collect()}
    exact, found = pairs(dedup.near_pairs(df, "id", "w", 0.8)), pairs(dedup.minhash_pairs(df, "id", "w", 0.8))
    assert len(exact) > 250 and found <= exact and len(found) >= 0.9 * len(exact)


def test_minhash_query(spark, sf):
    exact = {r.doc_id for r in QUERIES["near_dedup_greedy"](spark, sf).collect()}
    assert exact <= {r.doc_id for r in QUERIES["near_dedup_minhash"](spark, sf).collect()}


def segment(text):
    return re.findall(r"\w+", text.lower())


def test_hybrid_and_hypothetical_search(spark, sf):
    vectors = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in rows(spark, sf, "embeddings")}
    texts = {r.doc_id: r.text for r in rows(spark, sf, "documents") if r.doc_id in vectors}
    words = {i: Counter(segment(t)) for i, t in texts.items()}
    mean = sum(sum(w.values()) for w in words.values()) / len(words)
    df = Counter(x for w in words.values() for x in w)
    asked = [i for i in texts if i % 100 == 0]

    def lexical(q):
        out = {}
        for x, times in Counter(segment(texts[q])).items():
            idf = math.log((len(texts) - df[x] + 0.5) / (df[x] + 0.5) + 1)
            for i, w in words.items():
                if w[x]:
                    out[i] = out.get(i, 0.0) + times * idf * w[x] * 2.5 / (w[x] + 1.5 * (0.25 + 0.75 * sum(w.values()) / mean))
        return out

    def best(scores, k):
        return sorted(scores, key=lambda i: (-scores[i], i))[:k]

    def fused(q, dense, lex, candidates):
        span = max(dense.values()) - min(dense.values()) or 1.0
        most, low, out = max(lex.values(), default=0.0) or 1.0, min(dense.values()), []
        for i in candidates:
            d, norm, x = dense.get(i, 0.0), (dense[i] - low) / span if i in dense else 0.0, lex.get(i, 0.0) / most
            if not (d < 0.35 and x < 0.1):
                out.append((-round(0.7 * norm + 0.3 * x, 4), -norm, i))
        titles, kept = [], []
        for score, _, i in sorted(out):
            t = set(texts[i][:30])
            if not any(len(t & s) / len(t | s) >= 0.85 for s in titles):
                titles.append(t)
                kept.append((i, -score))
        return kept[:5]

    got = {n: {} for n in ("hybrid_search", "hyde_search")}
    for n in got:
        for r in sorted(QUERIES[n](spark, sf).collect(), key=lambda r: (r.qid, r.rank)):
            got[n].setdefault(r.qid, []).append((r.doc_id, r.score))
    for q in asked:
        scores = {i: float(vectors[i] @ vectors[q]) for i in texts}
        lex = lexical(q)
        dense = {i: scores[i] for i in best(scores, 15)}
        want = fused(q, dense, lex, set(dense) | set(best(lex, 15)))
        assert [i for i, _ in got["hybrid_search"][q]] == [i for i, _ in want] and [s for _, s in got["hybrid_search"][q]] == pytest.approx([s for _, s in want], abs=2e-4)
        other = vectors[q + 100] if q + 100 in texts else vectors[q]
        second = {i: float(vectors[i] @ other) for i in texts}
        both = dict(dense)
        for i in best(second, 15):
            both[i] = max(both.get(i, -9.0), 0.4 * second[i])
        want = fused(q, both, lex, set(both))
        assert [i for i, _ in got["hyde_search"][q]] == [i for i, _ in want] and [s for _, s in got["hyde_search"][q]] == pytest.approx([s for _, s in want], abs=2e-4)


def test_text_rank(spark, sf):
    got = {}
    for r in QUERIES["keywords_text_rank"](spark, sf).collect():
        got.setdefault(r.item_id, {})[r.word] = r.rank
    for r in rows(spark, sf, "benchmark"):
        w, graph = r.text.lower().split(), Counter()
        for i in range(len(w)):
            for j in range(i + 1, min(i + 5, len(w))):
                if w[i] != w[j]:
                    graph[w[i], w[j]] += 1
                    graph[w[j], w[i]] += 1
        out = Counter()
        for (a, _), c in graph.items():
            out[a] += c
        s = dict.fromkeys(out, 1.0)
        for _ in range(10):
            new = dict.fromkeys(s, 0.0)
            for (a, b), c in graph.items():
                new[b] += c / out[a] * s[a]
            s = {x: 0.15 + 0.85 * v for x, v in new.items()}
        want = sorted(s, key=lambda x: (-round(s[x], 9), x))[:5]
        assert got[r.item_id] == {x: i + 1 for i, x in enumerate(want)} or sorted(round(s[x], 7) for x in got[r.item_id]) == sorted(round(s[x], 7) for x in want)


def test_scan_reads_all_kinds(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text, encoding="utf-8"))
    put("a/one.json", json.dumps([{"question": "q1", "answer": "a1"}, {"query": "q2", "reply": "a2"}]))
    put("a/b/two.json", '\n{"question": "q3"}\n\nbroken {\n{"question": "q4", "answer": "é"}\n')
    put("three.json", json.dumps({"data": [{"question": "q5"}], "more": 1}))
    put("four.jsonl", '{"question": "q6"}\nbroken\n\n')
    put("c/five.csv", 'question,answer,unknown\n"q7, with\na break",a7,x\n')
    put("c/six.csv", "answer,question\na8,q8\n")
    put("seven.txt", '{"question": "q9"}\n  plain line \n\n')
    put("eight.md", "not read")
    got = sorted((r.question or r.query or r.text, r.answer or r.reply) for r in readers.scan(spark, str(tmp_path)).collect())
    assert got == sorted([("q1", "a1"), ("q2", "a2"), ("q3", None), ("q4", "é"), ("q5", None), ("q6", None), ("q7, with\na break", "a7"), ("q8", "a8"), ("q9", None), ("plain line", None)], key=str) or sorted(got, key=str) == sorted([("q1", "a1"), ("q2", "a2"), ("q3", None), ("q4", "é"), ("q5", None), ("q6", None), ("q7, with\na break", "a7"), ("q8", "a8"), ("q9", None), ("plain line", None)], key=str)


def test_drain_appends_only_what_is_new(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(folder)
    for n in (3, 3):
        append.copy_stream(spark, folder, "*.parquet", "id long", out)
        assert spark.read.parquet(out).count() == n
    spark.range(3, 5).write.mode("append").parquet(folder)
    append.copy_stream(spark, folder, "*.parquet", "id long", out)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_near_classes_of_copies_and_blanks(spark):
    w = [f"x{i}" for i in range(20)]
    data = [(i, w) for i in range(50)] + [(90, [*w[1:], "y"]), (91, []), (92, None), (93, ["z"])]
    got = {r.id: (r.same_as, r.n_links) for r in dedup.near_classes(spark.createDataFrame(data, "id long, w array<string>"), "id", "w", 0.8).collect()}
    assert got[7] == (0, 50) and got[90] == (90, 50) and got[91] == (91, 0) and got[92] == (92, 0) and got[93] == (93, 0)


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[7] = v[9] = v[200]
    from corpusmill.operators.retrieval import nearest

    d = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "doc_id long, embedding array<double>").repartition(5)
    q = d.where("doc_id < 20").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("vector"))
    want = {i: sorted(range(300), key=lambda j, i=i: (-round(float(v[i] @ v[j]), 9), j))[:4] for i in range(20)}
    for size in (64, 300, 1 << 20):
        got = {}
        for r in sorted(nearest(d, q, 4, block_bytes=size).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.qid, []).append(r.doc_id)
        assert got == want
    assert nearest(d, q.where("qid < 0"), 4).count() == 0 and nearest(d.where("doc_id < 0"), q, 4).count() == 0


def test_ranks_by_key_in_a_large_class(spark):
    from corpusmill.operators.balance import ranked

    data = [(i * 7 % 1000, "a" if i % 10 else None) for i in range(1000)]
    got = {r.k: r.place for r in ranked(spark.createDataFrame(data, "k long, c string").repartition(6), "c", "k").collect()}
    for c in ("a", None):
        assert [got[k] for k in sorted(k for k, x in data if x == c)] == list(range(1, 1 + sum(x == c for _, x in data)))


def test_conversations_as_instructions(spark, tmp_path):
    from corpusmill.sources import writers

    written = lambda name: json.loads("".join(x.read_text() for x in (tmp_path / name).glob("part-*.json")))
    df = spark.createDataFrame([([("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2")], 3)], "messages array<struct<role:string,content:string>>, _meta int")
    writers.conversations(df, str(tmp_path / "x"), alpaca=True)
    assert written("x") == {"instruction": "u1", "input": "", "output": "a2", "_meta": 3}
    writers.conversations(df, str(tmp_path / "y"), meta=False)
    assert set(written("y")) == {"messages"}


def test_parities_bound_what_two_sets_do_not_share(spark):
    """No pair at the threshold is lost at any size, and pairs of one rare word in common are no rows of the verification."""
    data, own = [], 0
    for size in (3, 40, 599, 601, 700, 2490, 2510, 3000):
        base = [f"w{own + i}" for i in range(size)]
        for change in (0, 0.1, 0.12, 0.4, 0.9):
            n = int(size * change)
            data.append((len(data), base[: size - n] + [f"x{len(data)}-{i}" for i in range(n)]))
        own += size
    df = spark.createDataFrame(data, "id long, w array<string>")
    sets = {i: set(w) for i, w in data}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    assert {tuple(r) for r in dedup.near_pairs(df, "id", "w", 0.8).collect()} == want
    bits = {r.id: r.bits for r in dedup.parities(df.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))).collect()}
    count = lambda x, y: sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True))
    for a in sets:
        for b in sets:
            differ = [count(bits[a][: len(dedup.BITS)], bits[b][: len(dedup.BITS)])]
            if bits[a].more and bits[b].more and len(bits[a].more) == len(bits[b].more):
                differ.append(count(bits[a].more, bits[b].more))
            assert max(differ) <= len(sets[a] ^ sets[b])
            if a // 5 == b // 5 and abs(a % 5 - b % 5) == 4 and len(sets[a]) > 3:
                assert max(differ) * 1.8 > 0.2 * (len(sets[a]) + len(sets[b]))


def test_words_of_near_duplicates_are_cut_once(spark, monkeypatch):
    """No text is cut into words for a filter and for its set, and sets meet their copies' keys once."""
    plans, cut = {}, dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df, what="cut", *a: plans.setdefault(what, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, what, *a))
    base = "a b c d e f g h i j"
    docs = spark.createDataFrame([(0, base), (1, base), (2, base + " k"), (3, "x y z"), (4, "x z"), (5, None), (6, ""), (7, "Z y X"), (8, "x y q")], "doc_id long, text string")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0))
    kept = dedup.near_dedup(docs, pairs="minhash", words=words)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 8]
    assert [p.count("regexp_extract_all") for p in plans["sets"]] == [1]
    assert all("Join" not in p for p in plans["bands"])
