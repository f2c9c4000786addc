"""Exact de-duplication against plain grouping, with copies that span many ranges."""

import hashlib
import random
from collections import defaultdict

import pytest

from corpusmill.llm import exact_dedup


def plain(rows):
    """``(key, keep, size, sha)`` of each row, sorted, and the number of rows that stay."""
    groups = defaultdict(list)
    for key, text in rows:
        groups["".join((text or "").split(" ")).translate(dict.fromkeys(range(9, 14)))].append((-len(text or ""), key is None, key))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(key, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for _, _, key in members]
    return sorted(out, key=str), len(groups)


def same(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = exact_dedup.exact_groups(df).collect()
    want, groups = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept) and len({r.text_sha256 for r in kept}) == groups


def test_odd_texts(spark):
    long = "word another \t the thing\n" * 20_000
    texts = [None, "", " \n\t\x0b\x0c\r", "a b", "ab", "a  b", "AB", "a b", "a b", "é", "é", "🙂 x", "🙂x", long, long.replace("\t", ""), long + "x", "x" + long]
    same(spark, [*enumerate(texts), (None, "a b"), (None, "alone"), (3, "a b"), (3, "a b"), (4, "a   b"), (None, None)])


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(df).count() == 0 and exact_dedup.drop_copies(df).count() == 0


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_copies_that_fill_many_ranges(spark, parts):
    random.seed(parts)
    common = "the same long beginning of very many texts, which goes on and on "
    rows = [(i, random.choice([common + "end", common + "end", common + " end ", common + str(random.randint(0, 40)), "", "ab" * random.randint(0, 3)])) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(spark, rows + rows[:50], 6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With one hash for all texts and no first characters, runs of one place span ranges and are met by their texts."""
    monkeypatch.setattr(exact_dedup, "LEAD", 0)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: exact_dedup.F.lit(7).cast("long"))
    same(spark, [(i, "abc "[: i % 4] + " " * (i % 3)) for i in range(500)])


def test_keeps_rows_with_all_columns(spark):
    rows = [(1, "a b", "p", 1), (2, "a  b", "q", 2), (2, "a  b", "q2", 2), (3, "c", "r", 3), (3, "c", "r", 3), (None, None, "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, norm string, size int")
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[3], rows[5]], key=str)
    other = spark.createDataFrame([("x", "t t"), ("w", "tt "), (None, "tt  ")], "name string, `body.x` string")
    assert {(r.name, r.keep_id, r.kept) for r in exact_dedup.exact_groups(other, "name", "body.x").collect()} == {("x", None, False), ("w", None, False), (None, None, True)}
