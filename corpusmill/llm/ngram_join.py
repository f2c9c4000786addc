"""Exact n-gram Jaccard join by count vectors, for classes of similar texts.

A text is the set of its distinct word n-grams.  Two texts link when
``100 * intersection >= percent * union``; a class is a connected component.

1. Equal sets are one: rows are combined by a 128-bit sum of the set before
   anything else, so any number of copies costs one row.  Texts are hashed once;
   what follows reads the written features.
2. Tokens are hashed into groups.  Two linking sets of sizes n and m differ in
   at most d = (n + m)(100 - percent)/(100 + percent) tokens.  With d + 1 + s
   groups, 1 + s groups at least hold the same tokens in both sets.  A set
   sends a 64-bit sum of each group; sets that share one meet in a bucket.
   Groupings are made for size classes, and a set takes part in its own and
   the one below, so no pair is missed.  This replaces the top of the index: a
   single tree over all points can't be searched by many machines.
3. Buckets have one global order, from few members to many, and a set leaves the
   last s of its own in each grouping.  Of the 1 + s buckets that two linking
   sets share, neither leaves the first, so they still meet, while passages
   that very many texts share bring nobody together.
4. A set is also a point: its counts in a number of groups that follows its size
   class.  The overlap of two sets is at most the sum of the coordinates' minima.
   A bucket's members are held against its first one, by this bound and then
   exactly, and linked sets become one component.
5. Of the buckets that still hold two components and more than two sets, the
   points are indexed by an R-tree, packed in blocks of bounded size; a node's
   maxima bound the overlap with all below it.  Pairs in one component already
   need no search, and a pair is sent from the first bucket alone that both are in.
6. The pairs that survive are verified on the sets, and components are taken of
   all links.  Whatever was not compared lies in one component or can't link.

Buckets are counted with a combine before the shuffle and met by a join that
adaptive execution splits, so no signature is a task of its own.  No all-pairs
output, no cap on buckets, no collection on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.text import free_name, held
from corpusmill.operators.graph import connected_components
from corpusmill.storage import cut, discard, release

LEAST_DIMS, FAN, BLOCK, SENT_IDS = 64, 32, 2048, 1_000_000
#: Spare groups, percent of those needed.
SPARE = 25
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Shingler:
    """Sets of hashed word n-grams; words are hashed once and remembered."""

    def __init__(self, k: int, max_words: int = 300_000):
        self.k, self.max_words, self.words = k, max_words, {}

    def word(self, w: bytes) -> int:
        import xxhash

        if len(self.words) >= self.max_words:
            self.words.clear()
        found = self.words[w] = xxhash.xxh64_intdigest(w) or 1
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of a text's n-grams.  Words end at white space; A-Z count as a-z."""
        get, word = self.words.get, self.word
        h = np.array([get(w) or word(w) for w in (text or "").encode("utf-8", "replace").lower().split()], np.uint64)
        if not len(h):
            return h
        n = max(1, len(h) - self.k + 1)
        out = np.full(n, min(len(h), self.k), np.uint64)
        for j in range(min(self.k, len(h))):
            out = mix(out * _U(0x9E3779B97F4A7C15) + h[j : j + n])
        return np.unique(out)


def minimum_overlap(n, m, percent: int):
    """The least intersection with which sets of these sizes link."""
    return -(-percent * (n + m) // (100 + percent))


class Groupings:
    """Size classes ``[lo, hi]`` with ``percent * hi <= 100 * lo``, and the groups of each."""

    def __init__(self, percent: int):
        self.percent, self.lo, self.groups = percent, [1], []

    def _grow(self, n: int):
        while self.lo[-1] <= n:
            hi = max(self.lo[-1], 100 * self.lo[-1] // self.percent)
            top = hi + 100 * hi // self.percent
            self.groups.append(top * (100 - self.percent) // (100 + self.percent) + 1)
            self.lo.append(hi + 1)

    def dims(self, n: int) -> int:
        """The coordinates of a point of ``n`` tokens: a power of two, about one for eight tokens of its class."""
        self._grow(n)
        hi = self.lo[int(np.searchsorted(self.lo, n, "right"))] - 1
        return max(LEAST_DIMS, 1 << (hi // 8).bit_length())

    def spare(self, grouping: int) -> int:
        """How many groups a grouping has beyond one more than two of its linking sets can differ in."""
        return -(-(self.groups[grouping] - 1) * SPARE // 100)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(grouping, number of groups, spare ones among them) in which a set of ``n`` takes part; one group only meets equals."""
        self._grow(n)
        c = int(np.searchsorted(self.lo, n, "right")) - 1
        return [(g, self.groups[g] + self.spare(g), self.spare(g)) for g in (c - 1, c) if g >= 0 and self.groups[g] > 1]


def group_sums(tokens: np.ndarray, grouping: int, groups: int) -> np.ndarray:
    """A hash for each group: of its tokens, its number and the grouping, whose parity is the last bit."""
    group = ((tokens >> _U(17)) % _U(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens + _U(grouping + 1))[order], dtype=np.uint64)])
    ends = np.cumsum(np.bincount(group, minlength=groups))
    out = mix(np.diff(sums[np.concatenate([[0], ends])]) + mix(np.arange(groups, dtype=np.uint64) * _U(1 << 20) + _U(grouping)))
    return out & ~_U(1) | _U(grouping & 1)


def counts(tokens: np.ndarray, dims: int) -> np.ndarray:
    """The point of a set: how many tokens fall into each of the groups."""
    return np.bincount((tokens & _U(dims - 1)).astype(np.int64), minlength=dims).astype(np.uint16)


def fold(point: np.ndarray, dims: int) -> np.ndarray:
    """The same set's point with fewer coordinates."""
    return point if len(point) == dims else point.reshape(-1, dims).sum(0, dtype=np.uint16)


class CountTree:
    """An R-tree over count vectors, packed by recursive splits at the widest coordinate."""

    def __init__(self, points: np.ndarray):
        self.order = np.array(list(self._pack(points, np.arange(len(points)))), np.int64)
        self.levels = [points[self.order]]
        while len(self.levels[-1]) > FAN:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN)))

    def _pack(self, points, rows) -> list:
        if len(rows) <= FAN:
            return list(rows)
        spread = np.ptp(points[rows], axis=0)
        rows = rows[np.argsort(points[rows, int(spread.argmax())], kind="stable")]
        cut_at = FAN * max(1, round(len(rows) / FAN / 2))
        return self._pack(points, rows[:cut_at]) + self._pack(points, rows[cut_at:])

    def search(self, point: np.ndarray, need: np.ndarray | int) -> np.ndarray:
        """Rows whose summed coordinate minima with ``point`` reach ``need``."""
        at = np.arange(len(self.levels[-1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            at = at[np.minimum(level[at], point).sum(1, dtype=np.int64) >= need]
            if depth and len(at):
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[depth - 1])]
        return self.order[at]


def _features(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(doc_id, mark, n, s1, s2)``, the ``point`` and the signatures ``sigs``, from ``(doc_id, mark, text)``.

    ``spare0`` and ``spare1``: the spare groups of the even and the odd grouping.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "mark", "n", "s1", "s2", "spare0", "spare1", "point", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, groupings = held(("shingles", k), lambda: Shingler(k)), Groupings(percent)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[list] = [[], [], [], [], [], [], []]
                for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    tokens = sets(text)
                    used = groupings.of(len(tokens)) if len(tokens) and key is not None else []
                    parts = [group_sums(tokens, g, n) for g, n, _ in used]
                    spare = {g & 1: n for g, _, n in used}
                    out[0].append(len(tokens))
                    out[1].append(int(mix(tokens).sum(dtype=np.uint64).astype(np.int64)))
                    out[2].append(int(mix(tokens ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    out[3].append(spare.get(0, 0))
                    out[4].append(spare.get(1, 0))
                    out[5].append(counts(tokens, groupings.dims(len(tokens))).tobytes() if len(tokens) else None)
                    out[6].append(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64))
                ends = np.array([0, *accumulate(map(len, out[6]))], np.int32)
                flat = np.concatenate(out[6]) if out[6] else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in out[:3]], *[pa.array(x, pa.int32()) for x in out[3:5]],
                    pa.array(out[5], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, mark long, n long, s1 long, s2 long, spare0 int, spare1 int, point binary, sigs array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, s1, s2, tokens array<long>)`` from ``(doc_id, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = held(("shingles", k), lambda: Shingler(k))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                tokens = [sets(t) for t in batch.column(1).to_pylist()]
                sums = [[int(mix(t ^ _U(x)).sum(dtype=np.uint64).astype(np.int64)) for t in tokens] for x in (0, 0x5851F42D4C957F2D)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(map(len, tokens), pa.int64()), *[pa.array(x, pa.int64()) for x in sums],
                    pa.array([t.view(np.int64) for t in tokens], pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "tokens"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, s1 long, s2 long, tokens array<long>")


def _buckets(feat: DataFrame, points: DataFrame, copies: DataFrame) -> DataFrame:
    """``(sig, id, leader, size)``: the members of buckets of two sets and more, after each set has left its last ones."""
    signed = feat.where("size(sigs) > 0").select("id", "sigs").join(copies, "id", "left_anti").select("id", F.explode("sigs").alias("sig"))
    shared = cut(signed.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    release(feat.sparkSession, 1.0)  # the counts' exchange, before the join has its own
    spares = points.select("id", "spare0", "spare1")
    last = Window.partitionBy("id", "odd").orderBy(F.desc("size"), F.desc("sig"))
    met = signed.join(shared, "sig").join(spares, "id").withColumn("odd", F.col("sig").bitwiseAND(1)).withColumn("place", F.row_number().over(last))
    met = cut(met.where(F.col("place") > F.when(F.col("odd") == 0, F.col("spare0")).otherwise(F.col("spare1"))).select("sig", "id"), "met")
    still = met.groupBy("sig").agg(F.count("*").alias("size"), F.min("id").alias("leader")).where("size > 1")
    out = cut(met.join(still, "sig"), "buckets")
    discard(shared, met)
    release(feat.sparkSession, 1.0)
    return out


def _search(rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: pairs of two components that may link, each from the first bucket that both are in.

    Rows come grouped by (sig, bi, bj); ``earlier`` has the searched buckets of a
    set that come before this one.
    """

    def shared(earlier: pa.ChunkedArray) -> np.ndarray:
        """For each row a bit for each earlier bucket that two rows are in."""
        lists = earlier.combine_chunks()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        _, at, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1
        row, at = row[times[at] > 1], place[at[times[at] > 1]]
        bits = np.zeros((len(lists), at.max(initial=-1) // 8 + 1), np.uint8)
        np.bitwise_or.at(bits, (row, at >> 3), np.uint8(1) << (at & 7).astype(np.uint8))
        return bits

    def pairs(ids, block, comp, n, points, met, own) -> Iterator[tuple]:
        left, right = np.flatnonzero(block == own[0]), np.flatnonzero(block == own[1])
        tree = CountTree(points[left])
        for r in right:
            need = minimum_overlap(n[r], n[left].min(), percent)
            hit = left[tree.search(points[r], need)]
            hit = hit[~(met[hit] & met[r]).any(1)]
            hit = hit[(comp[hit] != comp[r]) & (np.minimum(points[hit], points[r]).sum(1, dtype=np.int64) >= minimum_overlap(n[hit], n[r], percent))]
            if own[0] == own[1]:
                hit = hit[ids[hit] < ids[r]]
            if len(hit):
                yield np.minimum(ids[hit], ids[r]), np.maximum(ids[hit], ids[r])

    def group(held: list, key) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        col = lambda c: t.column(c).to_numpy()
        points = [np.frombuffer(x, np.uint16) for x in t.column("point").to_pylist()]
        dims = min(map(len, points))
        points = np.array([fold(x, dims) for x in points])
        found = list(pairs(col("id"), col("block"), col("comp"), col("n"), points, shared(t.column("earlier")), key[1:]))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, i, j = (batch.column(x).to_numpy() for x in (0, 1, 2))
            starts = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for x, y in zip(starts, np.append(starts[1:], len(s)), strict=True):
                key = (s[x], i[x], j[x])
                if last is not None and key != last:
                    yield from group(held, last)
                    held = []
                last = key
                held.append(batch.slice(x, y - x))
        if held:
            yield from group(held, last)

    return rows.mapInArrow(run, "a long, b long")


def sized(ids: DataFrame) -> DataFrame:
    """A table of ids, written; broadcast to what it joins if it has at most ``SENT_IDS`` rows, shuffled beyond."""
    ids = cut(ids, "ids")
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose points allow a link."""
    side = lambda x: points.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, n, m, p, q = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for i in range(len(n)):
                x, y = np.frombuffer(p[i], np.uint16), np.frombuffer(q[i], np.uint16)
                dims = min(len(x), len(y))
                keep.append(bool(np.minimum(fold(x, dims), fold(y, dims)).sum(dtype=np.int64) >= minimum_overlap(n[i], m[i], percent)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link, by their sets, which are made of the documents in them alone.

    A set is found again by a row's key and the sums of its set, so it does not
    matter which of equal rows is taken, nor that a key stands at several texts.
    """
    met = sized(reps.join(sized(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()), "id", "left_semi"))
    sets = _sets(docs.select("doc_id", "text").join(met, "doc_id", "left_semi"), k)
    sets = cut(sets.join(met, ["doc_id", "n", "s1", "s2"]).select("id", "n", "tokens").dropDuplicates(["id"]), "sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("ta", "tb"))
    out = cut(both.withColumn("i", common).where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b"), "links")
    discard(sets, met)
    return out


def _marked(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, mark, text)``; a row is known by its key and the mark of its text."""
    t = F.col(f"`{text}`")
    return df.select(F.col(f"`{key}`").alias("doc_id"), _mark(t).alias("mark"), t.alias("text"))


def _mark(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(doc_id, mark, n, class, component_id)`` for each row of ``(doc_id, mark, text)``, written.

    ``class`` tells classes apart that bear the same smallest key; null without words or key.
    """
    feat = cut(_features(docs, k, percent).withColumn("id", F.monotonically_increasing_id()), "features")
    light = cut(feat.select("id", "doc_id", "mark", "n", "s1", "s2"), "light")
    keyed = light.where("n > 0 AND doc_id IS NOT NULL")
    reps = cut(keyed.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min_by("id", "doc_id").alias("id")), "reps")
    copies = sized(keyed.join(reps.select("id"), "id", "left_anti").select("id"))
    points = cut(feat.where("n > 0 AND doc_id IS NOT NULL").select("id", "n", "spare0", "spare1", "point").join(copies, "id", "left_anti"), "points")
    buckets = _buckets(feat, points, copies)
    discard(feat)

    stars = cut(_bounded(buckets.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), points, percent), "stars")
    links = _verified(stars, reps, docs, k, percent)
    found = connected_components(links)

    at = lambda x, name: found.select(F.col("id").alias(x), F.col("component").alias(name))
    told = buckets.join(at("id", "comp"), "id", "left").join(at("leader", "lead"), "leader", "left")
    told = cut(told.select("sig", "id", "leader", "size", F.coalesce("comp", "id").alias("comp"), F.coalesce("lead", "leader").alias("lead")), "told")
    # The pair of a bucket of two is among the stars; of buckets with the same members one is searched.
    mixed = told.groupBy("sig").agg(
        F.max("size").alias("size"), F.max(F.col("comp") != F.col("lead")).alias("mixed"), F.min("leader").alias("leader"),
        F.bit_xor(F.xxhash64("id")).alias("m1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("m2")).where("mixed AND size > 2")
    mixed = mixed.groupBy("leader", "size", "m1", "m2").agg(F.min("sig").alias("sig"))
    mixed = cut(mixed.select("sig", (F.col("size") / BLOCK).cast("int").alias("top")), "mixed")
    rows = told.join(mixed, "sig").select("sig", "top", "id", "comp", F.pmod(F.xxhash64("id"), F.col("top") + 1).cast("int").alias("block"))
    searched = rows.groupBy("id").agg(F.collect_list("sig").alias("sigs"))
    rows = rows.join(points.select("id", "n", "point").join(searched, "id"), "id").withColumn("earlier", F.expr("filter(sigs, x -> x < sig)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "top"))).select(
        "sig", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "id", "block", "comp", "n", "point", "earlier")
    rows = rows.repartition("sig", "bi", "bj").sortWithinPartitions("sig", "bi", "bj")
    pairs = cut(_search(rows, percent), "pairs")
    more = _verified(pairs, reps, docs, k, percent)
    found = connected_components(links.union(more))

    named = reps.join(found, "id", "left").select("n", "s1", "s2", "doc_id", F.coalesce("component", "id").alias("component"))
    named = cut(named, "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "component").select("n", "s1", "s2", F.col("component").alias("class"), "component_id")
    keyless = F.col("doc_id").isNull()
    out = light.join(named, ["n", "s1", "s2"], "left").select(
        "doc_id", "mark", "n", F.when(~keyless, F.col("class")).alias("class"), F.when(~keyless, F.coalesce("component_id", "doc_id")).alias("component_id"))
    out = cut(out, "classes")
    discard(light, reps, copies, points, buckets, stars, links, told, mixed, pairs, more, named)
    return out


def ngram_classes(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``df``: ``doc_id``, ``n_shingles`` and ``component_id``.

    Defined results: null and empty texts have the empty set, which links with
    nothing, so they are their own class; with fewer than ``k`` words the whole
    sequence is one n-gram; a row without a key keeps none and joins no class;
    rows that repeat a key are returned as often, each in the class of its own
    text, and a class bears the smallest key in it; very long texts are taken
    whole; other columns are not read; an empty table gives an empty one.  Keys
    may be of any type with an order.
    """
    return _classes(_marked(df, key, text), k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class: one that bears the class's smallest key.

    Of several texts of that class at the key the one with the smallest hash
    stays, of rows that are equal in key and text the first in the order of
    their JSON.  Rows without a key are in no class, and stay; rows without words
    stay, one for each key and text.  Nothing depends on how the table is laid out.
    """
    found = _classes(_marked(df, key, text), k, percent).where("doc_id IS NOT NULL")
    mark = free_name(df.columns, "mark")
    ids = [F.col("doc_id").alias(key), F.col("mark").alias(mark)]
    heads = found.where("doc_id = component_id AND class IS NOT NULL")
    several = heads.groupBy("class").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).where("least < most")
    later = heads.join(sized(several.select("class", "least")), "class").where("mark <> least")
    gone = sized(found.where("doc_id <> component_id").select(*ids).union(later.select(*ids)).distinct())
    twice = sized(found.groupBy("doc_id", "mark").agg(F.count("*").alias("rows")).where("rows > 1").select(*ids))
    whole = [F.col(f"`{c}`") for c in df.columns]
    left = df.withColumn(mark, _mark(F.col(f"`{text}`"))).join(gone, [key, mark], "left_anti")
    first = F.min_by(F.struct(*whole), F.to_json(F.struct(*whole))).alias("row")
    again = left.join(twice, [key, mark], "left_semi").groupBy(f"`{key}`", mark).agg(first)
    return left.join(twice, [key, mark], "left_anti").select(*whole).union(again.select("row.*"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The contract's classes of all documents: three words, 90 percent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_classes(docs, k=3, percent=90)


ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w, ' ') AS g FROM t WHERE len(w) BETWEEN 1 AND 2
    UNION ALL SELECT doc_id, unnest(list_transform(list_zip(w, w[2:], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])[:len(w) - 2]) FROM t WHERE len(w) >= 3)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""
