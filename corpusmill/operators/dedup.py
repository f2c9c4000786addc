"""De-duplication: exact keep-first, and near duplicates under greedy or component rules."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.operators.graph import connected_components
from corpusmill.storage import cut, discard


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by ``order`` of each combination of ``keys``.

    The minimum is combined before the shuffle, so a key with very many rows
    costs no task more than one row from each.
    """
    rest = [c for c in df.columns if c not in order and c not in keys]
    row = F.min_by(F.struct(*[F.col(c) for c in (*order, *rest)]), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, "_r.*").select(*df.columns)


def band_plan(threshold: float, permutations: int, miss_weight: float = 0.5) -> tuple[int, int]:
    """Bands and rows of least error for a threshold: needless pairs below it, and missed ones above it by ``miss_weight``."""
    def area(f, a, b, steps=200):
        return sum(f(a + (b - a) * (i + 0.5) / steps) for i in range(steps)) * (b - a) / steps

    best = None
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            miss = lambda s, b=b, r=r: (1 - s**r) ** b
            wrong = (1 - miss_weight) * area(lambda s, m=miss: 1 - m(s), 0, threshold) + miss_weight * area(miss, threshold, 1)
            if best is None or wrong < best[0]:
                best = (wrong, b, r)
    return best[1], best[2]


def near_pairs(df: DataFrame, key: str, words: str, threshold: float, exact: bool = True) -> DataFrame:
    """``(a, b)`` with a < b: pairs whose word sets have at least this Jaccard similarity.

    Exact: each set sends its rarest words, as many as a partner must share one
    of (prefix filter in the order of global frequency, counted by hash in slots
    of a fixed number, so that no word is sent to be counted; words of no other
    set are not sent), with the parities of its words by hash.  Of pairs that share
    one, those whose sizes and places of it leave room for enough in common
    (positional filter), and whose parities do not differ in more places than
    their words may, are verified on the sets, which meet in groups: a set is sent
    to its groups and not to each of its pairs.  Equal sets are compared once, by
    their first.
    """
    sets = df.select(F.col(key).alias("id"), F.sort_array(F.array_distinct(words)).alias("w")).where("size(w) > 0")
    hashed = sets.select("id", F.size("w").alias("size"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    prefix = rarest(hashed, frequencies(hashed.select("h")), threshold)
    prefix = cut(parities(prefix).select("id", "size", "bits", F.explode("p").alias("p")).select("id", "size", "bits.*", "p.i", "p.x"), "prefix")
    a, b = (prefix.select("x", *[F.col(c).alias(c + n) for c in ("size", "i", "more", *BITS)], F.col("id").alias(n)) for n in ("a", "b"))
    sizes = F.least("sizea", "sizeb") >= threshold * F.greatest("sizea", "sizeb") - 1e-9
    # Of what the two have in common, no more stands before the word than the shorter way to it, nor behind it than the shorter rest.
    most = F.least("ia", "ib") + 1 + F.least(F.col("sizea") - F.col("ia"), F.col("sizeb") - F.col("ib")) - 1
    both = F.col("sizea") + F.col("sizeb")
    room = most * (1 + threshold) >= threshold * both - 1e-6
    differ = reduce(add, [F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in BITS])
    more = F.aggregate(F.zip_with("morea", "moreb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    may = lambda n: n * (1 + threshold) <= (1 - threshold) * both + 1e-6  # noqa: E731  (words of one set alone, each of which changes one parity)
    alike = may(differ) & F.when(F.size("morea") == F.size("moreb"), may(more)).otherwise(True)
    near = cut(a.join(b, "x").where((F.col("a") < F.col("b")) & sizes & room & alike).select("a", "b").distinct(), "met")
    discard(prefix)
    return similar(near, sets, threshold)


#: Slots by which words are counted, parts in which the counts travel, and sets of one group to be verified, about.
SLOTS, PARTS, GROUP = 1 << 22, 256, 512


def _slot(h):
    """The slots of hashes; parities take the lower bits."""
    return (h >> 20) & (SLOTS - 1)


def frequencies(hashed: DataFrame):
    """How many sets of the column ``h`` hold a word of each slot, 16 MB however many words there are: no less than those that hold the word."""
    import numpy as np
    import pyarrow as pa

    size = SLOTS // PARTS

    def run(batches):
        counts = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                np.add.at(counts, _slot(batch.column(0).slice(at, 512).flatten().to_numpy(zero_copy_only=False)), 1)
        for i in range(PARTS):
            part = counts[i * size : (i + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["i", "part"])

    def total(key, table):
        part = np.zeros(size, np.int64)
        for x in table.column("part"):
            part += np.frombuffer(x.as_buffer(), np.int32)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([np.minimum(part, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    whole = np.zeros((PARTS, size), np.int32)
    for r in hashed.mapInArrow(run, "i int, part binary").groupBy("i").applyInArrow(total, "i int, part binary").collect():
        whole[r.i] = np.frombuffer(r.part, np.int32)
    return whole.ravel()


def rarest(hashed: DataFrame, counts, threshold: float) -> DataFrame:
    """``(id, size, p, h)`` of ``(id, size, h)``: in ``p`` places and hashes of the rarest words, one of which each similar set has among its own."""
    import numpy as np
    import pyarrow as pa

    sent = hashed.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                h = part.column(2).flatten().to_numpy(zero_copy_only=False)
                size = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                own = np.repeat(np.arange(len(size)), size)
                n = sent.value[_slot(h)]
                order = np.lexsort((h, n, own))
                place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                keep = size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1
                taken = (place < keep[own]) & (n[order] > 1)
                ends = np.concatenate([[0], np.cumsum(np.bincount(own[taken], minlength=len(size)))])
                some = pa.StructArray.from_arrays([pa.array(place[taken].astype(np.int32)), pa.array(h[order][taken])], names=["i", "x"])
                some = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), some)
                made = pa.RecordBatch.from_arrays([part.column(0), part.column(1), some, part.column(2)], names=["id", "size", "p", "h"])
                yield made.filter(pa.array(np.diff(ends) > 0))

    return hashed.mapInArrow(run, f"id {hashed.schema['id'].dataType.simpleString()}, size int, p array<struct<i: int, x: bigint>>, h array<bigint>")


def similar(near: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets ``(id, w)`` are similar; ``near`` is written.

    A pair's group is the least partner of its lesser set, which most pairs of a
    cluster share.  Large groups are dealt into parts, of which two meet at a time.
    """
    import numpy as np
    import pyarrow as pa

    least = near.select("a", F.col("b").alias("of")).union(near.select(F.col("b").alias("a"), F.col("a").alias("of"))).groupBy("a").agg(F.least("a", F.min("of")).alias("g"))
    grouped = cut(near.join(least, "a").select("g", "a", "b"), "grouped")
    ends = grouped.select("g", F.col("a").alias("id")).union(grouped.select("g", F.col("b").alias("id")))
    large = ends.groupBy("g").agg(F.approx_count_distinct("id").alias("n")).where(F.col("n") > GROUP).select("g", F.ceil(F.col("n") / GROUP).cast("int").alias("n"))
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("n", F.lit(1))).cast("int")
    dealt = cut(grouped.join(large, "g", "left").select("g", part("a").alias("pa"), part("b").alias("pb"), "a", "b"), "dealt")
    where = ["g", "pa", "pb"]
    sent = dealt.select(*where, F.col("a").alias("id")).union(dealt.select(*where, F.col("b").alias("id"))).distinct()
    there = sent.join(sets, "id").select(*[F.col(c).alias("at_" + c) for c in where], "id", "w")

    def run(pairs, table):
        words, ids = table.column("w").combine_chunks(), table.column("id").to_pylist()
        code = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        last = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
        held = {k: np.sort(code[e - n : e]) for k, e, n in zip(ids, last.tolist(), np.diff(last, prepend=0).tolist(), strict=True)}
        good = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            x, y = held[a], held[b]
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            good.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
        return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    kind = near.schema["a"].dataType.simpleString()
    return dealt.groupBy(*where).cogroup(there.groupBy(*["at_" + c for c in where])).applyInArrow(run, f"a {kind}, b {kind}")


#: Columns of 64 parities each, which tell sets of up to some hundred words apart, and further parities of sets above so many words.
BITS, MORE = [f"p{i}" for i in range(8)], ((2500, 8192), (600, 2048))


def parities(sets: DataFrame) -> DataFrame:
    """``sets`` with a struct ``bits`` in place of the hashes ``h``: for each of 512 slots, whether an odd number of hashes falls into it.

    ``more`` in it holds further parities of large sets.
    """
    import numpy as np
    import pyarrow as pa

    rest = [c for c in sets.columns if c != "h"]
    slots = 64 * len(BITS)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                h = part.column("h")
                slot = h.flatten().to_numpy(zero_copy_only=False) & (slots - 1)
                own = np.repeat(np.arange(len(h)), h.value_lengths().to_numpy(zero_copy_only=False))
                odd = (np.bincount(own * slots + slot, minlength=len(h) * slots) & 1).astype(np.uint8)
                bits = np.packbits(odd).view(np.int64).reshape(len(h), -1)
                more = []
                for one in h:
                    m = next((m for least, m in MORE if len(one) > least), 0)
                    more.append(np.packbits((np.bincount(one.values.to_numpy(zero_copy_only=False) & (m - 1), minlength=m) & 1).astype(np.uint8)).view(np.int64) if m else None)
                made = pa.StructArray.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in bits.T], pa.array(more, pa.list_(pa.int64()))], names=[*BITS, "more"])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], made], names=[*rest, "bits"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.select(*rest).schema)
    return sets.select(*rest, "h").mapInArrow(run, f"{kinds}, bits struct<{', '.join(f'{c}: bigint' for c in BITS)}, more: array<bigint>>")


def signatures(sets: DataFrame, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """``(id, bands array<long>)`` of ``(id, w)``: minima of random permutations of the words' hashes, combined by band."""
    import numpy as np

    random = np.random.default_rng(seed)
    a, b = (random.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        x, y = (np.empty((256, bands * rows), np.uint64) for _ in range(2))
        for batch in batches:
            out = []
            for words in batch.column(1):
                h = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
                least = np.full(bands * rows, np.iinfo(np.uint64).max)
                for at in range(0, len(h), len(x)):  # in pieces, and in place: a task's time is these few operations
                    part = h[at : at + len(x), None]
                    p, q = x[: len(part)], y[: len(part)]
                    np.multiply(part, a, out=p)
                    np.add(p, b, out=p)
                    np.right_shift(p, np.uint64(29), out=q)
                    np.bitwise_xor(p, q, out=p)
                    np.multiply(p, np.uint64(0xBF58476D1CE4E5B9), out=p)
                    np.minimum(least, p.min(0), out=least)
                mixed = np.zeros(bands, np.uint64)
                for column in least.reshape(bands, rows).T:
                    mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(32)
                out.append((mixed + np.arange(bands, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["id", "bands"])

    return sets.select("id", F.transform("w", lambda x: F.xxhash64(x)).alias("h")).mapInArrow(run, f"id {kind}, bands array<long>")


def minhash_pairs(df: DataFrame, key: str, words: str, threshold: float, permutations: int = 128, verify: bool = True) -> DataFrame:
    """``(a, b)`` with a < b that share a band of their signatures; with ``verify`` only similar ones.

    Bands are planned to miss few pairs if these are verified (at 0.8 and 128
    permutations 0.95 of those at the threshold itself are found), and for equal
    errors if not.
    """
    bands, rows = band_plan(threshold, permutations, 0.95 if verify else 0.5)
    sets = df.select(F.col(key).alias("id"), F.array_distinct(words).alias("w")).where("size(w) > 0")
    banded = cut(signatures(sets, bands, rows).select("id", F.explode("bands").alias("band")), "bands")
    if not verify:
        first = banded.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
        return banded.join(first, "band").where("id > a").select("a", F.col("id").alias("b")).distinct()
    several = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    banded = cut(banded.join(several, "band", "left_semi"), "shared")
    near = cut(banded.select(F.col("id").alias("a"), "band").join(banded.select(F.col("id").alias("b"), "band"), "band").where("a < b").select("a", "b").distinct(), "met")
    some = cut(sets.join(banded.select("id").distinct(), "id", "left_semi"), "some")  # the sets that met another, once
    side = lambda n: some.select(F.col("id").alias(n), F.col("w").alias("w" + n))
    both = near.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(common >= threshold * (F.size("wa") + F.size("wb") - common) - 1e-9).select("a", "b")


def near_classes(df: DataFrame, key: str, words: str, threshold: float) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``same_as`` (the smallest key with the same word set) and ``n_links``.

    ``n_links`` counts the rows whose word sets have at least the threshold's
    similarity.  Sets meet once, whatever the number of their copies; rows
    without words link with nothing and are their own ``same_as``.
    """
    rows = cut(df.select(F.col(key).alias("id"), F.sort_array(F.array_distinct(words)).alias("w")).withColumn("h", F.sha2(F.to_json("w"), 256)), "sets")
    same = cut(rows.where("size(w) > 0").groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n")), "same")
    firsts = rows.join(same.select(F.col("first").alias("id")), "id", "left_semi")
    pairs = cut(near_pairs(firsts, "id", "w", threshold), "near")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(same.select(F.col("first").alias("b"), F.col("n").alias("m")), "b").groupBy(F.col("a").alias("first")).agg(F.sum("m").alias("others"))
    told = same.join(links, "first", "left").select("h", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.select("id", "h", (F.size("w") > 0).alias("some")).join(told, "h", "left")
    return out.select(F.col("id").alias(key), F.when(F.col("some"), F.col("first")).otherwise(F.col("id")).alias("same_as"), F.when(F.col("some"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"))


def greedy_kept(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The rows kept when each row in order is dropped if an earlier kept row is similar.

    That is the lexicographically first maximal independent set.  In rounds: an
    undecided row without an undecided earlier neighbour is kept, and its later
    neighbours go.  The smallest undecided row is decided in each round, so this
    ends; the number of rounds is the longest chain of decisions.
    """
    edges = cut(pairs.select("a", "b"), "greedy")
    dropped = None
    left = edges
    while not left.isEmpty():
        waiting = left.select("b").distinct()
        kept = left.select("a").distinct().join(waiting, F.col("a") == F.col("b"), "left_anti")
        gone = cut(left.join(kept, "a", "left_semi").select("b").distinct(), "gone")
        dropped = gone if dropped is None else dropped.union(gone)
        left = left.join(gone.select(F.col("b").alias("a")), "a", "left_anti").join(gone, "b", "left_anti")
        left = cut(left.select("a", "b"), "left")
    return rows if dropped is None else rows.join(dropped.select(F.col("b").alias(key)), key, "left_anti")


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, least_tokens: int = 3, mode: str = "greedy", pairs: str = "exact", words=tokens) -> DataFrame:
    """``df`` without near duplicates, by word sets; ``key`` gives the order.

    Rows without text are dropped; rows with fewer than ``least_tokens`` words
    stay and are compared with nothing.  ``mode`` is ``greedy`` or
    ``components``; ``pairs`` is ``exact`` or ``minhash``.
    """
    rows = df.where(F.coalesce(F.col(text), F.lit("")) != "")
    # A generated column is computed once; a filter and a projection would each cut the text into words.
    sets = rows.select(key, F.explode(F.array(words(F.col(text)))).alias("_w")).where(F.size("_w") >= least_tokens).select(key, F.explode(F.array(F.sort_array(F.array_distinct("_w")))).alias("_w"))
    # Whatever drops the first of equal sets drops the others too, so copies never meet each other.
    told = cut(sets.withColumn("_h", F.sha2(F.array_join("_w", "\n"), 256)), "sets")
    first = told.groupBy("_h").agg(F.min(key).alias(key)).select(key)
    copies = cut(told.select(key).join(first, key, "left_anti"), "copies")
    rows = rows.join(copies, key, "left_anti")
    sets = cut(told.drop("_h").join(copies, key, "left_anti"), "firsts")
    discard(told)
    found = cut(near_pairs(sets, key, "_w", threshold) if pairs == "exact" else minhash_pairs(sets, key, "_w", threshold), "near")
    if mode == "greedy":
        return greedy_kept(rows, found, key)
    part = connected_components(found)
    return rows.join(part.where("id <> component").select(F.col("id").alias(key)), key, "left_anti")
