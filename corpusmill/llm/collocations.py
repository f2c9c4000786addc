"""Phrase collocations: phrases whose parts occur together far more often than apart.

1. Each task cuts its texts into pieces and words and builds generalised suffix
   automata of bounded depth over shards of so many words.  A state stands for
   phrases that end at the same places: its longest phrase, the length of its
   shortest, and the number of places.  The automaton is built by sorting the
   reversed contexts of all places, which puts the tree of suffix links in order:
   a node that has no more places than one of its children is that child's state.
2. States are enumerated into their phrases.  A shard sends each hash part one
   packed row of phrases and counts, so a phrase costs a few bytes and no row of
   its own, and however frequent it is a shard sends it once.
3. Parts are added up, and phrases of ``least`` occurrences stay.  A phrase is no
   more frequent than its parts, so the counts of all parts of candidates stay too.
4. Candidates meet the counts of their parts for each cut.  The suffix link of a
   candidate of the full depth (all but its first word) and its beginning (all
   but its last) are what it may subsume; the largest count of each is combined
   before it meets the shorter candidates.

Counts are exact, phrases are compared as text, and scores are exact decimals.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.storage import cut

DEPTH, BITS = 3, 21
MASK = np.int64((1 << BITS) - 1)
#: Words of a shard, bytes of text that are cut at a time, and bytes of the corpus for each part.
SHARD_WORDS, BLOCK_BYTES, PART_BYTES = 600_000, 1 << 19, 8 << 20
#: Letters A-Z become small; what ends a piece becomes a newline, a tab a space.
_ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
SALTS = 64


class Automaton:
    """The states of a shard: ``key`` (the longest phrase), its ``length``, the ``shortest`` length and ``count``.

    A phrase is packed from its last word to its first, 21 bits each, so the
    suffix of L words is the upper part, and a state's suffix link is the suffix
    that is one word shorter than its shortest phrase.
    """

    def __init__(self, words: np.ndarray, context: int = 0):
        """``words``: ids from 2, and 1 between pieces; the first ``context`` of them are counted nowhere."""
        last = np.where(words > 1, words, 0).astype(np.int64)
        before = np.concatenate([[0], last[:-1]])
        third = np.where(before > 0, np.concatenate([[0, 0], last[:-2]])[: len(last)], 0)
        key = ((last << 2 * BITS) | (before << BITS) | third)[context:]
        key = np.sort(key[key >> 2 * BITS > 0])
        at = np.flatnonzero(np.diff(key, prepend=-1))
        leaf, places = key[at], np.diff(np.append(at, len(key)))
        levels = []  # from the longest contexts to single words: packed phrase, places, those whose parent has no other place
        for depth in range(DEPTH, 0, -1):
            shift = BITS * (DEPTH - depth)
            cuts = np.flatnonzero(np.diff(leaf >> shift, prepend=-1))
            own = leaf[cuts] >> shift << shift
            levels.append((own, np.add.reduceat(places, cuts) if len(cuts) else places[:0], (leaf[cuts] >> shift & MASK) > 0))
        key, length, shortest, number = [], [], [], []
        for depth, (own, n, real) in zip(range(DEPTH, 0, -1), levels, strict=True):
            if depth < DEPTH:  # of one state with a longer phrase if that has all the places
                longer, more, whole = levels[DEPTH - depth - 1]
                parent = np.searchsorted(own, longer >> (shift := BITS * (DEPTH - depth)) << shift)
                same = np.zeros(len(own), bool)
                same[parent[whole & (more == n[parent])]] = True
                real = real & ~same
            least = np.full(len(own), depth, np.int8)
            for up in range(depth - 1, 0, -1):
                shorter, m, _ = levels[DEPTH - up]
                shift = BITS * (DEPTH - up)
                least[(least == up + 1) & (m[np.searchsorted(shorter, own >> shift << shift)] == n)] = up
            key.append(own[real])
            number.append(n[real])
            shortest.append(least[real])
            length.append(np.full(int(real.sum()), depth, np.int8))
        self.key, self.count, self.shortest, self.length = map(np.concatenate, (key, number, shortest, length))

    def phrases(self, length: int) -> tuple[list[np.ndarray], np.ndarray]:
        """All phrases of ``length`` words, as ids from first word to last, and their counts."""
        there = (self.shortest <= length) & (length <= self.length)
        key = self.key[there]
        return [key >> BITS * (DEPTH - 1 - i) & MASK for i in range(length - 1, -1, -1)], self.count[there]


class Shard:
    """Words of texts in several languages, by ids; the same word in two languages has two."""

    def __init__(self):
        self.dicts: dict[str, defaultdict] = {}
        self.start({})

    def start(self, carried: dict[str, list[bytes]]):
        """Forget all but the words that stand before what comes next."""
        self.ids, self.dicts, self.stream, self.size = count(2), {}, [], 0
        self.context = 0
        for lang, words in carried.items():
            self.put(lang, words)
        self.context = self.size

    def put(self, lang: str, words: list[bytes]):
        known = self.dicts.get(lang)
        if known is None:
            known = self.dicts[lang] = defaultdict(self.ids.__next__, {b"": 0, b"\n": 1})
        found = np.array(list(map(known.__getitem__, words)), np.int64)
        found = found[found > 0]
        self.stream.append(found)
        self.size += len(found)

    def add(self, lang: str, text: str) -> Iterator[tuple]:
        """Take a text; yields what is to be sent whenever the shard is full."""
        data = text.encode().translate(TABLE)
        at = 0
        while at < len(data):
            end = data.find(b" ", min(len(data), at + BLOCK_BYTES))
            end = len(data) if end < 0 else end
            words = data[at:end].replace(b"\n", b" \n ").split(b" ")
            at = end
            self.put(lang, words)
            if self.size >= SHARD_WORDS:
                yield self.full()
                tail = [w for w in words if w][-2:] if at < len(data) else []
                self.start({lang: tail} if tail else {})
        self.stream.append(np.ones(1, np.int64))
        self.size += 1

    def full(self) -> tuple[Automaton, list[bytes], list[str]]:
        """The automaton, and of each id from 2 its word and language."""
        size = next(self.ids)
        words, langs = [b""] * size, [""] * size
        for lang, known in self.dicts.items():
            for w, i in known.items():
                if i > 1:
                    words[i], langs[i] = w, lang
        return Automaton(np.concatenate(self.stream), self.context), words, langs


_U = np.uint64
_SCHEMA = pa.schema([("key", pa.string()), ("n", pa.int64())])


def _blob(keys: pa.Array, n: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
        out.write_batch(pa.RecordBatch.from_arrays([keys, n], schema=_SCHEMA))
    return sink.getvalue().to_pybytes()


def _sent(made: tuple, parts: int, max_words: int) -> Iterator[pa.RecordBatch]:
    """A shard's packed rows ``(part, blob)``; keys are the language, a tab and the phrase, or nothing behind the tab for the number of words."""
    import xxhash

    automaton, words, langs = made
    plain = pa.array(words, pa.binary()).cast(pa.string())
    first = pa.array([f"{x}\t".encode() + w for x, w in zip(langs, words, strict=True)], pa.binary()).cast(pa.string())
    hashes = np.array([xxhash.xxh64_intdigest(w, len(x)) for x, w in zip(langs, words, strict=True)], _U)
    for length in range(1, max_words + 1):
        ids, n = automaton.phrases(length)
        h = np.zeros(len(n), _U)
        for x in ids:
            h = (h ^ hashes[x]) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
        part = ((h >> _U(32)) * _U(parts) >> _U(32)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        columns = [first.take(pa.array(ids[0][order]))] + [plain.take(pa.array(x[order])) for x in ids[1:]]
        keys = pc.binary_join_element_wise(*columns, " ") if length > 1 else columns[0]
        n, at = pa.array(n[order], pa.int64()), np.searchsorted(part[order], np.arange(parts + 1))
        held, blobs, size = [], [], 0
        for p in np.flatnonzero(np.diff(at)):
            a, b = int(at[p]), int(at[p + 1])
            held.append(int(p))
            blobs.append(_blob(keys.slice(a, b - a), n.slice(a, b - a)))
            size += len(blobs[-1])
            if size > 4 << 20:
                yield _packed(held, blobs)
                held, blobs, size = [], [], 0
        if held:
            yield _packed(held, blobs)
        if length == 1:
            total: dict[str, int] = defaultdict(int)
            for i, m in zip(ids[0].tolist(), automaton.phrases(1)[1].tolist(), strict=True):
                total[langs[i]] += m
            rows = sorted(total.items())
            yield _packed([xxhash.xxh32_intdigest(x) % parts for x, _ in rows], [_blob(pa.array([f"{x}\t"]), pa.array([m], pa.int64())) for x, m in rows])


def _packed(parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _added(least: int):
    """What a task does with its parts, one after the other: keys and sums, of ``least`` at least or of all words."""

    def add(tables: list) -> pa.Table:
        return pa.concat_tables(tables).group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"]).cast(_SCHEMA)

    def done(tables: list) -> list:
        whole = add(tables)
        stays = pc.or_(pc.greater_equal(whole["n"], least), pc.ends_with(whole["key"], "\t"))
        return whole.filter(stays).combine_chunks().to_batches()

    def run(batches):
        part, tables, size = None, [], 0
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part and tables:
                    yield from done(tables)
                    tables, size = [], 0
                part = p
                tables.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
                size += tables[-1].num_rows
                if len(tables) > 1 and size > 2 * max(tables[0].num_rows, 500_000):
                    tables = [add(tables)]
                    size = tables[0].num_rows
        if tables:
            yield from done(tables)

    return run


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, max_words: int = DEPTH, parts: int | None = None) -> DataFrame:
    """``(lang, phrase, words, n)``: contiguous phrases within pieces that occur ``least`` times; ``words`` 0 is the number of all words.

    There is a part for each 8 MB of text, and at least as many as shuffle
    partitions, so that what is added up at a time does not grow.
    """
    if not 1 <= max_words <= DEPTH:
        raise ValueError(f"max_words must be 1 to {DEPTH}")
    rows = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def shards(batches):
        shard = Shard()
        for batch in batches:
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for made in shard.add(x, t.as_py()):
                    yield from _sent(made, parts, max_words)
        if shard.size > shard.context:
            yield from _sent(shard.full(), parts, max_words)

    packed = rows.mapInArrow(shards, "part int, blob binary")
    added = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_added(least), "key string, n long")
    phrase = F.substring_index("key", "\t", -1)
    return added.select(F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("words"), "n")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, max_words: int = DEPTH, subsume_percent: int = 50, top: int | None = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of phrases of 2 to ``max_words`` words, the best ``top`` of each language (None: all).

    ``a`` counts the phrase, ``l`` and ``r`` what it is cut into, ``score`` is
    ``floor(1000000 a a / (l r))`` of the cut where that is least, the first of
    such cuts; ``n`` counts all words of the language.  A phrase that lies inside
    a longer one that has ``subsume_percent`` of its occurrences is left out.

    Defined results: a null text counts as empty, a null language as ``und``;
    texts without words count for nothing; repeated rows count as often; ties
    go to the more frequent, then to the phrase that is least in UTF-8; very long
    texts, also without an end of a piece, are cut into blocks and counted whole;
    other columns are not read; an empty table gives an empty one.
    """
    counts = cut(phrase_counts(df, text, lang, least, max_words), "phrases")
    found = counts.where("words > 1")
    known = counts.where("words BETWEEN 1 AND %d" % (max_words - 1))
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = found.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(1000000 AS DECIMAL(7, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("best"))
    inside = F.array(F.expr("substring_index(phrase, ' ', 1 - words)"), F.expr("substring_index(phrase, ' ', words - 1)"))  # the suffix link, and the beginning
    longer = found.where("words > 2").select("lang", F.explode(inside).alias("phrase"), F.col("n").alias("more"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("more").isNull() | (100 * F.col("more") < subsume_percent * F.col("a")))
    left = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # a few salts first, so that no task sorts all phrases of a language
        salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        left = left.withColumn("rank", F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    ranked = left.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The contract's phrases of all documents; null, empty, long and repeated texts as ``collocations`` says."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = "list_filter(string_split_regex(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[\\x20\\x09]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, {_WORDS} AS w FROM documents),
g AS (SELECT lang, unnest(w) AS phrase, 1 AS k FROM p
  UNION ALL SELECT lang, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])), 2 FROM p WHERE len(w) >= 2
  UNION ALL SELECT lang, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3])), 3 FROM p WHERE len(w) >= 3),
f AS (SELECT lang, phrase, k, lang || chr(9) || phrase AS key, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, phrase, k AS words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
x AS (SELECT lang, phrase, words, a, w, unnest(range(1, words)) AS k FROM c),
s AS (SELECT x.*, y.f AS l, z.f AS r, (1000000::HUGEINT * a * a // (y.f::HUGEINT * z.f)) AS score FROM x JOIN f y ON y.key = x.lang || chr(9) || array_to_string(w[:x.k], ' ') JOIN f z ON z.key = x.lang || chr(9) || array_to_string(w[x.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, part, max(more) AS more FROM (SELECT lang, a AS more, unnest([array_to_string(w[:-2], ' '), array_to_string(w[2:], ' ')]) AS part FROM c WHERE words = 3) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.part = b.phrase WHERE more IS NULL OR 100 * more < 50 * b.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM t JOIN (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
