"""Stupid-backoff scores of documents against the n-gram counts of all others.

The relations are n-grams exploded from documents, count tables partitioned by
hash, and their join, summed per document.  They are kept packed, so that an
n-gram costs few bytes on its way:

1. Documents are packed as they come into chunks of bounded size, a written
   table.  Equal or null rows need no grouping, so none of them meet.
2. A chunk explodes its n-grams of one order, combines equal ones, and sends
   each hash partition that has one of them a row: sorted 64-bit hashes, as
   differences, and counts.
3. A hash partition adds up the counts of equal n-grams over all chunks, which
   is its part of the count table, and joins them to the rows it was sent: each
   chunk gets the totals of its n-grams back.  This is done for the short
   orders first and for the longest one by itself, so only one of the large
   exchanges is on disk at a time.
4. A chunk scores its documents: the document's own n-grams are taken off the
   totals, so that nothing vouches for itself, and logarithms are summed.

An n-gram that occurs everywhere costs each chunk one entry, so frequent words
make no task larger.  A chunk has a bounded size, and the number of partitions
follows the bytes of the corpus, so no task's memory grows with it, whatever the
session's settings.  Rows are at most one for each n-gram of a chunk, however
many chunks and partitions there are.  Only the number of words reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.ngram_join import mix
from corpusmill.llm.text import held
from corpusmill.storage import cut, discard, release

_U = np.uint64
#: Bytes of text after which a chunk is closed.
CHUNK_BYTES = 4 << 20
#: Bytes of the corpus for each hash partition, at most; a partition of one order is held at once.
PART_BYTES = 32 << 20


def _hashes(text: bytes) -> list[int]:
    """A hash for each word.  Words end at white space; A-Z count as a-z."""
    import xxhash

    words = held("lm_words", dict)
    if len(words) > 300_000:
        words.clear()
    out = []
    for w in text.lower().split():
        h = words.get(w)
        if h is None:
            h = words[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return out


class Chunk:
    """The words of some documents, and the n-grams that end at them."""

    def __init__(self, lengths, blob: bytes):
        data, at, each = zlib.decompress(blob), 0, []
        for n in lengths:
            each.append(np.array(_hashes(data[at : at + n]), np.uint64))
            at += n
        self.lengths = np.array([len(x) for x in each], np.int64)
        self.words = np.concatenate([*each, np.empty(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(each), dtype=np.int32), self.lengths)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The words at which an n-gram of this order ends, and its hash."""
        at = np.flatnonzero(self.place >= order - 1)
        g = mix(self.words + _U(1))[at]
        for k in range(1, order):
            g = mix(g * _U(0x9E3779B97F4A7C15) + mix(self.words[at - k] + _U(k + 1)))
        return at, g

    def elsewhere(self, order: int, totals: np.ndarray) -> np.ndarray:
        """For each word the count of the n-gram that ends at it in all other documents; 0 where there is none."""
        at, g = self.grams(order)
        by = np.argsort(g, kind="stable")  # documents stay in order, so a document's equal n-grams are neighbours
        g, doc = g[by], self.doc[at][by]
        key = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
        run = np.flatnonzero(key | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(g)])
        own = np.diff(np.append(run, len(g)))
        out = np.zeros(len(self.words), np.int64)
        out[at[by]] = totals[np.cumsum(key) - 1] - np.repeat(own, own)
        return out

    def scores(self, totals: list[np.ndarray], words: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Sum of logarithms, and number of words scored by a shorter n-gram than they have, per document."""
        shorter = self.elsewhere(1, totals[0])
        out = np.log(np.maximum(shorter, 0.5) / np.maximum(words - self.lengths, 1)[self.doc])
        used = np.zeros(len(out), np.int64)
        for k in range(2, len(totals) + 1):
            known = self.elsewhere(k, totals[k - 1])
            hit = np.flatnonzero(known > 0)
            out[hit] = np.log(known[hit] / shorter[hit - 1])
            used[hit] = k - 1
            shorter = known
        longest = np.minimum(self.place, len(totals) - 1)
        out += (longest - used) * np.log(alpha)
        n = len(self.lengths)
        return np.bincount(self.doc, out, n), np.bincount(self.doc, used < longest, n)


def packed_keys(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted hashes as their first and the differences, in as few bytes as all of these need."""
    if not len(keys):
        return 8, b""
    steps = np.diff(keys)
    width = next(w for w in (5, 6, 7, 8) if w == 8 or not len(steps) or int(steps.max()) < 1 << 8 * w)
    return width, keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(width: int, data: bytes) -> np.ndarray:
    """What ``packed_keys`` was given."""
    if not data:
        return np.empty(0, np.uint64)
    steps = np.frombuffer(data, np.uint8, offset=8).reshape(-1, width)
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(data, np.uint8, 8)
    wide[1:, :width] = steps
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Counts in as few bytes as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
    return width, x.astype(f"<u{width}").tobytes()


def _packed(df: DataFrame, key: str, text: str, chunk_bytes: int) -> DataFrame:
    """``(chunk, docs, lengths, size, blob)``: documents as they come, in chunks of about so many bytes."""
    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0

        def closed() -> pa.RecordBatch:
            each = pa.concat_arrays(keys)
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            blob = zlib.compress(b"".join(texts), 1)
            return pa.RecordBatch.from_arrays([whole(each), whole(pa.array(map(len, texts), pa.int32())), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["docs", "lengths", "size", "blob"])

        for batch in batches:
            own, rows = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            since = 0
            for i, t in enumerate(rows):
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= chunk_bytes:
                    keys.append(own.slice(since, i + 1 - since))
                    yield closed()
                    keys, texts, size, since = [], [], 0, i + 1
            if since < len(rows):
                keys.append(own.slice(since))
        if texts:
            yield closed()

    return docs.mapInArrow(run, f"docs array<{kind}>, lengths array<int>, size long, blob binary").withColumn("chunk", F.monotonically_increasing_id())


def _totals(packed: DataFrame, orders: list[int], parts: int) -> DataFrame:
    """``(chunk, n, part, own, width, totals)``: of each chunk's n-grams of these orders the counts in all chunks, in the order of their hashes.

    ``own`` is how many n-grams the chunk itself has in the row.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = Chunk(row["lengths"], row["blob"])
                for n in orders:
                    keys, times = np.unique(c.grams(n)[1], return_counts=True)
                    ends = np.searchsorted(keys >> _U(32), (np.arange(parts + 1, dtype=np.uint64) << _U(32)) // _U(parts))
                    ends[-1] = len(keys)
                    some = np.flatnonzero(np.diff(ends))
                    cuts = [slice(ends[i], ends[i + 1]) for i in some]
                    k, t = [packed_keys(keys[x]) for x in cuts], [_narrow(times[x]) for x in cuts]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(some), n, np.int32)), pa.array(some.astype(np.int32)), pa.array(np.full(len(some), row["chunk"], np.int64)),
                        pa.array([x for x, _ in k], pa.int32()), pa.array([x for _, x in k], pa.binary()), pa.array([x for x, _ in t], pa.int32()), pa.array([x for _, x in t], pa.binary())],
                        names=["n", "part", "chunk", "kw", "keys", "cw", "counts"])

    def count(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_pylist()
        keys = [unpacked_keys(w, x) for w, x in zip(col("kw"), col("keys"), strict=True)]
        counts = [np.frombuffer(x, f"<u{w}") for w, x in zip(col("cw"), col("counts"), strict=True)]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        ends = np.cumsum([0, *map(len, keys)])
        back = [_narrow(totals[inverse[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"chunk": table.column("chunk"), "n": table.column("n"), "part": table.column("part"), "own": pa.array([int(x.sum()) for x in counts], pa.int64()),
                         "width": pa.array([w for w, _ in back], pa.int32()), "totals": pa.array([x for _, x in back], pa.binary())})

    sent = packed.select("chunk", "lengths", "blob").mapInArrow(explode, "n int, part int, chunk long, kw int, keys binary, cw int, counts binary")
    return sent.repartition(parts, "n", "part").groupBy("n", "part").applyInArrow(count, "chunk long, n int, part int, own long, width int, totals binary")


def lm_scores(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = 3, alpha: float = 0.4, chunk_bytes: int = CHUNK_BYTES, parts: int | None = None) -> DataFrame:
    """One row for each row of ``df``: ``key``, ``n_words``, ``log_score`` and ``n_backed_off``.

    ``log_score`` (double) sums ``ln S`` over words, where S is the count of the
    longest n-gram seen elsewhere over that of its context, times ``alpha`` for
    each order given up; a single word's S is its count elsewhere (one half if
    none) over all words elsewhere.

    Defined results: null and empty texts have no words and a sum of 0; rows
    that repeat are documents of their own, and vouch for each other; a very
    long text is a chunk by itself, and taken whole; a key may be null or
    repeat; other columns are not read; an empty table gives an empty one.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    packed = cut(_packed(df, key, text, chunk_bytes), "chunks")
    if parts is None:
        size = packed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    tables = []
    for orders in [x for x in ([n for n in (1, 2) if n <= order], *[[n] for n in range(3, order + 1)]) if x]:
        tables.append(cut(_totals(packed, orders, parts), "totals"))
        release(spark, 1.0)  # this pass's exchange, before the next one has its own
    words = tables[0].where("n = 1").agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]

    def score(k, left, right):
        row = left.to_pylist()[0]
        c = Chunk(row["lengths"], row["blob"])
        right = right.sort_by([("n", "ascending"), ("part", "ascending")]).to_pydict()
        of = [[np.empty(0, np.int64)] for _ in range(order)]
        for n, w, x in zip(right["n"], right["width"], right["totals"], strict=True):
            of[n - 1].append(np.frombuffer(x, f"<u{w}").astype(np.int64))
        total, backed = c.scores([np.concatenate(x) for x in of], words, alpha)
        return pa.table({key: left.column("docs").combine_chunks().flatten(), "n_words": pa.array(c.lengths, pa.int64()), "log_score": pa.array(total, pa.float64()), "n_backed_off": pa.array(backed.astype(np.int64), pa.int64())})

    back = tables[0]
    for more in tables[1:]:
        back = back.union(more)
    scored = packed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, f"`{key}` {kind}, n_words long, log_score double, n_backed_off long")
    out = cut(scored, "scores")
    discard(packed, *tables)
    return out


def op3_lm_scores(spark, sf_dir: str, order: int = 3) -> DataFrame:
    """The mean logarithmic score of the words of each document, and how many were backed off."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = lm_scores(docs, order=order)
    mean = F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0), 6)
    return found.select("doc_id", "n_words", mean.alias("lm_score"), "n_backed_off")


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS p
  FROM (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS x FROM documents)
), g AS (
  SELECT doc_id, p, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), c AS (
  SELECT doc_id, p, u, v,
         count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) AS c3,
         count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
         count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
         count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n
  FROM g
), k AS (
  SELECT *, lag(c1) OVER d AS context1, lag(c2) OVER d AS context2 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), s AS (
  SELECT doc_id, CASE WHEN u IS NOT NULL AND c3 > 0 THEN ln(c3 / context2)
                      WHEN v IS NOT NULL AND c2 > 0 THEN ln(c2 / context1) + CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END
                      ELSE ln(greatest(c1, 0.5) / greatest(n, 1)) + CASE WHEN v IS NULL THEN 0 WHEN u IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS x,
         CASE WHEN v IS NULL THEN false WHEN u IS NULL THEN c2 = 0 ELSE c3 = 0 END AS b
  FROM k
)
SELECT d.doc_id, count(x)::BIGINT AS n_words, round(coalesce(avg(x), 0.0), 6) AS lm_score, count(*) FILTER (WHERE b)::BIGINT AS n_backed_off
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
