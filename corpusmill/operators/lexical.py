"""A lexical index in segments, and a search that skips blocks whose bound is too low.

The index is a table with a row for each segment of documents.  A segment holds
its terms in order, their postings by document, and for each term and block of
documents the greatest term frequency and the least document length, from which
a bound on any score in the block follows, whatever the mean length becomes when
segments are appended.  A second table holds the document frequency of each term.

A search takes queries in blocks of bounded bytes, one after the other: a block
is broadcast, met by all segments, and released.  A first pass looks for good
documents by each query's heaviest terms alone, a second scores these in full:
the k-th best of them is a score ``least`` that the k-th best document of all
reaches.  In the third pass terms whose bounds sum up to less than that can bring
up no document by themselves.  They are read from the heaviest to the lightest,
which have most postings, and only in blocks that still hold a document which
what is left to read could lift that high.  Tasks send no more than k rows a query.

How much of the postings that spares depends on the texts.  A few queries tell; if
it is little, all others are scored in full, many at a time and in a single pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import words_and_cjk
from corpusmill.operators.retrieval import K1, B, top
from corpusmill.storage import cut, discard

SEGMENT_DOCS, SEGMENT_WORDS, BLOCK_DOCS = 1024, 1 << 20, 32
#: Segments of one file: readers of columns hold thousands of rows of a file at once, whatever these weigh.
FILE_SEGMENTS = 4
#: Terms by which the first pass scores, how near to the k-th score a bound may come, and steps in which light terms are read.
HEAVIEST, NEAR, STAGES = 24, 2e-6, 8
#: Queries that tell how much is read, and the share of posting blocks up to which reading in steps is worth it.
TRIAL, SPARED = 16, 0.25
#: Queries scored in full at a time, terms that are multiplied as a dense matrix at most, how many products of it take the time of one posting, and postings read at a time.
ABREAST, DENSE_TERMS, DENSE, POSTINGS = 256, 4096, 64, 1 << 20
#: A posting block's columns, packed.
PARTS = {"starts": "<i4", "block_of": "<u2", "most": "<i4", "short": "<i4", "from_": "<i4", "doc": "<u2", "tf": "<i4", "lengths": "<i4"}


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``[first, last)``, and of each the place of its range."""
    n = last - first
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[owner], owner


def _segment(keys: list, lengths: np.ndarray, words: list[pa.Array]) -> tuple:
    """Documents as one segment: their keys, numbers of words and words."""
    flat = pa.concat_arrays(words).dictionary_encode()
    names = flat.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    own = np.repeat(np.arange(len(keys)), lengths)
    post, tf = np.unique(place[flat.indices.to_numpy()] * len(keys) + own if len(names) else np.empty(0, np.int64), return_counts=True)
    term, doc = post // max(1, len(keys)), post % max(1, len(keys))
    block = doc // BLOCK_DOCS
    begins = np.flatnonzero(np.diff(term * (len(keys) + 1) + block, prepend=-1))
    ends = np.append(begins[1:], len(post))
    made = {
        "starts": np.searchsorted(term[begins], np.arange(len(names) + 1)), "block_of": block[begins],
        "most": np.maximum.reduceat(tf, begins) if len(begins) else tf, "short": np.minimum.reduceat(lengths[doc], begins) if len(begins) else tf,
        "from_": np.append(begins, len(post)) if len(ends) else np.zeros(1), "doc": doc, "tf": tf, "lengths": lengths}
    return keys, [names[i] for i in order], np.bincount(term, minlength=len(names)).tolist(), {k: v.astype(PARTS[k]).tobytes() for k, v in made.items()}


def build(docs: DataFrame, text: str = "text", segment=words_and_cjk) -> tuple[DataFrame, DataFrame]:
    """``segments`` and ``terms`` (term, df) of ``(doc_id, text)``, both written.

    Documents are taken as they come, without a shuffle unless they come in fewer
    partitions than there are cores; further segments may be appended, and their
    document frequencies added.  A null text has no terms
    and counts as a document, but not for the mean length; rows without a key are left out.
    """
    rows = docs.where("doc_id IS NOT NULL")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores, "doc_id")
    rows = rows.select("doc_id", F.coalesce(segment(F.col(text)), F.expr("CAST(array() AS array<string>)")).alias("t"), F.col(text).isNotNull().alias("has"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths, words, full, kinds = [], [], [], 0, None

        def row():
            k, names, df, made = _segment(keys, np.concatenate(lengths).astype("<i4"), words)
            held = [pa.array([full]), pa.array([sum(map(len, words))]), pa.array([k], pa.list_(kinds)), pa.array([names], pa.list_(pa.string())), pa.array([df], pa.list_(pa.int32())), *[pa.array([made[c]], pa.binary()) for c in PARTS]]
            return pa.RecordBatch.from_arrays(held, names=["texts", "words", "docs", "names", "df", *PARTS])

        for batch in batches:
            kinds = batch.column(0).type
            held, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = texts.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            at = 0
            while at < len(held):  # as many documents as the segment still takes
                room = SEGMENT_WORDS - sum(map(len, words))
                end = max(at + 1, min(len(held), at + SEGMENT_DOCS - len(keys), int(np.searchsorted(ends - (ends[at] - sizes[at]), room, "right"))))
                keys += held[at:end]
                full += batch.column(2).slice(at, end - at).true_count
                lengths.append(sizes[at:end])
                words.append(texts.slice(at, end - at).flatten())
                at = end
                if len(keys) >= SEGMENT_DOCS or sum(map(len, words)) >= SEGMENT_WORDS:
                    yield row()
                    keys, lengths, words, full = [], [], [], 0
        if keys:
            yield row()

    segments = cut(rows.mapInArrow(run, f"texts long, words long, docs array<{kind}>, names array<string>, df array<int>, {', '.join(f'{c} binary' for c in PARTS)}"), "segments", FILE_SEGMENTS)
    each = segments.select(F.explode(F.arrays_zip("names", "df")).alias("x")).select(F.col("x.names").alias("term"), F.col("x.df").alias("df"))
    return segments, cut(each.groupBy("term").agg(F.sum("df").alias("df")), "terms")


class _Segment:
    """A segment as a task reads it."""

    def __init__(self, batch: pa.RecordBatch, i: int, mean: float):
        self.docs, self.names = batch.column("docs")[i].as_py(), batch.column("names")[i].values
        for c, kind in PARTS.items():
            setattr(self, c, np.frombuffer(batch.column(c)[i].as_py(), kind))
        self.mean = mean
        self.bound = self.part(self.most, self.short)
        #: Of each term, the bound over all its blocks, and their number; the last is for terms that are not here.
        self.most_of = np.append(np.maximum.reduceat(self.bound, self.starts[:-1]) if len(self.bound) else np.zeros(0), 0.0)
        self.blocks_of = np.append(np.diff(self.starts), 0)

    def part(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def local(self, vocabulary: pa.Array) -> np.ndarray:
        """The places of the terms here, or -1."""
        return pc.index_in(vocabulary, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def add(self, scores: np.ndarray, blocks: np.ndarray, weight: np.ndarray):
        """Add what the postings of posting blocks bring."""
        at, owner = _spread(self.from_[blocks].astype(np.int64), self.from_[blocks + 1].astype(np.int64))
        doc = self.doc[at]
        scores += np.bincount(doc, weight[owner] * self.part(self.tf[at], self.lengths[doc]), len(scores))

    def search(self, term: np.ndarray, weight: np.ndarray, least: float, wanted: list) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that reach ``least``, or stand at the places ``wanted``, with their scores; posting blocks read."""
        there = term >= 0
        term, weight = term[there], weight[there]
        blocks, owner = _spread(self.starts[term].astype(np.int64), self.starts[term + 1].astype(np.int64))
        bound = weight[owner] * self.bound[blocks]
        most = np.maximum.reduceat(bound, np.searchsorted(owner, np.arange(len(term)))) if len(term) else np.zeros(0)
        order = np.argsort(most, kind="stable")
        sums = np.cumsum(most[order])
        stage = np.zeros(len(term), np.int64)  # 0: brings up documents; 1 and on: the rest, heaviest first, each about halves what is to come
        light = sums < least - NEAR
        stage[order[light]] = 1 + np.minimum(STAGES - 1, np.floor(np.log2(max(sums[light].max(initial=1.0), 1e-9) / np.maximum(sums[light], 1e-9))).astype(np.int64))
        stage = stage[owner]
        scores, block = np.zeros(len(self.docs)), np.arange(len(self.docs)) // BLOCK_DOCS
        self.add(scores, blocks[stage == 0], weight[owner[stage == 0]])
        rest = np.bincount(self.block_of[blocks[stage > 0]], bound[stage > 0], -(-len(self.docs) // BLOCK_DOCS))
        stays, read, held = scores > 0, int((stage == 0).sum()), np.zeros(len(self.docs), bool)
        held[wanted] = True
        for i in range(1, STAGES + 1):
            stays = held | (stays & (scores + rest[block] >= least - NEAR))
            now = stage == i
            if not now.any():
                continue
            left = np.zeros(len(rest), bool)
            left[block[stays]] = True
            now &= left[self.block_of[blocks]]
            self.add(scores, blocks[now], weight[owner[now]])
            rest -= np.bincount(self.block_of[blocks[stage == i]], bound[stage == i], len(rest))
            read += int(now.sum())
        stays = held | (stays & (scores >= least - NEAR))
        found = np.flatnonzero(stays & (scores > 0))
        return found, scores[found], read


def _asked(queries: list[dict], heaviest: int | None) -> dict:
    """A block's queries as tasks take them: places of their terms in the vocabulary, and weights, one query after the other."""
    terms, weights = [], []
    for q in queries:
        term, weight = np.array(q["terms"], object), np.array(q["weights"], float)
        if heaviest is not None and len(term) > heaviest:
            heavy = np.argsort(-weight, kind="stable")[:heaviest]
            term, weight = term[heavy], weight[heavy]
        terms.append(pa.array(term, pa.string()))
        weights.append(weight)
    coded = pa.concat_arrays(terms).dictionary_encode()
    wanted: dict = {}
    for j, q in enumerate(queries if heaviest is None else []):
        for w in q["wanted"]:
            wanted.setdefault(w, []).append(j)
    ends = np.cumsum([0, *map(len, terms)])
    return {"ids": [q["qid"] for q in queries], "least": [q["least"] or 0.0 for q in queries], "wanted": wanted, "vocabulary": coded.dictionary, "term": coded.indices.to_numpy().astype(np.int64), "weight": np.concatenate(weights), "ends": ends}


def _task(sent, k: int, mean: float, kinds: tuple):
    """What a task does with its segments: the block's queries against each, k kept for each query, and wanted ones.

    A segment whose bounds of all of a query's terms stay below what its k-th best
    document has, and that holds no wanted one, is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        ids, wants, term, weight, ends = (asked[c] for c in ("ids", "wanted", "term", "weight", "ends"))
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        best = [[] for _ in ids]
        least = np.array(asked["least"], float)
        read, blocks, rows = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), []
        for batch in batches:
            for i in range(batch.num_rows):  # one segment at a time
                segment = _Segment(batch, i, mean)
                local = segment.local(asked["vocabulary"])[term]
                blocks += np.bincount(owner, segment.blocks_of[local], len(ids)).astype(np.int64)
                most = np.bincount(owner, weight * segment.most_of[local], len(ids))
                held: dict = {}
                for place, d in enumerate(segment.docs) if wants else ():
                    for j in wants.get(d, ()):
                        held.setdefault(j, []).append(place)
                for j in sorted({*np.flatnonzero((most > 0) & (most >= least - NEAR)).tolist(), *held}):
                    wanted = held.get(j, [])
                    found, scores, r = segment.search(local[ends[j] : ends[j + 1]], weight[ends[j] : ends[j + 1]], least[j], wanted)
                    read[j] += r
                    if not len(found):
                        continue
                    if wanted:
                        near = set(wanted)
                        rows += [(j, segment.docs[d], s, True) for d, s in zip(found.tolist(), scores.tolist(), strict=True) if d in near]
                    good = scores >= least[j] - NEAR
                    best[j] += zip((-np.round(scores[good], 6)).tolist(), [segment.docs[d] for d in found[good].tolist()], scores[good].tolist(), strict=True)
                    if len(best[j]) > k:
                        best[j] = sorted(best[j])[:k]
                        least[j] = max(least[j], -best[j][-1][0])
        yield from _told(ids, best, rows, read, blocks, k, kinds)

    return run


def _told(ids: list, best: list, rows: list, read: np.ndarray, blocks: np.ndarray, k: int, kinds: tuple) -> Iterator[pa.RecordBatch]:
    """What a task sends: the wanted ``rows``, the k best documents of each query, and how much was read."""
    for j, some in enumerate(best):
        rows += [(j, d, s, False) for _, d, s in sorted(some)[:k]]
    if rows:
        of = pa.array([ids[j] for j, *_ in rows], kinds[0])
        yield pa.RecordBatch.from_arrays([of, pa.array([r[1] for r in rows], kinds[1]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows]), *[pa.nulls(len(rows), pa.int64())] * 2], names=NAMES)
    if blocks.any():
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), pa.nulls(n, kinds[1]), pa.nulls(n, pa.float64()), pa.nulls(n, pa.bool_()), pa.array(read), pa.array(blocks)], names=NAMES)


def _scored(segment: _Segment, local: np.ndarray, weight: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The scores of all documents for all queries: of each ``ABREAST`` queries the first and a row each.

    Terms of many queries and documents are multiplied as dense matrices, the
    others posting by posting.
    """
    docs, n = len(segment.docs), len(ends) - 1
    part = segment.part(segment.tf, segment.lengths[segment.doc])
    bounds = segment.from_[segment.starts].astype(np.int64)
    begin, df = np.append(bounds[:-1], 0), np.append(np.diff(bounds), 0)  # the last is for terms that are not here
    met = df * np.append(np.bincount(local[local >= 0], minlength=len(df) - 1), 0)
    dense = np.flatnonzero(met * DENSE > n * docs)
    if len(dense) > DENSE_TERMS:
        dense = dense[np.argsort(-met[dense], kind="stable")[:DENSE_TERMS]]
    row = np.full(len(df), -1)
    row[dense] = np.arange(len(dense))
    at, of = _spread(begin[dense], begin[dense] + df[dense])
    table = np.zeros((len(dense), docs))
    table[of, segment.doc[at]] = part[at]
    for low in range(0, n, ABREAST):
        high = min(n, low + ABREAST)
        term, value = local[ends[low] : ends[high]], weight[ends[low] : ends[high]]
        own = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
        asked = np.zeros((high - low, len(dense)))
        thick = row[term] >= 0
        asked[own[thick], row[term[thick]]] = value[thick]
        scores = asked @ table
        thin = np.flatnonzero(~thick & (df[term] > 0))
        sums = np.cumsum(df[term[thin]])
        first = 0
        while first < len(thin):
            last = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + POSTINGS, "right")))
            some = thin[first:last]
            at, of = _spread(begin[term[some]], begin[term[some]] + df[term[some]])
            scores += np.bincount(own[some][of] * docs + segment.doc[at], value[some][of] * part[at], scores.size).reshape(scores.shape)
            first = last
        yield low, scores


def _task_in_full(sent, k: int, mean: float, kinds: tuple):
    """As ``_task``, but all postings of the queries' terms are read, for many queries at once, and nothing need be known of the scores before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        ids, wants, term, weight, ends = (asked[c] for c in ("ids", "wanted", "term", "weight", "ends"))
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        best, least, blocks, rows = [[] for _ in ids], np.zeros(len(ids)), np.zeros(len(ids), np.int64), []
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _Segment(batch, i, mean)
                local = segment.local(asked["vocabulary"])[term]
                blocks += np.bincount(owner, segment.blocks_of[local], len(ids)).astype(np.int64)
                held = sorted((j, place) for place, d in enumerate(segment.docs) for j in wants.get(d, ())) if wants else []
                at = 0
                for low, scores in _scored(segment, local, weight, ends):
                    while at < len(held) and held[at][0] < low + len(scores):
                        j, place = held[at]
                        if scores[j - low, place] > 0:
                            rows.append((j, segment.docs[place], float(scores[j - low, place]), True))
                        at += 1
                    own = least[low : low + len(scores)]
                    if scores.shape[1] > k:
                        np.maximum(own, np.partition(scores, -k, axis=1)[:, -k], out=own)
                    js, places = np.nonzero((scores > 0) & (scores >= own[:, None] - NEAR))
                    found = scores[js, places]
                    starts = np.searchsorted(js, np.arange(len(scores) + 1))
                    for j in np.unique(js).tolist():
                        some = slice(starts[j], starts[j + 1])
                        mine = best[low + j]
                        mine += zip((-np.round(found[some], 6)).tolist(), [segment.docs[d] for d in places[some].tolist()], found[some].tolist(), strict=True)
                        if len(mine) > k:
                            best[low + j] = mine = sorted(mine)[:k]
                            own[j] = max(own[j], -mine[-1][0])
        yield from _told(ids, best, rows, blocks, blocks, k, kinds)

    return run


NAMES = ["qid", "doc_id", "bm25", "wanted", "read", "blocks"]


def search(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, query: str = "query", wanted: str | None = None, segment=words_and_cjk, block_bytes: int = 16 << 20) -> DataFrame:
    """Rows ``(qid, doc_id, bm25, wanted, read, blocks)`` of an index from ``build``, written.

    The ``k`` best documents of each query (``wanted`` false; more than k rows, of
    which ``best`` takes the first), and the score of each document in the array
    column ``wanted``, where it is above 0 (``wanted`` true).  Rows without a
    ``doc_id`` tell how many posting blocks were read, of how many that the query's
    terms have.  A term that a query repeats counts as often.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    segments, terms = index
    spark = segments.sparkSession
    n, texts, words = segments.agg(F.sum(F.size("docs")), F.sum("texts"), F.sum("words")).first()
    docs_type = segments.schema["docs"].dataType.elementType
    types = f"qid {queries.schema['qid'].dataType.simpleString()}, doc_id {docs_type.simpleString()}, bm25 double, wanted boolean, read long, blocks long"
    if not n:
        return spark.createDataFrame([], types)
    mean = words / texts if words else 1.0
    small = segments.select("docs", "names", *PARTS)
    asked = queries.select("qid", F.explode(segment(F.col(query))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    packed = asked.join(terms, "term").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("times") * idf).alias("weight")))).alias("t"))
    packed = packed.select("qid", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    near = F.col(wanted) if wanted else F.expr(f"CAST(array() AS array<{docs_type.simpleString()}>)")
    packed = cut(packed.join(queries.select("qid", near.alias("wanted")), "qid"), "asked")
    size = packed.agg(F.sum(F.expr("16 + aggregate(terms, 0L, (s, x) -> s + 40 + length(x))"))).first()[0] or 0
    passes = max(1, -(-size // block_bytes))
    kinds = (to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(docs_type))
    found, spared = [], None
    for i in range(passes):
        block = packed.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i)
        rows = [r.asDict() for r in block.collect()]  # a block of bounded bytes
        if not rows:
            continue

        def run(each, heaviest=None, keep=k, task=_task):
            sent = spark.sparkContext.broadcast(_asked(each, heaviest))
            out = cut(small.mapInArrow(task(sent, keep, mean, kinds), types).where("doc_id IS NOT NULL OR read IS NOT NULL"), "hits")
            sent.destroy()
            return out

        def in_steps(each):
            first = run([{**r, "least": None} for r in each], HEAVIEST, 2 * k)
            good = {r.qid: r.docs for r in top(first.where("doc_id IS NOT NULL"), 2 * k, "bm25").groupBy("qid").agg(F.collect_list("doc_id").alias("docs")).collect()}
            second = run([{**r, "least": float("inf"), "wanted": good.get(r["qid"], [])} for r in each])
            least = {r.qid: r.bm25 for r in top(second.where("wanted"), k, "bm25").where(F.col("rank") == k).select("qid", "bm25").collect()}
            discard(first, second)
            return run([{**r, "least": least.get(r["qid"])} for r in each])

        if spared is None and len(rows) > 4 * TRIAL:
            found.append(in_steps(rows[:TRIAL]))
            rows = rows[TRIAL:]
            read, blocks = found[-1].agg(F.sum("read"), F.sum("blocks")).first()
            spared = (read or 0) <= SPARED * (blocks or 0)
        found.append(run([{**r, "least": None} for r in rows], task=_task_in_full) if spared is False else in_steps(rows))
    discard(packed)
    if not found:
        return spark.createDataFrame([], types)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def best(found: DataFrame, k: int) -> DataFrame:
    """``(qid, doc_id, bm25, rank)`` of ``search``'s rows: the first ``k``, by scores of six decimals, then by doc_id."""
    hits = found.where("NOT wanted").select("qid", "doc_id", "bm25", F.round("bm25", 6).alias("rounded"))
    return top(hits, k, "rounded").select("qid", "doc_id", "bm25", "rank")
