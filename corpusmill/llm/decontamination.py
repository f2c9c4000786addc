"""Benchmark decontamination: approximate search for test items in documents.

An item may occur with up to ``rate`` of its characters edited.  It is split
into one piece more than that budget, so some piece occurs unchanged in every
occurrence (pigeonhole).  All pieces of all items are found in one pass over a
document.  A hit is verified from small to large: pieces form a binary tree in
which a node of n pieces has a budget of n - 1 edits; if a node keeps to its
budget, so does one of its children, hence every occurrence has a leaf all of
whose ancestors keep to theirs.  Each ancestor is checked by the bit-parallel
edit distance of Myers, and most chance hits end at the first.

Items are sent to the tasks in blocks of bounded size; more items than one
block holds mean more passes, not larger tasks.  No shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import held

_words = re.compile(r"\w+").findall


def normalise(text: str | None) -> str:
    """Lower-cased words with one space around each; empty if there is no word."""
    found = _words((text or "").lower())
    return f" {' '.join(found)} " if found else ""


def masks(pattern: str) -> dict[str, int]:
    """For each character, the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(places: dict[str, int], size: int, text: str, budget: int) -> int:
    """The least edit distance of the pattern to any part of ``text``; ``budget + 1`` if above."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = full, 0, size, size
    get = places.get
    for c in text:
        eq = get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up = (up << 1) & full
        eq |= minus
        plus = ((down << 1) & full) | (full & ~(eq | up))
        minus = up & eq
    return min(best, budget + 1)


class Item:
    """A test item: its normalised text, pieces, and the ancestors of each piece."""

    def __init__(self, ident, text: str, rate: float):
        self.ident, self.text = ident, normalise(text)
        n = int(rate * len(self.text)) + 1
        self.cuts = [i * len(self.text) // n for i in range(n + 1)]
        self.up: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self._split(0, n)
        self.masks: dict = {}

    def _split(self, lo: int, hi: int):
        if hi - lo == 1:
            return
        mid = (lo + hi) // 2
        self._split(lo, mid)
        self._split(mid, hi)
        for leaf in range(lo, hi):
            self.up[leaf].append((lo, hi))

    def verify(self, text: str, leaf: int, at: int) -> int | None:
        """The distance of an occurrence whose ``leaf`` stands at ``at``; None if beyond the budget."""
        n = len(self.cuts) - 1
        begin = at - self.cuts[leaf]
        if begin >= 0 and text.startswith(self.text, begin):
            return 0
        found = 0
        for lo, hi in self.up[leaf]:
            a, b, budget = self.cuts[lo], self.cuts[hi], hi - lo - 1
            region = text[max(0, begin + a - budget) : begin + b + budget]
            part = self.masks.get((lo, hi))
            if part is None:
                part = self.masks[lo, hi] = masks(self.text[a:b])
            found = myers(part, b - a, region, budget)
            if found > budget:
                return None
        return found if n > 1 else 0


class Searcher:
    """All pieces of all items in one automaton."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items = [x for x in (Item(i, t, rate) for i, t in items) if x.text]
        pieces: dict[str, list] = {}
        for x in self.items:
            for leaf in range(len(x.cuts) - 1):
                pieces.setdefault(x.text[x.cuts[leaf] : x.cuts[leaf + 1]], []).append((x, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> dict:
        """Item to its least distance, for the items that occur."""
        text, found = normalise(text), {}
        if not text or not self.items:
            return found
        for end, (size, where) in self.automaton.iter(text):
            for item, leaf in where:
                if found.get(item.ident) != 0:
                    d = item.verify(text, leaf, end - size + 1)
                    if d is not None and d < found.get(item.ident, d + 1):
                        found[item.ident] = d
        return found


def _searcher(name: str, items, rate: float) -> Searcher:
    return held(("leaks", name, rate), lambda: Searcher(items, rate))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """``(key, item, distance)`` for each document and each item that occurs in it.

    Defined results: documents and items with null or empty text, or without a
    word, match nothing; a row without a key matches as one with key null; items
    that repeat under one id count as one, with the least distance; rows that
    repeat are searched one by one; other columns are not read; an empty table
    on either side gives an empty one.

    ``block_chars`` bounds the characters of items that travel with the tasks
    of one pass; the number of passes follows from the items' sizes.
    """
    kinds = [docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()]
    rows, out = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), None
    for name, sent in _blocks(items, item, item_text, block_chars):
        found = rows.mapInArrow(_finder(name, sent, rate, key, item), f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, distance int")
        out = found if out is None else out.union(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns; see ``find_leaks``."""
    place = docs.columns.index(text)

    def keeper(name, sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _searcher(name, sent.value, rate).search
            for batch in batches:
                yield batch.filter(pa.array([not search(t) for t in batch.column(place).to_pylist()], pa.bool_()))

        return run

    for name, sent in _blocks(items, item, item_text, block_chars):
        docs = docs.mapInArrow(keeper(name, sent), docs.schema)
    return docs


def _blocks(items: DataFrame, item: str, item_text: str, block_chars: int) -> Iterator:
    """A name and the broadcast of each block of about ``block_chars`` characters of items."""
    items = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-2 * size // block_chars) if 2 * size > block_chars else 1
    for n in range(passes):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == n).collect()
        yield uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in block])


def _finder(name: str, sent, rate: float, key: str, item: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _searcher(name, sent.value, rate).search
        for batch in batches:
            at, idents, distances = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for ident, d in search(text).items():
                    at.append(i)
                    idents.append(ident)
                    distances.append(d)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(idents), pa.array(distances, pa.int32())], names=[key, item, "distance"])

    return run


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that occurs in it, with the least number of edits.

    A null or empty text or item gives no row; very long texts are searched whole;
    of several places of an item the one with the fewest edits counts; repeated
    documents give rows each; without documents or items there are no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
