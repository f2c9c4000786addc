"""Word segmentation by a dictionary counted from the corpus, in three modes.

A run of word characters becomes the path of words whose product of relative
frequencies is greatest (``precise``); all dictionary words in it (``full``); or
the path with the shorter words inside of long ones before them (``search``).
The dictionary has a bound and is broadcast as a tree of beginnings, so that a run
of n characters takes n times the longest word's length at most.  A task looks up
all places of many runs at once, one letter further at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.batches import pieces
from corpusmill.storage import cut

MODES = ("precise", "full", "search")
RUN = re.compile(r"\w+")


def dictionary(docs: DataFrame, text: str = "text", most: int = 200_000, longest: int = 24) -> DataFrame:
    """``(word, n)``, written: the ``most`` most frequent words of up to ``longest`` characters, in lower case; ties by the word.

    Words are what stands between white space and marks, so the corpus must have some that are set apart.
    """
    word = F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(r"(?U)\w+"), F.lit(0))).alias("word")
    counts = docs.select(word).where(F.length("word") <= longest).groupBy("word").agg(F.count("*").alias("n"))
    return cut(counts.orderBy(F.desc("n"), "word").limit(most), "dictionary")


class Words:
    """A dictionary as plain code reads it, run by run: what ``Lattice`` finds in many runs at once."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.score = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(1 / total) - 1  # of a character that is no word: less than any word
        self.begins = {w[:i] for w in counts for i in range(1, len(w) + 1)}

    def ends(self, low: str, at: int) -> list[int]:
        """The ends of the words that begin at a place, the nearest first."""
        found, end = [], at + 1
        while end <= len(low) and low[at:end] in self.begins:
            if low[at:end] in self.score:
                found.append(end)
            end += 1
        return found

    def path(self, low: str) -> list[tuple[int, int]]:
        """The best path's words as places; of equal ones that whose first word is longest."""
        best, step = [0.0] * (len(low) + 1), [0] * len(low)
        for at in range(len(low) - 1, -1, -1):
            ways = [(self.score[low[at:end]] + best[end], end) for end in self.ends(low, at)]
            if not ways or ways[0][1] > at + 1:
                ways.append((self.unknown + best[at + 1], at + 1))
            best[at], step[at] = max(ways)
        places, at = [], 0
        while at < len(low):
            places.append((at, step[at]))
            at = step[at]
        return places

    def cut(self, run: str, mode: str) -> list[str]:
        """The words of a run."""
        low = run.lower()
        low = low if len(low) == len(run) else run
        if mode == "full":
            places, covered = [], 0
            for at in range(len(low)):
                long = [end for end in self.ends(low, at) if end > at + 1]
                if long or at >= covered:  # a character by itself only where no word covers it
                    places += [(at, end) for end in long or [at + 1]]
                    covered = max(covered, *long, at + 1) if long else max(covered, at + 1)
            return [run[a:b] for a, b in places]
        out = []
        for a, b in self.path(low):
            if mode == "search":
                for n in (2, 3):
                    if b - a > n:
                        out += [run[i : i + n] for i in range(a, b - n + 1) if low[i : i + n] in self.score]
            out.append(run[a:b])
        return out


#: Runs that are cut letter by letter side by side; fewer are cut one by one.
ABREAST = 24


class Lattice:
    """A dictionary as a task reads it: beginnings of words as numbered nodes, found by the node before and a letter, and their words' scores.

    Nodes and letters make up one number, compared in full, so nothing but a word is found.
    """

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.unknown = math.log(1 / total) - 1
        words = [w for w in counts if w]
        size = np.array([len(w) for w in words], np.int64)
        points = _points("".join(words))
        letters = np.unique(points)
        self.letter = np.full(0x110001, -1, np.int32)  # the last is what stands between runs
        self.letter[letters] = np.arange(len(letters))
        self.n_letters = max(1, len(letters))
        begin, node = np.cumsum(size) - size, np.zeros(len(words), np.int64)
        keys, values, made = [], [], 1
        for depth in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > depth)
            key, of = np.unique(node[on] * self.n_letters + self.letter[points[begin[on] + depth]], return_inverse=True)
            node[on] = made + of
            keys.append(key)
            values.append(made + np.arange(len(key)))
            made += len(key)
        self.score = np.full(made, np.nan)
        self.score[node] = [math.log(counts[w] / total) for w in words]
        self.score[0] = np.nan
        keys, values = (np.concatenate([np.empty(0, np.int64), *x]) for x in (keys, values))
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot = self._slot(keys)
        while len(keys):  # of keys that ask for a free slot the last written has it, others ask for the next
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = keys[free]
            has = self.keys[slot] == keys
            self.values[slot[has]] = values[has]
            keys, values, slot = keys[~has], values[~has], (slot[~has] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The nodes of the keys, 0 where there is none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        node = np.where(held == keys, self.values[slot], 0)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            met = held == keys[open_]
            node[open_[met]] = self.values[slot[open_[met]]]
            open_ = open_[~met & (held >= 0)]
        return node

    def found(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, ends and scores of all words, by place and then by end."""
        letter = np.append(self.letter[points], -1)
        at = np.flatnonzero(letter >= 0)
        node, places, ends, scores = np.zeros(len(at), np.int64), [], [], []
        depth = 0
        while len(at):
            following = letter[at + depth]
            at, node, following = (x[following >= 0] for x in (at, node, following))
            node = self._next(node * self.n_letters + following).astype(np.int64)
            at, node = at[node > 0], node[node > 0]
            depth += 1
            score = self.score[node]
            word = ~np.isnan(score)
            places.append(at[word])
            ends.append(at[word] + depth)
            scores.append(score[word])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        places, ends, scores = (np.concatenate(x) for x in (places, ends, scores))
        order = np.argsort(places, kind="stable")
        return places[order], ends[order], scores[order]

    def paths(self, first: np.ndarray, size: np.ndarray, found: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Places and ends of the words of the best paths of all runs, as ``Words.path`` has them."""
        places, ends, scores = found
        n = int(size.sum()) + len(size)
        starts = np.searchsorted(places, np.arange(n + 1))
        best, step = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        # A letter that is no word is a way besides those found.
        alone = np.ones(n, bool)
        alone[places[ends == places + 1]] = False
        order = np.argsort(-size, kind="stable")
        first, left = first[order], size[order].copy()
        longest = int(left[0]) if len(left) else 0
        active = np.searchsorted(-left, -np.arange(1, longest + 1), "right")  # runs of at least so many letters
        done = 0
        for i in range(longest):
            if active[i] < ABREAST:
                break
            at = (first[: active[i]] + left[: active[i]]) - 1 - i
            value = np.where(alone[at], self.unknown + best[at + 1], -np.inf)
            end = at + 1
            way, last = starts[at], starts[at + 1]
            on = np.flatnonzero(way < last)
            while len(on):  # the nearest end first, and of equal ones the last
                w = way[on]
                new = scores[w] + best[ends[w]]
                better = new >= value[on]
                value[on[better]], end[on[better]] = new[better], ends[w[better]]
                way[on] += 1
                on = on[way[on] < last[on]]
            best[at], step[at] = value, end
            done = i + 1
        for j in range(int(active[done]) if done < longest else 0):
            self._rest(int(first[j]), int(first[j] + left[j]) - done, best, step, starts, ends, scores, alone)
        # Follow all paths, one word of each at a time.
        at, stop, out = first, first + left, []
        at, stop = at[at < stop], stop[at < stop]
        on_path = np.zeros(n + 1, bool)
        while len(at) >= ABREAST:
            on_path[at] = True
            at = step[at]
            at, stop = at[at < stop], stop[at < stop]
        for a, b in zip(at.tolist(), stop.tolist(), strict=True):
            while a < b:
                out.append(a)
                a = int(step[a])
        on_path[out] = True
        at = np.flatnonzero(on_path)
        return at, step[at]

    def _rest(self, first: int, last: int, best, step, starts, ends, scores, alone):
        """The best ways from the places of one run before ``last``, backwards."""
        lo, hi = int(starts[first]), int(starts[last])
        far = int(ends[lo:hi].max(initial=last))
        value = best[first : max(far, last) + 1].tolist()
        begin, end, score, single, to = starts[first : last + 1].tolist(), ends[lo:hi].tolist(), scores[lo:hi].tolist(), alone[first:last].tolist(), []
        for at in range(last - first - 1, -1, -1):
            most, end_of = (self.unknown + value[at + 1], at + 1) if single[at] else (-math.inf, at + 1)
            for w in range(begin[at] - lo, begin[at + 1] - lo):
                new = score[w] + value[end[w] - first]
                if new >= most:
                    most, end_of = new, end[w] - first
            value[at] = most
            to.append(end_of + first)
        best[first:last] = value[: last - first]
        step[first:last] = to[::-1]

    def cut(self, runs: list[str], mode: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and ends of the words of the runs, which stand one after the other with a place between, in the order of ``Words.cut``."""
        lows = [low if len(low := run.lower()) == len(run) else run for run in runs]
        size = np.array([len(x) for x in runs], np.int64)
        first = np.cumsum(size + 1) - size - 1
        points = np.full(int(size.sum()) + len(size), 0x110000, np.int64)
        inside = np.ones(len(points), bool)
        inside[first + size] = False
        points[inside] = _points("".join(lows))
        places, ends, scores = found = self.found(points)
        if mode == "full":
            long = ends > places + 1
            a, b = places[long], ends[long]
            cover = np.zeros(len(points) + 1, np.int64)
            np.add.at(cover, a, 1)
            np.add.at(cover, b, -1)
            single = np.flatnonzero(inside & (np.cumsum(cover)[:-1] == 0))
            a, b = np.concatenate([a, single]), np.concatenate([b, single + 1])
            order = np.argsort(a, kind="stable")
            return a[order], b[order]
        a, b = self.paths(first, size, found)
        if mode == "precise":
            return a, b
        held = []
        for n in (2, 3):
            at = places[ends == places + n]
            owner = np.searchsorted(a, at, "right") - 1
            fits = (b[owner] - a[owner] > n) & (at + n <= b[owner]) if len(a) else np.zeros(0, bool)
            held.append((at[fits], at[fits] + n, 3 * owner[fits] + n - 2))
        held.append((a, b, 3 * np.arange(len(a)) + 2))
        a, b, rank = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(rank, kind="stable")
        return a[order], b[order]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _texts(runs: list[str], a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The words at places of the runs, as written."""
    text = "\n".join(runs) + "\n"
    raw, points = np.frombuffer(text.encode(), np.uint8), _points(text)
    at = np.cumsum(np.concatenate([[0], 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)]))
    n = at[b] - at[a]
    ends = np.cumsum(n)
    data = raw[np.arange(int(n.sum())) + np.repeat(at[a] - (ends - n), n)]
    return pa.Array.from_buffers(pa.string(), len(a), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def segment(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "precise", most: int = 1_000_000) -> DataFrame:
    """``(key, words)`` of each row; a dictionary of more than ``most`` words is refused, for it is sent to all tasks.

    Letters are compared in lower case and returned as they are; marks and white
    space end a run and are no words.  A null or empty text has no words; very long
    texts and runs are taken whole; repeated rows are returned each.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if words.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} words")
    sent = docs.sparkSession.sparkContext.broadcast(Lattice({r.word: r.n for r in words.select("word", "n").collect()}))
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in pieces(batches, "text"):
            of = [RUN.findall(t.as_py() or "") for t in b.column(1)]
            runs = [r for some in of for r in some]
            starts, ends = known.cut(runs, mode)
            last = np.cumsum([sum(map(len, some)) + len(some) for some in of])  # where the next text's runs begin
            offsets = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(last, starts, "right"), minlength=len(of)))])
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _texts(runs, starts, ends))
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=[key, "words"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, words array<string>")
