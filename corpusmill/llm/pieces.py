"""SentencePiece encoding and decoding by a streaming search over pieces.

The search keeps a window of backpointers, one for each position, that is
bounded by the longest piece: a position is live while a longer piece may still
begin there.  Whenever the paths from all live positions meet in one boundary,
the ids before it are committed and their backpointers dropped.

The model is of the BPE kind, so what a path scores is not a sum of piece
scores: a backpointer is taken where the piece forms a valid pair with the one
before it (``PrefixBpe``).  Thus each position has one backpointer, and ids are
those of the library.  A plain sum of scores would give other ids.

Runs of the space symbol are the exception, since the model gives all their
pieces one score; they bind to the right of all other merges, and are merged
from the left.  Characters without a piece become their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.prefix_bpe import DEPTH, TOKEN, PrefixBpe
from corpusmill.llm.text import held

SPACE = "▁"


class PieceCodec:
    """Encodes and decodes as the library does for a BPE model with byte fallback.

    Wanted of the model: identity normalisation, a dummy prefix, no removal of
    white space, and the space symbol only at the front of a piece or alone.
    """

    def __init__(self, model: bytes, max_segments: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bytes_ = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes_)}
        normal = {pieces[i]: i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
        assert not any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in normal), "the space symbol inside a piece"
        self.text_of: list = [p.replace(SPACE, " ") for p in pieces]
        for b, i in enumerate(self.bytes_):  # a byte of ASCII is a character whatever stands by it
            self.text_of[i] = chr(b) if b < 128 else None
        rank = {i: -lib.get_score(i) for i in normal.values()}
        spell = {i: tuple(p) for p, i in normal.items()}
        runs = {len(p) for p in normal if not p.strip(SPACE)}
        self.run_id = {k: normal[SPACE * k] for k in runs}

        def merge(a, b):
            got = normal.get("".join(spell[a]) + "".join(spell[b]))
            return None if got is None else (rank[got], got)

        self.space = normal[SPACE]
        self.bpe = PrefixBpe({i: s for i, s in spell.items() if len(s) < 2 or set(s) != {SPACE}}, merge)
        self.size = {i: len(x) for i, x in self.bpe.spell.items()}
        self.segments: dict = {}
        self.older: dict = {}
        self.max_segments = max_segments
        self.find = self._segments(normal)
        self.kind = "H" if n <= 1 << 16 else "I"

    @staticmethod
    def _segments(normal: dict):
        """A function that cuts a text, spaces being U+0020, where no piece can span.

        That is before spaces, at line ends unless a piece holds one, and
        between a letter and a mark that no piece has right behind a letter.
        """
        pairs = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        letter = re.compile(f"[{letters}]")
        marks = "".join(re.escape(m) for m in ".,!?;:" if not any(p[1] == m and letter.match(p[0]) for p in pairs))
        line = "" if any("\n" in p for p in normal) else "\n"
        plain = f" *[{letters}]+(?=[{marks}])|" * bool(marks)
        return re.compile(f"{plain} +[^ {line}]*|[^ {line}]+" + f"|{line}" * bool(line)).findall

    def run(self, k: int) -> tuple:
        """The ids of ``k`` space symbols: equal scores, so the leftmost merge first."""
        sizes, nxt, prev = [1] * k, list(range(1, k + 1)), list(range(-1, k - 1))
        queue = [i for i in range(k - 1) if 2 in self.run_id]
        alive = [True] * k
        while queue:
            i = heapq.heappop(queue)
            j = nxt[i] if alive[i] else k
            if j >= k or sizes[i] + sizes[j] not in self.run_id:
                continue
            sizes[i] += sizes[j]
            alive[j], nxt[i] = False, nxt[j]
            if nxt[j] < k:
                prev[nxt[j]] = i
            for x in (i, prev[i]):
                if x >= 0 and alive[x] and nxt[x] < k:
                    heapq.heappush(queue, x)
        return tuple(self.run_id[sizes[i]] for i in range(k) if alive[i])

    def stream(self, symbols) -> Iterator[int]:
        """The ids of symbols without runs of spaces, each as soon as it is settled."""
        bpe, base = self.bpe, self.bpe.base
        live, back = bpe.start.live, []  # back[p]: the piece that ends behind position p of the window

        def settled(live) -> int:
            ends = sorted(len(back) - node[DEPTH] for node, _, _ in live)
            paths = []
            for at in ends:
                path = set()
                while at > 0:
                    path.add(at)
                    at -= len(bpe.spell[back[at - 1]])
                paths.append(path)
            return max(set.intersection(*paths), default=0)

        def commit(at: int) -> list:
            out, p = [], at
            while p > 0:
                out.append(back[p - 1])
                p -= len(bpe.spell[back[p - 1]])
            del back[:at]
            return out[::-1]

        for c in symbols:
            if c not in base:
                yield from commit(len(back))
                yield from (self.bytes_[b] for b in c.encode("utf-8", "replace"))
                live = bpe.start.live
                continue
            live = bpe.walk(live, (c,), back)
            live = [(n, t, 0) for n, t, _ in live if len(n) > 1 + (TOKEN in n)]
            if len(live) == 1:
                yield from commit(len(back))
            elif len(back) >= 4 * bpe.longest and len(back) % bpe.longest == 0:
                yield from commit(settled(live))
        yield from commit(len(back))

    def short(self, symbols: str) -> tuple:
        """``stream`` for a window that holds all symbols."""
        step, state, back = self.bpe.step, self.bpe.start, []
        try:
            for i, c in enumerate(symbols):
                hit = state.next.get(c) or step(state, c)
                if hit is None:  # beyond the compiled states
                    self.bpe.walk(state.live, symbols[i:], back)
                    break
                state = hit[0]
                back.append(hit[2])
        except KeyError:  # a character without a piece
            return tuple(self.stream(symbols))
        out, p, size = [], len(back), self.size
        while p > 0:
            out.append(back[p - 1])
            p -= size[back[p - 1]]
        return tuple(out[::-1])

    def segment(self, s: str) -> bytes:
        """The ids of spaces and the word behind them, packed."""
        if s in self.older:
            found = self.segments[s] = self.older[s]
            return found
        key, s = s, s.replace(" ", SPACE)
        word = s.lstrip(SPACE)
        k = len(s) - len(word)
        tail = s[max(0, k - 1) :] if word else ""
        ids = tuple(self.stream(tail)) if len(tail) > 48 else self.short(tail)
        if k > 1 or not word:
            bound = bool(word) and ids[0] != self.space
            ids = self.run(k - 1) + ids if bound else self.run(k) + ids[bool(word) :]
        found = array(self.kind, ids).tobytes()
        if len(s) <= 48:
            self.segments[key] = found
        return found

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text as machine integers of ``kind``; none for null and the empty text."""
        if not text:
            return b""
        if len(self.segments) >= self.max_segments:  # what is met again is carried over
            self.older, self.segments = self.segments, {}
        get, segment = self.segments.get, self.segment
        return b"".join([get(s) or segment(s) for s in self.find(" " + text.replace(SPACE, " "))])

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text."""
        return array(self.kind, self.packed(text)).tolist()

    def decode(self, ids) -> str:
        """The text of ids, without the dummy prefix; broken bytes become U+FFFD."""
        texts, byte_of = self.text_of, self.byte_of
        try:
            text = "".join(map(texts.__getitem__, ids))
        except TypeError:  # a byte beyond ASCII
            parts, held = [], bytearray()
            for i in ids:
                if i in byte_of:
                    held.append(byte_of[i])
                    continue
                if held:
                    parts.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                parts.append(texts[i])
            text = "".join(parts) + held.decode("utf-8", "replace")
        return text.removeprefix(" ")


def codec(model: bytes) -> PieceCodec:
    """One codec for each worker process and model."""
    return held(("pieces", model), lambda: PieceCodec(model))


def encode_pieces(df: DataFrame, path: str, text: str = "text", check: bool = True, rows: int = 256) -> DataFrame:
    """``df`` without ``text``, with ``n_ids`` (long), ``ids`` (array<int>) and ``round_trip`` (boolean).

    ``round_trip``: decoding gives the text again, the space symbol itself read
    as a space; null without ``check``.  Defined results: a null or empty text
    has no ids and makes the round trip; other columns stay, and those that bear
    a name of the result are replaced; repeated rows stay; an empty table gives
    an empty one.  Results leave in slices of ``rows`` rows, so memory is bounded.
    """
    with open(path, "rb") as f:  # a file of the driver; its content travels with the tasks
        model = df.sparkSession.sparkContext.broadcast(f.read())
    made = {text.lower(), "n_ids", "ids", "round_trip"}
    keep = [f for f in df.schema.fields if f.name.lower() not in made]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n_ids long", "ids array<int>", "round_trip boolean"])
    names = [*[f.name for f in keep], "n_ids", "ids", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                ids = [np.frombuffer(own.packed(t), own.kind) for t in texts]
                same = [own.decode(x.tolist()) == t.replace(SPACE, " ") if check else None for x, t in zip(ids, texts, strict=True)]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate([*ids, np.empty(0, own.kind)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes), lists, pa.array(same, pa.bool_())], names=names)

    return df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` without ``ids``, with the decoded ``text``; null ids give null."""
    with open(path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [f for f in df.schema.fields if f.name.lower() not in {ids.lower(), text.lower()}]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*[f.name for f in keep], text])

    return df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{ids}`").alias("_ids")).mapInArrow(run, schema)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The ids of all documents, and whether decoding gives the text again.

    A null or empty text has no ids; very long texts are encoded whole; of equal
    scores the library's choice is taken; repeated rows are encoded each; an empty
    table gives an empty one; other columns are not read.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
