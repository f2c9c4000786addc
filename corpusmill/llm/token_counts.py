"""Token counts by a compiled finite-state tokenizer.

The tokenizer becomes a deterministic transducer.  Its scanner splits at white
space and between classes of characters; its inner part reads the bytes of a
word and annotates each transition with the number of tokens that it emits
(``PrefixBpe``).  Whole words are memoised as one macro transition.

A text is cut into chunks of ``chunk`` characters.  A chunk is summed up by its
state map: white space brings every state to the start state, so the map is the
place of the first white space, up to which the incoming state still has to
read, the tokens emitted from there to the last white space, and the place of
that, from which the characters are the outgoing state.  Without white space
the map is its ends alone.  Maps compose associatively, and are composed by a
prefix scan in a logarithmic number of rounds; they hold places and no copies,
so a text's maps take no more room than its chunks are many.

No shuffle: a document is counted in the task that reads it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.prefix_bpe import PrefixBpe
from corpusmill.llm.text import held

#: Latin-1 has no character that composition changes, and lower case there is one to one.
_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa00-9a-zªµºß-öø-ÿ²³¹¼½¾]+")
#: Outcomes of the pattern's order: these letters after an apostrophe are taken before longer runs.
_ANY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class CountingTokenizer:
    """Counts the tokens of texts as the library does for such a JSON file.

    The file must hold byte-level BPE with an end-of-word suffix, a splitting
    pattern of the kind in ``_ANY`` and white space dropped.
    """

    def __init__(self, spec: str, chunk: int = 1 << 12, max_words: int = 800_000):
        from tokenizers import Tokenizer

        self.chunk, self.max_words, self.words = chunk, max_words, {}
        self.normalize = Tokenizer.from_str(spec).normalizer.normalize_str
        spec = json.loads(spec)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        assert spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == _ANY, "another splitting pattern"
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        letters = _byte_letters()
        bytes_of = {c: b for b, c in letters.items()}

        def spell(token: str) -> tuple:
            end = token.endswith(suffix)
            out = [bytes_of[c] for c in (token[: -len(suffix)] if end else token)]
            return (*out[:-1], out[-1] + 256) if end else tuple(out)

        vocab = model["vocab"]
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        special = {t["content"] for t in spec["added_tokens"]}
        self.bpe = PrefixBpe({i: spell(t) for t, i in vocab.items() if t not in special}, lambda a, b: merges.get((a, b)))

    def word(self, w: str) -> int:
        """The macro transition of one word: how many tokens it emits."""
        data, state, n = list(w.encode("utf-8", "surrogatepass")), self.bpe.start, 0
        data[-1] += 256  # the byte that ends a word is a symbol of its own
        for i, b in enumerate(data):
            hit = state.next.get(b) or self.bpe.step(state, b)
            if hit is None:  # beyond the compiled states
                n += self.bpe.walk(state.live, data[i:], [])[-1][2]
                break
            state, n = hit[0], n + hit[1]
        if len(self.words) >= self.max_words:
            self.words.clear()
        self.words[w] = n
        return n

    def run(self, text: str, find) -> int:
        """Tokens emitted for a piece of normalised text, from the start state."""
        get, word, n = self.words.get, self.word, 0
        for w in find(text):
            n += get(w) or word(w)
        return n

    def state_map(self, text: str, start: int, end: int, find) -> tuple:
        """(start, first, count, last, end) of a chunk, as places in the text; first, count and last are null without white space."""
        first = text.find(" ", start, end)
        if first < 0:
            return start, None, None, None, end
        last = text.rfind(" ", start, end)
        return start, first, self.run(text[first:last], find), last, end

    def compose(self, text: str, x: tuple, y: tuple, find) -> tuple:
        """The map of two neighbouring pieces; only what lies between their white space is still to be read."""
        if x[1] is None:
            return x[0], *y[1:]
        if y[1] is None:
            return *x[:4], y[4]
        return x[0], x[1], x[2] + self.run(text[x[3] : y[1]], find) + y[2], y[3], y[4]

    def scan(self, text: str, maps: list, find) -> list:
        """All prefix compositions, in a logarithmic number of rounds, each of which is independent piece by piece."""
        step = 1
        while step < len(maps):
            maps = maps[:step] + [self.compose(text, maps[i - step], maps[i], find) for i in range(step, len(maps))]
            step *= 2
        return maps

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        try:
            text.encode("latin-1")
            text, find = re.sub(r"[\t-\r \x85\xa0]", " ", text.lower()), _LATIN.findall
        except UnicodeEncodeError:
            import regex

            text, find = self.normalize(text), regex.compile(_ANY).findall
        maps = [self.state_map(text, i, min(i + self.chunk, len(text)), find) for i in range(0, len(text), self.chunk)]
        start, first, count, last, end = self.scan(text, maps, find)[-1] if maps else (0, None, None, None, 0)
        if first is None:
            return self.run(text, find)
        return self.run(text[start:first], find) + count + self.run(text[last:end], find)

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special string is one token."""
        if not text:
            return 0
        if "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def tokenizer(spec: str) -> CountingTokenizer:
    """One tokenizer for each worker process and file."""
    return held(("token_counts", spec), lambda: CountingTokenizer(spec))


def token_counts(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text``, with ``n_bytes`` (long, UTF-8) and ``name`` (long).

    Defined results: a null or empty text has 0 of both; other columns stay;
    columns that bear a name of the result are replaced; rows keep their number
    and are counted one by one; an empty table gives an empty table.
    """
    with open(path, encoding="utf-8") as f:  # a file of the driver; its content travels with the tasks
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    made = {text.lower(), "n_bytes", name.lower()}
    keep = [f for f in df.schema.fields if f.name.lower() not in made]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n_bytes long", f"`{name}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(spec.value).count
        for batch in batches:
            texts = batch.column(batch.num_columns - 2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], batch.column(batch.num_columns - 1), pa.array([count(t) for t in texts], pa.int64())], names=[*[f.name for f in keep], "n_bytes", name])

    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    return df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").alias("_text"), size.alias("_size")).mapInArrow(run, schema)


def op2_token_counts(spark, sf_dir: str, limit: int = 2048) -> DataFrame:
    """The contract's counts over all documents.

    A null or empty text has no tokens; very long texts are counted whole, in
    chunks; repeated rows are counted each; equal merges follow the library's
    order; an empty table gives an empty one; other columns are not read.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > limit)
