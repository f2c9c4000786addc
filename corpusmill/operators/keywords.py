"""Keywords of documents by TF-IDF, and by rank in the graph of neighbouring words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.batches import pieces
from corpusmill.storage import cut

#: Words, of those in most documents, whose frequency every task knows; bytes of texts that a task counts at once.
KNOWN, PIECE = 50_000, 1 << 22


def tf_idf(docs: DataFrame, key: str, words: str, k: int = 10) -> DataFrame:
    """``(key, word, score, rank)``: the ``k`` words of the highest frequency times inverse document frequency.

    Words are counted within their row.  Every task knows the frequencies of the
    ``KNOWN`` most frequent words and a bound for all others, so each word's score
    has bounds; only words whose upper bound reaches the row's ``k``-th lower one
    become rows, and meet their frequency in the join.  Rows of one key and length
    count as one document.
    """
    n = docs.count()
    docs = _one_row_each(docs.select(key, F.size(words).alias("_size"), F.col(words).alias("w")), key).where("size(w) > 0")
    df = cut(docs.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("_df")), "frequencies")
    known = df.orderBy(F.desc("_df"), "word").limit(KNOWN).toArrow()
    kind = docs.schema[key].dataType.simpleString()
    may = docs.mapInArrow(_candidates(known, n, k), f"`{key}` {kind}, _size int, word string, _tf long")
    x = may.join(df, "word").withColumn("score", F.round(F.col("_tf") / F.col("_size") * F.log((F.lit(n) + 1) / (F.col("_df") + 1)), 9))
    return x.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "word"))).where(F.col("rank") <= k).select(key, "word", "score", "rank")


def _one_row_each(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with rows of one key and number of words put together."""
    twice = cut(docs.groupBy(F.col(key).alias("_k")).count().where("count > 1").select("_k"), "twice")
    if twice.isEmpty():
        return docs
    same = F.col(key).eqNullSafe(F.col("_k"))
    merged = docs.join(twice, same, "left_semi").groupBy(key, "_size").agg(F.flatten(F.collect_list("w")).alias("w"))
    return docs.join(twice, same, "left_anti").union(merged)


def _candidates(known, n: int, k: int):
    """Rows ``(key, size, words)`` to the words that may be among the ``k`` best of a row, with their counts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    frequent, often = known.column(0).combine_chunks(), known.column(1).to_numpy()
    rarer = int(often[-1]) if len(often) == KNOWN else 1  # no other word is in more documents

    def run(batches):
        for b in pieces(batches, "w", most=PIECE):
            coded = b.column(2).flatten().dictionary_encode()
            own = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
            code = coded.indices.fill_null(-1).to_numpy()
            own, code = own[code >= 0], code[code >= 0]
            if not len(own):
                continue
            pair, tf = np.unique(own * len(coded.dictionary) + code, return_counts=True)
            own, code = np.divmod(pair, len(coded.dictionary))
            at = pc.index_in(coded.dictionary, value_set=frequent.cast(coded.dictionary.type))
            least = np.where(at.is_valid().to_numpy(zero_copy_only=False), often[at.fill_null(0).to_numpy()], 0)[code]
            share = tf / b.column(1).to_numpy()[own]
            high = share * np.log((n + 1) / (np.maximum(least, 1) + 1))
            low = share * np.log((n + 1) / (np.where(least > 0, least, rarer) + 1))
            order = np.lexsort((-low, own))
            start = np.searchsorted(own, np.arange(b.num_rows))
            place = start + k - 1
            ends = np.append(start[1:], len(own))
            bound = np.where(place < ends, low[order[np.minimum(place, len(own) - 1)]], -1.0)
            some = high >= bound[own] - 1e-8  # scores are rounded to nine places
            at = pa.array(own[some])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), coded.dictionary.take(pa.array(code[some])), pa.array(tf[some], pa.int64())], names=[*b.schema.names[:2], "word", "_tf"])

    return run


def text_rank(docs: DataFrame, key: str, words: str, k: int = 10, window: int = 5, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """``(key, word, rank)``: the ``k`` highest words of each document's graph of words within ``window``."""
    at = docs.select(key, F.posexplode(words).alias("p", "w"))
    near = docs.select(key, F.posexplode(words).alias("p", "w")).select(key, F.col("w").alias("v"), "p", F.explode(F.array(*[F.lit(i) for i in range(1, window)])).alias("d")).withColumn("p", F.col("p") + F.col("d"))
    pair = at.join(near, [key, "p"]).where("w <> v").select(key, "w", "v")
    edges = pair.union(pair.select(key, F.col("v").alias("w"), F.col("w").alias("v"))).groupBy(key, "w", "v").agg(F.count("*").alias("c"))
    edges = cut(edges.withColumn("c", F.col("c") / F.sum("c").over(W.partitionBy(key, "w"))), "graph")
    score = edges.select(key, F.col("w").alias("word")).distinct().withColumn("s", F.lit(1.0))
    for _ in range(rounds):
        moved = edges.join(score.withColumnRenamed("word", "w"), [key, "w"]).groupBy(key, F.col("v").alias("word")).agg(((1 - damping) + damping * F.sum(F.col("c") * F.col("s"))).alias("s"))
        score = cut(moved, "rank")
    return score.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.round("s", 9)), "word"))).where(F.col("rank") <= k).select(key, "word", "rank")
