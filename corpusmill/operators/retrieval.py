"""Retrieval: lexical, dense and hybrid search of a table of queries at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.synonyms import expand
from corpusmill.functions.text import char_jaccard, words_and_cjk
from corpusmill.storage import cut

K1, B = 1.5, 0.75
DENSE_WEIGHT, LEXICAL_WEIGHT, GATE, WEAK_LEXICAL, SAME_TITLE, HYPOTHETICAL = 0.7, 0.3, 0.35, 0.1, 0.85, 0.4


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays.

    The length goes into the inner function as a field: an expression would be computed for each number anew.
    """
    n = F.sqrt(dot(v, v))
    with_length = F.array(F.struct(v.alias("v"), F.when(n == 0, 1.0).otherwise(n).alias("n")))
    return F.get(F.transform(with_length, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"])), 0)


def top(df: DataFrame, k: int, score: str, tie: str = "doc_id", by: str = "qid") -> DataFrame:
    """The ``k`` best rows of each query with their ``rank``; each task keeps ``k`` before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def lexical_index(docs: DataFrame, text: str = "text", segment=words_and_cjk) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``postings`` (term, doc_id, tf, dl), ``df`` (term, df) and ``stats`` (one row: n, avgdl)."""
    t = docs.select("doc_id", segment(F.col(text)).alias("t")).select("doc_id", "t", F.size("t").alias("dl"))
    postings = t.select("doc_id", "dl", F.explode("t").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    return postings, postings.groupBy("term").agg(F.count("*").alias("df")), t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, text: str = "text", query: str = "query", segment=words_and_cjk) -> DataFrame:
    """``(qid, doc_id, bm25)`` of documents that share a term; a term that a query repeats counts as often.

    Only postings of the queries' terms are made: terms meet before anything is
    grouped by document.
    """
    asked = queries.select("qid", F.explode(segment(F.col(query))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    t = docs.select("doc_id", segment(F.col(text)).alias("t"))
    stats = t.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    postings = t.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    x = postings.join(df, "term").join(asked, "term").join(F.broadcast(stats))  # stats is one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return x.groupBy("qid", "doc_id").agg(F.sum(part * F.col("times")).alias("bm25"))


def dense(docs: DataFrame, queries: DataFrame, vector: str = "embedding", query: str = "vector", block_bytes: int = 16 << 20) -> DataFrame:
    """``(qid, doc_id, dense)``: inner products of all queries and documents.

    Queries are held against all rows in blocks of about ``block_bytes`` of
    numbers; the driver sends a block at a time, and each is a pass.  A task
    multiplies batches of rows with the block.  The product is null where a vector
    is null, holds one, or has another length.
    """
    q = queries.select("qid", F.col(query).cast("array<double>").alias("_q"))
    blocks = _blocks(q, block_bytes)
    rows = docs.select("doc_id", F.col(vector).cast("array<double>").alias("_d"))
    types = f"qid {queries.schema['qid'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, dense double"
    block = lambda i: q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow()
    return reduce(DataFrame.union, [rows.mapInArrow(_products(block(i)), types) for i in range(blocks)])


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vector that occurs, without null ones: which rows have it, and their numbers."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    numbers = pc.is_valid(column.flatten()).to_numpy(zero_copy_only=False)
    if not numbers.all():
        size = size.copy()
        ends = np.cumsum(np.maximum(size, 0))
        whole = np.append(0, np.cumsum(numbers))
        size[whole[ends] - whole[ends - np.maximum(size, 0)] < size] = -1
    found = {}
    for n in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == n)
        found[n] = at, np.asarray(column.take(pa.array(at)).flatten(), float).reshape(len(at), n)
    return found


def _products(block: pa.Table, most: int = 500_000):
    """Rows ``(doc_id, vector)`` against the block's queries, about ``most`` products in a batch."""
    ids = block.column(0).combine_chunks()
    asked = _by_length(block.column(1).combine_chunks())

    def run(batches):
        step = max(1, most // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows if len(ids) else 0, step):
                some = batch.slice(at, step)
                scores, known = np.zeros((some.num_rows, len(ids))), np.zeros((some.num_rows, len(ids)), bool)
                for n, (i, x) in _by_length(some.column(1)).items():
                    if n in asked:
                        scores[np.ix_(i, asked[n][0])] = x @ asked[n][1].T
                        known[np.ix_(i, asked[n][0])] = True
                both = ids.take(pa.array(np.tile(np.arange(len(ids)), some.num_rows))), some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), len(ids))))
                yield pa.RecordBatch.from_arrays([*both, pa.array(scores.ravel(), mask=~known.ravel(), from_pandas=False)], names=["qid", "doc_id", "dense"])

    return run


def _blocks(queries: DataFrame, block_bytes: int) -> int:
    """The number of blocks in which queries ``(qid, _q)`` take about so many bytes of doubles each."""
    n, size = queries.agg(F.count("*"), F.coalesce(F.max(F.size("_q")), F.lit(1))).first()
    return max(1, -(-n * size * 8 // block_bytes))


def nearest(docs: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", query: str = "vector", block_bytes: int = 16 << 20) -> DataFrame:
    """``(qid, doc_id, dense, rank)``: the ``k`` documents of the largest inner product with each query; ties by doc_id.

    Queries are held against all rows in blocks of about ``block_bytes`` of
    numbers, so what is sent to the tasks has a bound; a block is a pass.  A task
    multiplies batches of rows with the block, keeps ``k`` for each query, and
    sends no more than these.
    """
    q = queries.select("qid", F.col(query).cast("array<double>").alias("_q"))
    blocks = _blocks(q, block_bytes)
    types = f"qid {queries.schema['qid'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, dense double"
    part = docs.select("doc_id", F.col(vector).cast("array<double>").alias("_d")).where("doc_id IS NOT NULL AND _d IS NOT NULL")
    if blocks == 1:
        return top(part.mapInArrow(_kept(q.collect(), k), types), k, "dense")
    found = None
    for i in range(blocks):  # the driver holds one block at a time
        some = cut(part.mapInArrow(_kept(q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).collect(), k), types), "nearest")
        found = some if found is None else found.union(some)
    return top(found, k, "dense")


def _kept(block: list, k: int):
    """What a task does with its rows: batches of them against the block's queries."""
    ids = [r["qid"] for r in block]
    asked = np.array([r["_q"] for r in block], float)

    def run(batches):
        best: list[list] = [[] for _ in ids]
        least = np.full(len(ids), -np.inf)
        kind = None
        for batch in batches:
            if not batch.num_rows or not ids:
                continue
            kind = batch.column(0).type
            own = batch.column(0)
            scores = asked @ np.stack(batch.column(1).to_numpy(zero_copy_only=False)).T
            n = scores.shape[1]
            bound = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k]) if n > k else least
            j, i = np.nonzero(scores >= bound[:, None])
            cuts = np.searchsorted(j, np.arange(len(ids) + 1))
            for x in np.flatnonzero(np.diff(cuts)).tolist():
                at = i[cuts[x] : cuts[x + 1]]
                best[x] = sorted(best[x] + list(zip((-scores[x, at]).tolist(), own.take(pa.array(at)).to_pylist(), strict=True)))[:k]
                if len(best[x]) == k:
                    least[x] = -best[x][-1][0]
        for x, held in zip(ids, best, strict=True):
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(held)), pa.array([d for _, d in held], kind), pa.array([-s for s, _ in held])], names=["qid", "doc_id", "dense"])

    return run


def ivf_top(docs: DataFrame, queries: DataFrame, k: int, nlist: int = 707, nprobe: int = 64, vector: str = "embedding", query: str = "vector", seed: int = 42, flat_below: int = 10_000, sample: int = 200_000) -> DataFrame:
    """Top ``k`` by probing the ``nprobe`` nearest of ``nlist`` clusters; all rows below ``flat_below``.

    The clusters are fitted on at most ``sample`` rows, and every row is indexed.
    """
    n = docs.count()
    if n < flat_below:
        return nearest(docs, queries, k, vector, query)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    made = docs.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    some = made if n <= sample else made.orderBy(F.xxhash64("doc_id")).limit(sample)
    model = KMeans(k=min(nlist, max(1, n // 10)), seed=seed, featuresCol="_v", predictionCol="_c", maxIter=10).fit(some)
    centres = docs.sparkSession.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(model.clusterCenters())], "_c int, _centre array<double>")
    probes = queries.select("qid", F.col(query).alias("_q")).join(F.broadcast(centres)).withColumn("_s", dot(F.col("_q"), F.col("_centre")))
    probes = probes.withColumn("_r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("_s"), "_c"))).where(F.col("_r") <= nprobe).select("qid", "_q", "_c")
    hits = model.transform(made).select("doc_id", F.col(vector).alias("_d"), "_c").join(probes, "_c")
    return top(hits.select("qid", "doc_id", dot(F.col("_d"), F.col("_q")).alias("dense")), k, "dense")


def normalised(df: DataFrame, score: str, out: str) -> DataFrame:
    """``out``: the score from 0 to 1 within each query, its range taken as 1 if flat."""
    w = W.partitionBy("qid")
    span = F.max(score).over(w) - F.min(score).over(w)
    return df.withColumn(out, (F.col(score) - F.min(score).over(w)) / F.when(span > 0, span).otherwise(1.0))


def distinct_titles(hits: DataFrame, k: int, same: float = SAME_TITLE) -> DataFrame:
    """The first ``k`` hits of each query whose titles differ; a blank title differs from all.

    A fold over each query's hits in rank order, of which there are few.
    """
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title", "score"))).alias("h"))
    kind = rows.schema["h"].dataType.simpleString()
    keep = F.aggregate("h", F.expr(f"CAST(array() AS {kind})"), lambda done, x: F.when(F.exists(done, lambda y: char_jaccard(y["title"], x["title"]) >= same), done).otherwise(F.concat(done, F.array(x))))
    keep = F.col("h") if same >= 1.0 else keep
    return rows.select("qid", F.posexplode(F.slice(keep, 1, k)).alias("p", "x")).select("qid", (F.col("p") + 1).alias("rank"), "x.doc_id", "x.title", "x.score")


def passes(dense: Column, lexical: Column, gate: float = GATE) -> Column:
    """Whether a hit stays: its dense score reaches the gate, or its share of the best lexical score is not weak."""
    return ~((dense < gate) & (lexical < WEAK_LEXICAL))


def fuse(candidates: DataFrame, docs: DataFrame, k: int, title: Column, gate: float = GATE) -> DataFrame:
    """Fused, gated, ranked and told apart: candidates with ``dense``, ``dense_norm`` and ``bm25``, zero where absent."""
    w = W.partitionBy("qid")
    most = F.max("bm25_max").over(w)
    x = candidates.withColumn("lex", F.col("bm25") / F.when(most > 0, most).otherwise(1.0))
    x = x.where(passes(F.col("dense"), F.col("lex"), gate)).withColumn("score", F.round(DENSE_WEIGHT * F.col("dense_norm") + LEXICAL_WEIGHT * F.col("lex"), 4))
    x = x.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.desc("dense_norm"), "doc_id")))
    return distinct_titles(x.join(docs.select("doc_id", title.alias("title")), "doc_id"), k)


def hybrid(docs: DataFrame, queries: DataFrame, k: int, title: Column, vector: str = "embedding", text: str = "text", synonyms: bool = True) -> DataFrame:
    """The lexical search takes each query with its synonyms.  Dense candidates, the best lexical ones besides, fused: ``(qid, rank, doc_id, title, score)``."""
    from corpusmill.operators import lexical

    fetch = 3 * k
    near = cut(normalised(nearest(docs, queries, fetch, vector).drop("rank"), "dense", "dense_norm"), "near")
    found = lexical.search(lexical.build(docs, text), _asking(queries, near, synonyms), fetch, wanted="_wanted")
    best = lexical.best(found, fetch)
    most = best.groupBy("qid").agg(F.max("bm25").alias("bm25_max"))
    lex = found.where("wanted").select("qid", "doc_id", "bm25").union(best.select("qid", "doc_id", "bm25")).groupBy("qid", "doc_id").agg(F.max("bm25").alias("bm25"))
    both = near.join(lex, ["qid", "doc_id"], "full_outer").join(most, "qid", "left")
    return fuse(both.na.fill(0.0, ["dense", "dense_norm", "bm25", "bm25_max"]), docs, k, title)


def hyde(docs: DataFrame, queries: DataFrame, k: int, title: Column, vector: str = "embedding", text: str = "text", weight: float = HYPOTHETICAL, synonyms: bool = True) -> DataFrame:
    """As ``hybrid``, with a second vector for each query whose scores count ``weight``, and no lexical candidates."""
    from corpusmill.operators import lexical

    fetch = 3 * k
    a = nearest(docs, queries, fetch, vector).select("qid", "doc_id", "dense")
    b = nearest(docs, queries, fetch, vector, "hypothetical").select("qid", "doc_id", (weight * F.col("dense")).alias("dense"))
    near = cut(normalised(a.union(b).groupBy("qid", "doc_id").agg(F.max("dense").alias("dense")), "dense", "dense_norm"), "near")
    found = lexical.search(lexical.build(docs, text), _asking(queries, near, synonyms), 1, wanted="_wanted")
    most = lexical.best(found, 1).select("qid", F.col("bm25").alias("bm25_max"))
    both = near.join(found.where("wanted").select("qid", "doc_id", "bm25"), ["qid", "doc_id"], "left").join(most, "qid", "left")
    return fuse(both.na.fill(0.0, ["bm25", "bm25_max"]), docs, k, title)


def _asking(queries: DataFrame, near: DataFrame, synonyms: bool) -> DataFrame:
    """The queries for the lexical search, each with its dense candidates, of which there are a few."""
    wanted = near.groupBy("qid").agg(F.collect_list("doc_id").alias("_wanted"))
    asked = queries.withColumn("query", expand(F.col("query"))) if synonyms else queries
    return asked.join(wanted, "qid", "left").withColumn("_wanted", F.coalesce("_wanted", F.array().cast(wanted.schema["_wanted"].dataType)))
