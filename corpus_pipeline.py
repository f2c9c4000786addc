"""Documents to training ids, in five stages; each works on all that its predecessor kept.

1. quality rules: documents that break a rule go.
2. n-gram Jaccard join (five words, 80 percent): the smallest doc_id of each class stays.
3. benchmark decontamination: documents in which a test item occurs go.
4. secret scans: the values of secrets are replaced in the text.
5. SentencePiece encoding: the ids of each text take the text's place.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.decontamination import drop_leaks
from corpusmill.llm.ngram_join import keep_one
from corpusmill.llm.pieces import encode_pieces
from corpusmill.llm.quality_rules import keep_good
from corpusmill.llm.secrets import redact_secrets
from corpusmill.storage import cut


def good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that break no quality rule.

    A null or empty text has no words, and goes; very long texts are measured
    whole; ties and repeated rows are judged one by one; an empty table gives an
    empty one; columns keep their values, also those named like a measure.
    """
    return keep_good(docs)


def distinct(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id.

    A null or empty text has no n-grams and is its own class; very long texts are
    compared whole; rows that repeat a doc_id and its text leave one, and of
    texts of one class at its smallest doc_id one stays, whatever the layout; a row
    without a doc_id stays; an empty table gives an empty one; other columns are
    carried along.
    """
    return keep_one(docs, k=5, percent=80)


def uncontaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item occurs, at up to a tenth of its characters changed.

    A null or empty text holds no item, and stays; very long texts are searched
    whole; repeated rows and items are searched one by one; without documents or
    items all rows stay; other columns are carried along.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; ``n_chars`` follows the text.

    A null text stays null, and its ``n_chars`` is null; an empty one stays
    empty; very long texts are scanned whole; equal texts get equal results,
    repeated rows stay; an empty table gives an empty one; other columns are
    carried along, whatever their names.
    """
    out = redact_secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents, in place of the text.

    A null or empty text has no ids; very long texts are encoded whole; repeated
    rows stay; an empty table gives an empty one; columns named like a result
    (``ids``, ``n_ids``, ``round_trip``) are replaced, others stay.
    """
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", good),
    ("ngram_join", distinct),
    ("decontamination", uncontaminated),
    ("secret_scan", redacted),
    ("sentencepiece", encoded),
]

#: Classes of near duplicates, edit distances and piece ids have no SQL; tests hold a brute-force twin.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
