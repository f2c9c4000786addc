"""Quality rules: a threshold table that becomes one projection.

Each rule is a measure with a lower and an upper bound.  All measures are
built-in column expressions over the whole text, so that the verdict is made
inside the scan's stage: no shuffle, no user function.

Defined results: a null text counts as empty; an empty text has zero for every
measure and fails ``n_words``; extra columns are kept as they are, and columns
of the input that bear a name of the result are replaced; repeated rows are
judged one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import free_name, ratio, settle, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it its not of on or that the this to was were which with you "
    "aber als am an auch auf aus bei das dem den der des die ein eine einen einer es für haben hat ich im in ist mit "
    "nicht sich sie sind so und von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il la le les mais ne nous ou par pas plus pour que qui sa "
    "se ses son sont sur un une vous "
    "al como con del el ella en es esta este la las lo los más no para pero por que se sin su sus un una y"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` must hold; ``None`` leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production table.  The first two rows are the base of the contract.
RULES = (
    Rule("n_words", low=50),
    Rule("repeat_percent", high=50),
    Rule("mean_word_chars", low=2, high=14),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.7),
)


def measures(df: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """``df`` with a column for each measure.

    Counts (long): ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` and
    ``n_dup_lines`` (lines with a word, and those equal to an earlier one),
    ``n_stop_words``, ``n_repeat_words`` (words inside a three-word window that
    occurs at least twice).  Ratios (double): ``repeat_percent``,
    ``mean_word_chars``, ``symbol_ratio``, ``stop_word_ratio``,
    ``dup_line_ratio``.

    Windows are compared after a sort of (window, place) pairs, so the work
    for a text of n words is n log n however often words repeat.
    """
    w, lines, windows, places = (free_name(df.columns, x) for x in ("_words", "_lines", "_windows", "_places"))
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n = F.size(w)

    def repeated(x: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(F.get(F.col(windows), j)["w"] == x["w"], F.lit(False))
        return same(i - 1) | same(i + 1)

    df = df.withColumn(w, words(F.col(f"`{text}`"))).withColumn(lines, F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    window = lambda i: F.concat_ws(" ", F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2))
    df = df.withColumn(windows, F.when(n < 3, F.expr("array()").cast("array<struct<w:string,p:int>>")).otherwise(
        F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(window(i).alias("w"), i.alias("p"))))))
    df = df.withColumn(places, F.sort_array(F.transform(F.filter(F.col(windows), repeated), lambda x: x["p"])))
    covered = F.transform(F.col(places), lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col(places), i + 1) - p, F.lit(3))))
    df = settle(df, {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(value, "[^" + SYMBOLS + "]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter(F.col(w), lambda x: x.isin(*dict.fromkeys(stop_words)))).cast("long") if stop_words else F.lit(0).cast("long"),
        "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
    }).drop(w, lines, windows, places)
    return df.withColumns({
        "repeat_percent": 100 * ratio(F.col("n_repeat_words"), F.col("n_words")),
        "mean_word_chars": ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_word_ratio": ratio(F.col("n_stop_words"), F.col("n_words")),
        "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
    })


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """The verdict and the list of failed measures, as columns over ``measures``."""
    def broken(r: Rule) -> Column:
        low = F.lit(False) if r.low is None else F.col(r.measure) < r.low
        return low | (F.lit(False) if r.high is None else F.col(r.measure) > r.high)

    if not rules:
        return F.lit(True), F.expr("array()").cast("array<string>")
    failed = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.measure)) for r in rules]))
    return ~F.greatest(*[broken(r) for r in rules], F.lit(False)), failed


def quality_rules(df: DataFrame, text: str = "text", rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """``df`` with its measures, ``kept`` (boolean) and ``failed`` (names of broken rules)."""
    kept, failed = compile_rules(rules)
    return measures(df, text, stop_words).withColumns({"kept": kept, "failed": failed})


def keep_good(df: DataFrame, text: str = "text", rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """The rows of ``df`` that break no rule, with their own columns whatever these are called."""
    apart = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return quality_rules(apart, "text", rules, stop_words).where("kept").select("row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of the rules over all documents.

    A null or empty text has no words and is not kept; very long texts are measured
    whole; each row is judged by itself, so ties and repeated rows do not matter; an
    empty table gives an empty one; other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & F.col("kept")).alias("kept"))


def _sql_list(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in dict.fromkeys(items))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), one AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), win AS (
  SELECT doc_id, p, x || ' ' || lead(x) OVER near || ' ' || lead(x, 2) OVER near AS g FROM one WINDOW near AS (PARTITION BY doc_id ORDER BY p)
), rep AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_sql_list(STOP_WORDS)})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 14 * n_words
         AND n_symbols::DOUBLE / n_words <= 0.1 AND n_stop_words::DOUBLE / n_words >= 0.02
         AND n_dup_lines::DOUBLE / greatest(n_lines, 1) <= 0.7 AS kept
FROM b
"""
