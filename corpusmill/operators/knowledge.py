"""Documents of a knowledge base from rows of questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import strip, truncate
from corpusmill.operators.balance import ranked

#: What is embedded: the question, the answer, or both.
EMBED = ("question", "answer", "question_answer")


def knowledge_rows(df: DataFrame, key: str, question: str = "instruction", answer: str = "output", embed: str = "question", longest: int = 512, least_answer: int = 10, most: int | None = None) -> DataFrame:
    """``(key, title, contents, embed_text)`` of rows with a question, and an answer of ``least_answer`` characters.

    Both are cut to ``longest`` characters, at a sentence's end where one is
    near.  With ``most`` only so many stay, the first in the order of ``key``;
    they are counted by ranges of keys, and not brought to one task.
    """
    if embed not in EMBED:
        raise ValueError(f"unknown part to embed: {embed}")
    rows = df.select(key, strip(F.coalesce(F.col(question), F.lit(""))).alias("_q"), strip(F.coalesce(F.col(answer), F.lit(""))).alias("_a"))
    rows = rows.where((F.col("_q") != "") & (F.col("_a") != "") & (F.length("_a") >= least_answer))
    if most is not None:
        rows = ranked(rows, None, key, "_place").where(F.col("_place") <= most)
    q, a = truncate(F.col("_q"), longest), truncate(F.col("_a"), longest)
    text = {"question": q, "answer": a, "question_answer": F.concat_ws(" ", q, a)}[embed]
    return rows.select(key, q.alias("title"), F.concat(F.lit("问题："), q, F.lit("\n答案："), a).alias("contents"), text.alias("embed_text"))
