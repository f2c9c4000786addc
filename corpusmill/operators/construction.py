"""What a model wrote, taken apart, tested and made into training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import tags as G
from corpusmill.functions.text import strip
from corpusmill.operators.packing import padded, truncated

# What a search says that has found nothing, nothing new, or is unknown.
NOTHING = "未找到相关医学信息。请尝试换用不同的关键词重新搜索。"
NOTHING_NEW = "搜索结果与之前的搜索重复，未找到新信息。请尝试使用不同角度的关键词搜索。"
UNKNOWN = "Error: 未知工具 '{}'"
QUERY = r'"query"\s*:\s*"([^"]*)"'
BULLETS = r"^[- ·•]+"
# End of the fixed values.


def constructed(text: Column) -> Column:
    """``(n_calls, thoughts, queries, results, answer)`` of a written solution; null unless it has thoughts, calls, results and an answer.

    A call's query is that of its JSON, else its first 50 characters; of several
    answers the last counts.
    """
    part = lambda name: F.transform(G.tag(text, name), strip)
    query = lambda c: F.when(c.rlike(QUERY), F.regexp_extract(c, QUERY, 1)).otherwise(F.substring(c, 1, 50))
    thoughts, calls, results, answers = (part(x) for x in ("think", "tool_call", "search_result", "answer"))
    whole = F.struct(F.size(calls).alias("n_calls"), thoughts.alias("thoughts"), F.transform(calls, query).alias("queries"), results.alias("results"), F.try_element_at(answers, F.lit(-1)).alias("answer"))
    return F.when((F.size(thoughts) > 0) & (F.size(calls) > 0) & (F.size(results) > 0) & (F.size(answers) > 0), whole)


def constructed_fault(parsed: Column, least_answer: int = 20, most_calls: int = 5) -> Column:
    """The first rule that a parsed solution breaks, or null: an answer of some length, not too many calls, a result for each."""
    return F.when(F.length(parsed["answer"]) < least_answer, "short_answer").when(parsed["n_calls"] > most_calls, "many_calls").when(
        parsed["n_calls"] != F.size(parsed["results"]), "results_differ")


def single_search(text: Column, least: int = 20) -> Column:
    """Whether a turn is one valid call with a result of some length, then a thought and an answer of some length."""
    s = G.steps(text)
    size = lambda c: F.length(strip(F.coalesce(c, F.lit(""))))
    call, last = F.get(F.filter(s, lambda x: x["query"].isNotNull()), 0), F.try_element_at(s, F.lit(-1))
    one = F.size(F.filter(s, lambda x: x["query"].isNotNull())) == 1
    return F.coalesce(G.valid_steps(s) & one & G.valid_call(call["query"]) & (size(call["result"]) >= least) & (size(last["think"]) > 0) & (size(last["answer"]) >= least), F.lit(False))


def variants(reply: Column, least: int = 2, most: int = 200) -> Column:
    """The questions that a reply lists line by line, without bullets, those of a fitting length."""
    lines = F.filter(F.transform(F.split(strip(reply), "\n"), strip), lambda x: x != "")
    clean = F.transform(lines, lambda x: strip(F.regexp_replace(x, BULLETS, "")))
    return F.filter(clean, lambda x: F.length(x).between(least, most))


def expanded_questions(seeds: DataFrame, question: str, reply: str, category: str) -> DataFrame:
    """``(question, category, is_seed)``: the seeds, and behind them what each one's reply lists."""
    own = seeds.select(F.col(question).alias("question"), F.col(category).alias("category"), F.lit(True).alias("is_seed"))
    return own.union(seeds.select(F.explode(variants(F.col(reply))).alias("question"), F.col(category).alias("category"), F.lit(False).alias("is_seed")))


def direct_record(index: Column, question: Column, category: Column, reply: Column, system: str, least: int = 5) -> Column:
    """``(messages, _meta)`` of a direct answer; null without a thought, an answer, or if that is short."""
    think, answer = (strip(F.get(G.tag(reply, x), 0)) for x in ("think", "answer"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.concat(F.lit("<think>"), think, F.lit("</think>\n<answer>"), answer, F.lit("</answer>"))
    meta = F.struct(index.alias("index"), F.lit(0).alias("num_tool_calls"), F.lit(1).alias("num_turns"), F.lit("direct_answer").alias("type"), category.alias("category"))
    record = F.struct(F.array(message("system", F.lit(system)), message("user", question), message("assistant", body)).alias("messages"), meta.alias("_meta"))
    return F.when(think.isNotNull() & (F.length(answer) >= least), record)


def tool_result(name: Column, results: Column, seen: Column, most: int = 400) -> Column:
    """What a search's results (title, content, score) look like to the model; titles in ``seen`` are left out.

    A null ``seen`` leaves nothing out, and null results are none.
    """
    found = F.coalesce(results, F.array().cast("array<struct<title:string,content:string,score:double>>"))
    new = F.filter(found, lambda r: ~F.coalesce(F.array_contains(seen, F.coalesce(r["title"], F.lit(""))), F.lit(False)))
    score = lambda r: F.when(F.coalesce(r["score"], F.lit(0.0)) == 0, "").otherwise(F.concat(F.lit(" (相关度: "), F.format_string("%.2f", r["score"]), F.lit(")")))
    line = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), score(r), F.lit(" "), F.coalesce(r["title"], F.lit("")), F.lit("\n"), F.substring(F.coalesce(r["content"], F.lit("")), 1, most))
    before, after = UNKNOWN.split("{}")
    return F.when(~F.equal_null(name, F.lit("search")), F.concat(F.lit(before), F.coalesce(name, F.lit("")), F.lit(after))).when(
        F.size(found) == 0, NOTHING).when(F.size(new) == 0, NOTHING_NEW).otherwise(F.array_join(F.transform(new, line), "\n\n"))


def chat_prompt(system: str, question: Column) -> Column:
    """A question as a chat that waits for the assistant."""
    return F.concat(F.lit(f"{G.START}system\n{system}{G.STOP}\n{G.START}user\n"), question, F.lit(f"{G.STOP}\n{G.START}assistant\n"))


def preference_text(df: DataFrame, system: str) -> DataFrame:
    """``df`` with ``query`` (a chat prompt), ``chosen`` (else ``response``) and ``rejected``; rows that lack one go."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    chosen = F.coalesce(*[filled(c) for c in ("chosen", "response") if c in df.columns])
    made = {"query": chat_prompt(system, filled("question")), "chosen": chosen, "rejected": filled("rejected")}
    return df.withColumns(made).where("query IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL")


def preference_ids(df: DataFrame, tokenize, prompt: int, response: int, pad: int = 0) -> DataFrame:
    """``df`` with the ids of query, chosen and rejected, cut or padded to their length, and their masks.

    ``tokenize``: a text column to a column of ids.
    """
    out = df
    for name, size in (("query", prompt), ("chosen", response), ("rejected", response)):
        p = padded(truncated(tokenize(F.col(name)), size), F.lit(size), pad)
        out = out.withColumns({f"{name}_ids": p["ids"], f"{name}_mask": p["mask"]})
    return out.drop("query", "chosen", "rejected")


def answered(df: DataFrame, question: Column, answer: Column, aliases=("question", "query", "instruction", "answer")) -> DataFrame:
    """Question and answer, and all other columns but those under whose names a question may have come."""
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in aliases]
    return df.select(question.alias("question"), answer.alias("answer"), *rest)
