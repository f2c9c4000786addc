"""Conversations and trajectories: rendering, validation, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import tags as G
from corpusmill.functions.text import strip

MESSAGES = "array<struct<role:string,content:string>>"


def gather(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row for each conversation with its ``messages`` in order."""
    rows = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("m"))
    return rows.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def single_turn(query: Column, answer: Column, system: str) -> Column:
    """A chat prompt of one question and its answer; null if either is empty."""
    seg = lambda role, body: F.concat(F.lit(f"{G.START}{role}\n"), body, F.lit(G.STOP))
    text = F.concat_ws("\n", seg("system", F.lit(system)), seg("user", query), seg("assistant", answer))
    return F.when((F.coalesce(query, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != ""), text)


def with_system(messages: Column, system: str) -> Column:
    """The messages, a system message in front if there is none."""
    own = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return F.when(F.exists(messages, lambda m: m["role"] == "system"), messages).otherwise(F.concat(own, messages))


def render(messages: Column) -> Column:
    """All messages as one chat text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(G.START), m["role"], F.lit("\n"), m["content"], F.lit(G.STOP + "\n"))), "")


def assistant_spans(messages: Column) -> Column:
    """``[start, stop)`` of each assistant's content and end mark in the rendered text."""
    size = lambda m: F.length(m["role"]) + F.length(m["content"]) + len(G.START) + len(G.STOP) + 2
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,stop:int>>)").alias("out"))

    def step(a, m):
        begin = a["at"] + len(G.START) + F.length(m["role"]) + 1
        span = F.array(F.struct(begin.alias("start"), (begin + F.length(m["content"]) + len(G.STOP)).alias("stop")))
        return F.struct((a["at"] + size(m)).alias("at"), F.when(m["role"] == "assistant", F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(messages, start, step, lambda a: a["out"])


def loss_mask(offsets: Column, spans: Column) -> Column:
    """For each token ``(start, stop)``, whether it overlaps a span."""
    return F.transform(offsets, lambda t: F.exists(spans, lambda s: (t["stop"] > s["start"]) & (t["start"] < s["stop"])))


def first_question(messages: Column) -> Column:
    """The first user message that is no tool's response."""
    return F.get(F.filter(messages, lambda m: (m["role"] == "user") & ~F.contains(m["content"], F.lit("<tool_response>"))), 0)["content"]


def invalid_reason(messages: Column) -> Column:
    """The first rule that a conversation breaks, or null.

    Rules in order: three messages, system first, user second, an assistant,
    an answer in its last message; then message by message: content, no role
    but the user's twice in a row, valid JSON in calls, a response after a call.
    """
    n = F.size(messages)
    role = lambda i: F.get(messages, i)["role"]
    last = F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.size(F.filter(messages, lambda m: m["role"] == "assistant")) - 1)

    def message(m, i):
        call = (m["role"] == "assistant") & F.contains(m["content"], F.lit("<tool_call>"))
        body = F.get(G.tag(m["content"], "tool_call"), 0)
        after = F.get(messages, i + 1)
        return F.when(strip(F.coalesce(m["content"], F.lit(""))) == "", F.lit("blank_content")).when(
            (i > 0) & (role(i - 1) == m["role"]) & (m["role"] != "user"), "repeated_role").when(
            call & body.isNotNull() & ~G.valid_call(body), "invalid_call").when(
            call & (i + 1 < n) & ((after["role"] != "user") | ~F.contains(after["content"], F.lit("<tool_response>"))), "call_without_response")

    found = F.get(F.filter(F.transform(messages, message), lambda r: r.isNotNull()), 0)
    return F.when(F.coalesce(n, F.lit(0)) < 3, "too_few_messages").when(role(F.lit(0)) != "system", "no_system_first").when(role(F.lit(1)) != "user", "no_user_second").when(
        last.isNull(), "no_assistant").when(~F.contains(last["content"], F.lit("<answer>")), "no_final_answer").otherwise(found)


def repair_messages(messages: Column) -> Column:
    """Repairs in the assistant's messages alone."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", G.repair(m["content"])).otherwise(m["content"]).alias("content")))


def format_check(turns: Column, think: bool = True, close: bool = True) -> Column:
    """``(compliant, all_think, structured, issues)`` of a trajectory's contents.

    ``structured`` is true if any turn has a call or an answer.
    """
    has = lambda t, name: G.has_tag(F.coalesce(t["content"], F.lit("")), name)
    no = lambda i, what: F.concat(F.lit("turn "), (i + 1).cast("string"), F.lit(": " + what))
    each = F.flatten(F.transform(turns, lambda t, i: F.array_compact(F.array(
        F.when(F.lit(think) & ~has(t, "think"), no(i, "no think tag")),
        F.when(~has(t, "think") & ~has(t, "tool_call") & ~has(t, "answer"), no(i, "no tag"))))))
    structured = F.exists(turns, lambda t: has(t, "tool_call") | has(t, "answer"))
    issues = F.concat(each, F.when(F.lit(close) & ~structured, F.array(F.lit("no answer or call"))).otherwise(F.expr("CAST(array() AS array<string>)")))
    all_think = F.forall(turns, lambda t: has(t, "think")) if think else F.lit(True)
    return F.struct((F.size(issues) == 0).alias("compliant"), all_think.alias("all_think"), structured.alias("structured"), issues.alias("issues"))


def tool_check(turns: Column, calls: Column, names=("search",), least: int = 2, most: int = 4) -> Column:
    """``(queries, unique, duplicates, excessive, invalid, issues)`` of turns with ``tool``, ``query``."""
    used = F.filter(turns, lambda t: t["tool"].isNotNull())
    queries = F.transform(used, lambda t: F.coalesce(t["query"], F.lit("")))
    invalid = F.filter(F.transform(used, lambda t: t["tool"]), lambda x: ~x.isin(*names))
    unique = F.size(F.array_distinct(queries))
    short = F.filter(queries, lambda q: F.length(q) < least)
    issues = F.size(invalid) + F.size(short) + (calls > most).cast("int") + (F.size(queries) > unique).cast("int")
    return F.struct(queries.alias("queries"), unique.alias("unique"), (F.size(queries) - unique).alias("duplicates"), (calls > most).alias("excessive"), invalid.alias("invalid"), issues.alias("n_issues"))


def readable(turns: Column, preview: int = 500) -> Column:
    """A trajectory as text, tool responses cut to a preview."""
    line = lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t["role"], F.lit(": "), F.when(F.length(t["content"]) > preview, F.concat(F.substring(t["content"], 1, preview), F.lit("..."))).otherwise(t["content"]))
    return F.array_join(F.transform(turns, line), "\n")
