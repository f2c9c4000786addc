"""Functions over tagged text and the JSON inside it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import strip

# The tags, and the chat markers of prompts.
START, STOP = "<|im_start|>", "<|im_end|>"
CALL = r"(?s)<tool_call>(.*?)</tool_call>"
XML_CALL = r'(?s)<name>\s*search\s*</name>\s*<arguments>\s*<query"?>(.*?)</query>\s*</arguments>'
NAME_PREFIX = r"<name>[^<]*</name>\s*"
# End of the fixed values.

STEP = "array<struct<think:string,query:string,result:string,answer:string>>"


def tag(c: Column, name: str) -> Column:
    """All contents of a tag, shortest first, across lines."""
    return F.regexp_extract_all(c, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1))


def has_tag(c: Column, name: str) -> Column:
    """Whether a whole tag occurs."""
    return c.rlike(f"(?s)<{name}>(.*?)</{name}>")


def valid_call(c: Column) -> Column:
    """Whether a text is a JSON object that calls the search tool with a query that isn't blank."""
    v = F.try_parse_json(c)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    shape = F.schema_of_variant(v)
    return F.coalesce((get("$.name", "string") == "search") & shape.rlike("arguments: OBJECT<") & shape.rlike("query: STRING") & (strip(get("$.arguments.query", "string")) != ""), F.lit(False))


def call_query(c: Column) -> Column:
    """The query of the first call in a text."""
    return F.get_json_object(F.get(tag(c, "tool_call"), 0), "$.arguments.query")


def response(c: Column) -> Column:
    """What a turn says: ``(kind, value)``, a valid call before an answer tag before what follows the thoughts."""
    call, answer = F.get(tag(c, "tool_call"), 0), F.get(tag(c, "answer"), 0)
    rest = strip(F.regexp_replace(c, "(?s)^.*?</think>", ""))
    return F.when(call.isNotNull() & valid_call(call), F.struct(F.lit("tool").alias("kind"), F.get_json_object(call, "$.arguments.query").alias("value"))).when(
        answer.isNotNull(), F.struct(F.lit("answer").alias("kind"), strip(answer).alias("value"))).otherwise(F.struct(F.lit("text").alias("kind"), rest.alias("value")))


def steps(c: Column) -> Column:
    """Reasoning steps of a nested turn: thoughts, then a call with the next result anywhere after it, or the answer that ends it.

    A fold over the tags in order.  A result is looked for beyond the next
    thoughts, so a call without one takes a later one, and what it passes over
    is skipped.
    """
    whole = r"(?s)(<think>.*?</think>|<tool_call>.*?</tool_call>|<search_result>.*?</search_result>|<answer>.*?</answer>)"
    parts = F.transform(F.regexp_extract_all(c, F.lit(whole), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, "^<([a-z_]+)>", 1).alias("t"), strip(F.regexp_replace(x, "(?s)^<[a-z_]+>|</[a-z_]+>$", "")).alias("v")))
    empty = F.struct(F.lit(None).cast("string").alias("think"), F.lit(None).cast("string").alias("query"), F.lit(False).alias("done"), F.expr(f"CAST(array() AS {STEP})").alias("out"))

    def made(a, query, result, answer):
        return F.concat(a["out"], F.array(F.struct(a["think"].alias("think"), query.alias("query"), result.alias("result"), answer.alias("answer"))))

    null = F.lit(None).cast("string")

    def state(think, query, done, out):
        return F.struct(think.alias("think"), query.alias("query"), done.alias("done"), out.alias("out"))

    def step(a, p):
        waiting = a["query"].isNotNull()
        return F.when(a["done"], a).when(
            waiting & (p["t"] == "search_result"), state(null, null, F.lit(False), made(a, a["query"], p["v"], null))).when(
            waiting, a).when(
            p["t"] == "think", state(p["v"], null, F.lit(False), a["out"])).when(
            (p["t"] == "tool_call") & a["think"].isNotNull(), state(a["think"], p["v"], F.lit(False), a["out"])).when(
            (p["t"] == "answer") & a["think"].isNotNull(), state(null, null, F.lit(True), made(a, null, null, p["v"]))).otherwise(a)

    return F.aggregate(parts, empty, step, lambda a: a["out"])


def valid_steps(s: Column) -> Column:
    """Some steps, the last one with an answer, all earlier ones with a call."""
    return (F.size(s) > 0) & F.element_at(s, -1)["answer"].isNotNull() & F.forall(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), lambda x: x["query"].isNotNull())


def to_messages(s: Column) -> Column:
    """Steps as messages: a call and its result make a pair, the answer one message."""
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    think = lambda x: F.concat(F.lit("<think>\n"), x["think"], F.lit("\n</think>\n"))
    pair = lambda x: F.array(msg("assistant", F.concat(think(x), F.lit("<tool_call>\n"), x["query"], F.lit("\n</tool_call>"))), msg("user", F.concat(F.lit("<tool_response>\n"), F.coalesce(x["result"], F.lit("")), F.lit("\n</tool_response>"))))
    return F.flatten(F.transform(s, lambda x: F.when(x["answer"].isNotNull(), F.array(msg("assistant", F.concat(think(x), F.lit("<answer>\n"), x["answer"], F.lit("\n</answer>"))))).otherwise(pair(x))))


def repair(c: Column) -> Column:
    """Nested call tags made one, the first XML-style call made JSON, name prefixes before JSON dropped."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?:<tool_call>\n?)+(?=<tool_call>)", ""), r"</tool_call>(?:\n?</tool_call>)+", "</tool_call>")
    xml = F.regexp_extract(c, XML_CALL, 0)
    made = F.concat(F.lit('{"name": "search", "arguments": {"query": '), F.to_json(F.array(strip(F.regexp_extract(c, XML_CALL, 1)))), F.lit("}}"))
    made = F.regexp_replace(made, r'"query": \[(.*)\]\}\}$', '"query": $1}}')
    at = F.instr(c, xml)
    c = F.when(xml != "", F.concat(F.substring(c, F.lit(1), at - 1), made, F.substring(c, at + F.length(xml), F.length(c)))).otherwise(c)
    return F.regexp_replace(c, r'(<tool_call>)\s*' + NAME_PREFIX + r'(\{"name")', "$1$2")


def count_calls(given: Column, messages: Column) -> Column:
    """The given number of calls, else the call tags in the assistant's messages."""
    own = F.aggregate(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: F.size(tag(m["content"], "tool_call"))), F.lit(0), lambda a, n: a + n)
    return F.coalesce(given.cast("int"), own)


def outer_json(c: Column) -> Column:
    """From the first opening brace to the last closing one; null if that is no JSON."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull(), found)


def fenced_json(c: Column) -> Column:
    """The object inside a fence, else in the whole text; null if that is no JSON."""
    fence = F.regexp_extract(c, r"(?s)```(?:json)?(.*?)```", 1)
    return outer_json(F.when(fence != "", fence).otherwise(c))


def direct_answer(c: Column, least: int = 20) -> Column:
    """One thought that isn't empty, one answer of some length, and no call."""
    think, answer = tag(c, "think"), tag(c, "answer")
    return ~F.contains(c, F.lit("<tool_call>")) & (F.size(think) == 1) & (F.size(answer) == 1) & (strip(F.coalesce(F.get(think, 0), F.lit(""))) != "") & (F.length(strip(F.coalesce(F.get(answer, 0), F.lit("")))) >= least)


def strip_special(c: Column, marks=(START, STOP, "<|endoftext|>")) -> Column:
    """Without the markers of chats, and without white space at the ends."""
    for m in marks:
        c = F.replace(c, F.lit(m), F.lit(""))
    return strip(c)
