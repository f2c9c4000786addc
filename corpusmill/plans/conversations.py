"""Queries over conversations and tagged text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import tags as G
from corpusmill.operators import conversation as C
from corpusmill.plans.common import table

QUERIES, ORACLES = {}, {}
SYSTEM = "You answer."


def query(name, sql=None):
    """Register a query and its twin."""
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


PAIRS = "SELECT conv_id, turn, text AS q, answer AS a FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"


def pairs(spark, sf_dir):
    """User turns with the assistant turn right behind."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "a": F.lead("text").over(w)})
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("q"), "a")


query("qa_pairs", PAIRS)(pairs)


@query("chat_single_turn", f"SELECT conv_id, turn, md5('<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || q || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || a || '<|im_end|>') AS prompt FROM ({PAIRS})")
def single(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.md5(C.single_turn(F.col("q"), F.col("a"), SYSTEM).cast("binary")).alias("prompt"))


MSGS = f"""SELECT conv_id, CASE WHEN list_contains(list_transform(m, lambda x: x.role), 'system') THEN m ELSE list_concat([{{'role': 'system', 'content': '{SYSTEM}'}}], m) END AS m
FROM (SELECT conv_id, list({{'role': role, 'content': text}} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"""


def messages(spark, sf_dir):
    c = C.gather(table(spark, sf_dir, "conversations"))
    return c.withColumn("messages", C.with_system(F.col("messages"), SYSTEM))


@query("chat_render", f"SELECT conv_id, md5(array_to_string(list_transform(m, lambda x: '<|im_start|>' || x.role || chr(10) || x.content || '<|im_end|>' || chr(10)), '')) AS prompt, len(m)::BIGINT AS n FROM ({MSGS})")
def rendered(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", F.md5(C.render(F.col("messages")).cast("binary")).alias("prompt"), F.size("messages").cast("long").alias("n"))


@query("chat_assistant_spans", f"""
WITH e AS (SELECT conv_id, unnest(m) AS x, unnest(range(len(m))) AS i FROM ({MSGS})),
s AS (SELECT conv_id, i, x.role AS role, length(x.content) AS n, coalesce(sum(12 + length(x.role) + 1 + length(x.content) + 11) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 12 + length(x.role) + 1 AS b FROM e)
SELECT conv_id, b::BIGINT AS start, (b + n + 10)::BIGINT AS stop FROM s WHERE role = 'assistant'""")
def spans(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", F.inline(C.assistant_spans(F.col("messages")))).select("conv_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("loss_mask", """
WITH d AS (SELECT doc_id, length(text) AS n FROM documents),
t AS (SELECT doc_id, unnest(range(0, n, 4)) AS b, n FROM d)
SELECT doc_id, count(*) FILTER (WHERE (least(b + 4, n) > 10 AND b < 30) OR (least(b + 4, n) > 101 AND b < 140))::BIGINT AS kept, count(*)::BIGINT AS n FROM t GROUP BY doc_id""")
def masked(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", F.length("text").alias("n")).where("n > 0")
    offsets = F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(4)), lambda b: F.struct(b.alias("start"), F.least(b + 4, F.col("n")).alias("stop")))
    s = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in ((10, 30), (101, 140))])
    m = C.loss_mask(offsets, s)
    return d.select("doc_id", F.size(F.filter(m, lambda x: x)).cast("long").alias("kept"), F.size(m).cast("long").alias("n"))


@query("first_question", "SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' AND NOT contains(text, '<tool_response>') GROUP BY conv_id")
def first(spark, sf_dir):
    return C.gather(table(spark, sf_dir, "conversations")).select("conv_id", C.first_question(F.col("messages")).alias("question")).where("question IS NOT NULL")


@query("role_neighbours", "SELECT conv_id, turn, coalesce(role = lag(role) OVER w AND role <> 'user', false) AS repeated, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbours(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce((F.col("role") == F.lag("role").over(w)) & (F.col("role") != "user"), F.lit(False)).alias("repeated"), F.lead("role").over(w).alias("next_role"))


#: Conversations with tags, made from turns: every third lacks an answer, every fifth has a call.
TAGGED = """CASE WHEN role = 'assistant' THEN '<think>' || substr(text, 1, 9) || '</think>' || CASE WHEN conv_id % 5 = 0 THEN '<tool_call>{"name": "search", "arguments": {"query": "q' || turn || '"}}</tool_call>' WHEN conv_id % 5 = 1 THEN '<tool_call>{"name": "find"}</tool_call>' WHEN conv_id % 3 = 0 THEN '' ELSE '<answer>' || substr(text, 1, 40) || '</answer>' END ELSE text END"""


def tagged(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("text", F.expr(TAGGED))


@query("conversation_invalid_reason", f"""
WITH t AS (SELECT conv_id, turn, role, {TAGGED} AS c FROM conversations),
w AS (SELECT *, row_number() OVER o AS i, lag(role) OVER o AS p, lead(role) OVER o AS nr, lead(c) OVER o AS nc FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, i, CASE WHEN trim(c) = '' THEN 'blank_content' WHEN role = p AND role <> 'user' THEN 'repeated_role' WHEN role = 'assistant' AND contains(c, '"find"') THEN 'invalid_call' WHEN role = 'assistant' AND contains(c, '<tool_call>') AND nr IS NOT NULL AND (nr <> 'user' OR NOT contains(nc, '<tool_response>')) THEN 'call_without_response' END AS x FROM w),
g AS (SELECT conv_id, count(*) AS n, max(role) FILTER (WHERE i = 1) AS r1, max(role) FILTER (WHERE i = 2) AS r2, arg_max(c, i) FILTER (WHERE role = 'assistant') AS last FROM w GROUP BY conv_id)
SELECT g.conv_id, CASE WHEN n < 3 THEN 'too_few_messages' WHEN r1 <> 'system' THEN 'no_system_first' WHEN r2 <> 'user' THEN 'no_user_second' WHEN last IS NULL THEN 'no_assistant' WHEN NOT contains(last, '<answer>') THEN 'no_final_answer' ELSE f.x END AS reason
FROM g LEFT JOIN (SELECT conv_id, arg_min(x, i) AS x FROM r WHERE x IS NOT NULL GROUP BY conv_id) f USING (conv_id)""")
def reasons(spark, sf_dir):
    return C.gather(tagged(spark, sf_dir)).select("conv_id", C.invalid_reason(F.col("messages")).alias("reason"))


@query("invalid_reason_top10", None)
def top_reasons(spark, sf_dir):
    r = reasons(spark, sf_dir).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    return r.orderBy(F.desc("n"), "reason").limit(10)


ORACLES["invalid_reason_top10"] = f"SELECT reason, count(*)::BIGINT AS n FROM ({ORACLES['conversation_invalid_reason']}) WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 10"


@query("tag_extract", f"SELECT conv_id, turn, coalesce(array_to_string(regexp_extract_all(c, '(?s)<think>(.*?)</think>', 1), '|'), '') AS think, coalesce(array_to_string(regexp_extract_all(c, '(?s)<answer>(.*?)</answer>', 1), '|'), '') AS answer FROM (SELECT conv_id, turn, {TAGGED} AS c FROM conversations)")
def extract(spark, sf_dir):
    return tagged(spark, sf_dir).select("conv_id", "turn", F.array_join(G.tag(F.col("text"), "think"), "|").alias("think"), F.array_join(G.tag(F.col("text"), "answer"), "|").alias("answer"))


@query("tag_response", f"""SELECT conv_id, turn, CASE WHEN contains(c, '"search"') THEN 'tool' WHEN contains(c, '<answer>') THEN 'answer' ELSE 'text' END AS kind,
 CASE WHEN contains(c, '"search"') THEN 'q' || turn WHEN contains(c, '<answer>') THEN regexp_replace(regexp_extract(c, '(?s)<answer>(.*?)</answer>', 1), '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(regexp_replace(c, '(?s)^.*?</think>', ''), '^\\s+|\\s+$', '', 'g') END AS value
FROM (SELECT conv_id, turn, {TAGGED} AS c FROM conversations)""")
def responses(spark, sf_dir):
    return tagged(spark, sf_dir).select("conv_id", "turn", G.response(F.col("text")).alias("r")).select("conv_id", "turn", "r.kind", "r.value")


@query("tool_call_json", """SELECT c_custkey, c_custkey % 4 = 0 AS valid FROM customer""")
def calls(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey")
    body = F.expr("""CASE c_custkey % 4 WHEN 0 THEN '{"name": "search", "arguments": {"query": "x' || c_custkey || '"}}' WHEN 1 THEN '{"name": "search", "arguments": {"query": "  "}}' WHEN 2 THEN '{"name": "search", "arguments": "x"}' ELSE '{"name": "search"' END""")
    return c.select("c_custkey", G.valid_call(body).alias("valid"))


@query("tool_call_count", f"SELECT conv_id, coalesce(CASE WHEN conv_id % 7 = 0 THEN 9 END, sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(c, '(?s)<tool_call>(.*?)</tool_call>')) ELSE 0 END))::BIGINT AS n FROM (SELECT conv_id, role, {TAGGED} AS c FROM conversations) GROUP BY conv_id")
def call_counts(spark, sf_dir):
    given = F.when(F.col("conv_id") % 7 == 0, 9)
    return C.gather(tagged(spark, sf_dir)).select("conv_id", G.count_calls(given, F.col("messages")).cast("long").alias("n"))


@query("tag_repair", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '<tool_call>{"a": ' || c_custkey || '}</tool_call> end' WHEN 1 THEN '<tool_call>{"name": "search", "arguments": {"query": "x' || c_custkey || '"}}</tool_call>' ELSE '<tool_call>{"name": "search"}</tool_call>' END AS out FROM customer""")
def repaired(spark, sf_dir):
    broken = F.expr("""CASE c_custkey % 3 WHEN 0 THEN '<tool_call>\\n<tool_call><tool_call>{"a": ' || c_custkey || '}</tool_call>\\n</tool_call></tool_call> end' WHEN 1 THEN '<tool_call><name>search</name><arguments><query"> x' || c_custkey || ' </query></arguments></tool_call>' ELSE '<tool_call><name>search</name>\\n{"name": "search"}</tool_call>' END""")
    return table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", G.repair(broken).alias("out"))


NESTED = """'<think>a' || c_custkey || '</think><tool_call>q1</tool_call><search_result>r1</search_result>' || CASE WHEN c_custkey % 2 = 0 THEN '<think>b</think><tool_call>q2</tool_call><think>lost</think><search_result>r2</search_result>' ELSE '' END || '<think>z</think>' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '<answer> done ' || c_custkey || ' </answer><think>after</think>' END"""


@query("step_parse", """SELECT c_custkey, 'a' || c_custkey || ':q1:r1:|' || CASE WHEN c_custkey % 2 = 0 THEN 'b:q2:r2:|' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'z:::done ' || c_custkey || '|' END AS steps, c_custkey % 3 <> 0 AS valid FROM customer""")
def parsed(spark, sf_dir):
    s = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", G.steps(F.expr(NESTED)).alias("s"))
    e = lambda c: F.coalesce(c, F.lit(""))
    shown = F.array_join(F.transform("s", lambda x: F.concat(e(x["think"]), F.lit(":"), e(x["query"]), F.lit(":"), e(x["result"]), F.lit(":"), e(x["answer"]), F.lit("|"))), "")
    return s.select("c_custkey", shown.alias("steps"), G.valid_steps(F.col("s")).alias("valid"))


@query("step_messages", """SELECT c_custkey, (2 + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END)::BIGINT AS n, (1 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_user FROM customer""")
def step_messages(spark, sf_dir):
    m = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", G.to_messages(G.steps(F.expr(NESTED))).alias("m"))
    return m.select("c_custkey", F.size("m").cast("long").alias("n"), F.size(F.filter("m", lambda x: x["role"] == "user")).cast("long").alias("n_user"))


@query("format_convert_counts", "SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE c_custkey % 3 <> 0)::BIGINT AS converted, count(*) FILTER (WHERE c_custkey % 3 = 0)::BIGINT AS failed FROM customer")
def convert_counts(spark, sf_dir):
    s = table(spark, sf_dir, "customer", "c_custkey").select(G.valid_steps(G.steps(F.expr(NESTED))).alias("ok"))
    return s.agg(F.count("*").alias("total"), F.count_if("ok").alias("converted"), F.count_if(~F.col("ok")).alias("failed"))


@query("outer_json", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS value, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS fenced FROM customer""")
def json_found(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey")
    end = "CASE WHEN c_custkey % 2 = 0 THEN '}' ELSE '' END"
    outer = G.outer_json(F.expr(f"'so {{\"a\": {{\"b\": ' || c_custkey || '}}' || {end} || ' ok'"))
    fence = G.fenced_json(F.expr(f"'x ```json\\n{{\"a\": {{\"b\": ' || c_custkey || '}}' || {end} || '\\n``` y }}'"))
    return c.select("c_custkey", F.get_json_object(outer, "$.a.b").cast("long").alias("value"), F.get_json_object(fence, "$.a.b").cast("long").alias("fenced"))


@query("direct_answer_valid", "SELECT conv_id, turn, length(regexp_replace(text[:40], '^\\s+|\\s+$', '', 'g')) >= 20 AND conv_id % 5 NOT IN (0, 1) AND conv_id % 3 <> 0 AND regexp_replace(text[:9], '^\\s+|\\s+$', '', 'g') <> '' AS valid FROM conversations WHERE role = 'assistant'")
def direct(spark, sf_dir):
    return tagged(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", G.direct_answer(F.col("text")).alias("valid"))


@query("special_tokens_stripped", "SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS out FROM conversations")
def special(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", G.strip_special(F.concat(F.lit(" <|im_start|>"), F.col("text"), F.lit("<|im_end|>\n<|endoftext|>"))).alias("out"))


#: Trajectories from events: an episode is a user's day, a turn an event.
EPISODES = "SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type, value, k FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)"


def episodes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").alias("k"))
    content = F.concat(F.when(F.col("event_type") != "error", F.lit("<think>t</think>")).otherwise(""), F.when(F.col("event_type") == "purchase", F.lit("<answer>ok</answer>")).otherwise(""))
    turn = F.struct("event_id", F.lit("assistant").alias("role"), content.alias("content"), F.when(F.col("event_type").isin("click", "view"), F.when(F.col("event_type") == "click", "search").otherwise("view")).alias("tool"), F.col("k").alias("query"), "value")
    return e.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


@query("trajectory_format", f"""SELECT user_id, CAST(day AS VARCHAR) AS day, bool_and(event_type <> 'error') AND bool_or(event_type = 'purchase') AS compliant, bool_and(event_type <> 'error') AS all_think, bool_or(event_type = 'purchase') AS structured,
 (count(*) FILTER (WHERE event_type = 'error') * 2 + CASE WHEN bool_or(event_type = 'purchase') THEN 0 ELSE 1 END)::BIGINT AS n_issues FROM ({EPISODES}) GROUP BY ALL""")
def trajectory_format(spark, sf_dir):
    e = episodes(spark, sf_dir).select("user_id", F.col("day").cast("string").alias("day"), C.format_check(F.col("turns")).alias("f"))
    return e.select("user_id", "day", "f.compliant", "f.all_think", "f.structured", F.size("f.issues").cast("long").alias("n_issues"))


@query("trajectory_tools", f"""SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) FILTER (WHERE event_type IN ('click', 'view'))::BIGINT AS n, (count(*) FILTER (WHERE event_type IN ('click', 'view')) - count(DISTINCT k) FILTER (WHERE event_type IN ('click', 'view')))::BIGINT AS duplicates,
 count(*) FILTER (WHERE event_type IN ('click', 'view')) > 4 AS excessive, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS n_invalid FROM ({EPISODES}) GROUP BY ALL""")
def trajectory_tools(spark, sf_dir):
    n = F.size(F.filter("turns", lambda t: t["tool"].isNotNull()))
    e = episodes(spark, sf_dir).select("user_id", F.col("day").cast("string").alias("day"), C.tool_check(F.col("turns"), n).alias("t"))
    return e.select("user_id", "day", F.size("t.queries").cast("long").alias("n"), F.col("t.duplicates").cast("long").alias("duplicates"), "t.excessive", F.size("t.invalid").cast("long").alias("n_invalid"))


@query("trajectory_summary", f"""
WITH e AS (SELECT user_id, day, bool_and(event_type <> 'error') AND bool_or(event_type = 'purchase') AS ok, bool_and(event_type <> 'error') AS think, bool_or(event_type = 'purchase') AS fin, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS n,
  count(DISTINCT k) FILTER (WHERE event_type IN ('click', 'view')) AS u, sum(value) AS elapsed FROM ({EPISODES}) GROUP BY ALL)
SELECT count(*)::BIGINT AS total, round(avg(ok::INT), 6) AS format_rate, round(avg(think::INT), 6) AS think_rate, round(avg(fin::INT), 6) AS structured_rate, round(avg((n = 0)::INT), 6) AS direct_rate, round(avg((n > 4)::INT), 6) AS excessive_rate,
 round(avg((n > u)::INT), 6) AS duplicate_rate, round(avg((elapsed <= 60)::INT), 6) AS time_rate, round(avg(n), 6) AS calls_mean, median(n)::DOUBLE AS calls_median, max(n)::BIGINT AS calls_max, round(avg(elapsed), 6) AS elapsed_mean, round(median(elapsed), 6) AS elapsed_median FROM e""")
def trajectory_summary(spark, sf_dir):
    n = F.size(F.filter("turns", lambda t: t["tool"].isNotNull()))
    e = episodes(spark, sf_dir).select(C.format_check(F.col("turns")).alias("f"), C.tool_check(F.col("turns"), n).alias("t"), n.alias("n"), F.aggregate("turns", F.lit(0.0), lambda a, t: a + t["value"]).alias("elapsed"))
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return e.agg(F.count("*").alias("total"), rate(F.col("f.compliant")).alias("format_rate"), rate(F.col("f.all_think")).alias("think_rate"), rate(F.col("f.structured")).alias("structured_rate"), rate(F.col("n") == 0).alias("direct_rate"), rate(F.col("t.excessive")).alias("excessive_rate"),
                 rate(F.col("t.duplicates") > 0).alias("duplicate_rate"), rate(F.col("elapsed") <= 60).alias("time_rate"), F.round(F.avg("n"), 6).alias("calls_mean"), F.median("n").alias("calls_median"), F.max("n").cast("long").alias("calls_max"), F.round(F.avg("elapsed"), 6).alias("elapsed_mean"), F.round(F.median("elapsed"), 6).alias("elapsed_median"))


@query("trajectory_text", "SELECT conv_id, md5(array_to_string(list('[' || i || '] ' || role || ': ' || CASE WHEN length(text) > 500 THEN text[:500] || '...' ELSE text END ORDER BY i), chr(10))) AS out FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id")
def trajectory_text(spark, sf_dir):
    return C.gather(table(spark, sf_dir, "conversations")).select("conv_id", F.md5(C.readable(F.col("messages")).cast("binary")).alias("out"))


@query("episode_unseen", f"SELECT user_id, CAST(day AS VARCHAR) AS day, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, k ORDER BY event_id) AS r FROM ({EPISODES})) WHERE r = 1")
def unseen(spark, sf_dir):
    w = W.partitionBy("user_id", "day", "k").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "event_id", F.get_json_object("props", "$.k").alias("k"))
    return e.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
