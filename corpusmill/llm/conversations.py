"""Conversation structure repair by the cheapest edits.

A conversation's roles should read as the grammar ``(s?(ua)+)?`` of their
initials, without blank or repeated rows.  A backward pass over its turns
computes, for each state of the grammar, the least cost to go; a forward walk
then takes, of the edits on a cheapest way, the one whose initial is least.

Both passes stream over sorted rows and hold one row and four costs, however
long a conversation is: the first reads turns from last to first and leaves
with each row the costs and the number of rows behind it, the second reads them
from first to last.
Rows that repeat an earlier one are found before by the first turn of each role
and text, combined before the shuffle.  Rebuilt turns are rows; their digest
streams as well, for one hash covers a whole conversation in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, whose absence makes a row blank.
SPACE = " \t\n\x0b\x0c\r"
#: States of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after a; it may end in 0 and 3.
#: What stands next when a user or assistant is put in, its role, and what a row kept leads to.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1
#: The costs behind the last row.
END = (0, 2 * INSERT_COST, INSERT_COST, 0)
LEGAL = ("su", "ua", "au")


def damage(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(key, turn, role, text, gone)``: rows damaged by the checksum of ``key:turn`` modulo 20.

    0 drops a row (``gone``; it is returned, so that its conversation stays
    known), 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it the
    user's.  A null key or turn is one space in the checksum, and stays null; a
    null role or text becomes one space.
    """
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(name(key), F.lit(":"), name(turn)).cast("binary")), F.lit(20))
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{turn}`").alias("turn"), name(role).alias("role"), name(text).alias("text"), fate.alias("fate"))
    fate = F.col("fate")
    texts = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(f"`{key}`", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), texts.alias("text"), (fate == 0).alias("gone"), "fate")
    return rows.withColumn("copy", F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("fate", "copy")


def _before(after: tuple, initial: str, fault: str) -> tuple:
    """The costs to go in front of a row, from those behind it."""
    must, extra = fault in ("blank", "duplicate"), TRUNCATED_COST * (fault == "truncated")
    cost = [0] * 4
    for q in range(4):
        best = DELETE_COST + after[q]
        if not must:
            best = min(best, REROLE_COST + extra + after[NEXT[q]])
            kept = KEEP.get((initial, q))
            if kept is not None:
                best = min(best, extra + after[kept])
        cost[q] = best
    user, assistant = min(cost[2], INSERT_COST + cost[3]), min(cost[3], INSERT_COST + cost[2])
    return min(cost[0], INSERT_COST + user), min(cost[1], INSERT_COST + user), user, assistant


def _edits(after: tuple, q: int, initial: str, fault: str) -> tuple[str, int]:
    """The least letters on a cheapest way over one row from state ``q``, the row's own edit last, and the state behind it."""
    here, letters = _before(after, initial, fault), ""
    must, extra = fault in ("blank", "duplicate"), TRUNCATED_COST * (fault == "truncated")
    while True:
        if DELETE_COST + after[q] == here[q]:
            return letters + "D", q
        if INSERT_COST + here[NEXT[q]] == here[q]:
            letters, q = letters + "I", NEXT[q]
            continue
        kept = None if must else KEEP.get((initial, q))
        if kept is not None and extra + after[kept] == here[q]:
            return letters + "K", kept
        return letters + "R", NEXT[q]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of so many, or fewer where texts are long."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 1 + sum(len(x) for x in row if isinstance(x, str)) // 4000
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _backward(schema: pa.Schema):
    """Rows from last to first: each with its fault and the costs behind it."""

    def told(rows):
        held, after, behind = None, END, 0

        def close(before):
            nonlocal after, behind
            key, turn, role, text, mark, gone, blank, cut_short, later = held
            fault = "blank" if blank else "duplicate" if later or before == (key, turn, role, mark) else "truncated" if cut_short else ""
            out = (key, turn, role, text, False, fault, behind, *after)
            after, behind = _before(after, role[:1], fault), behind + 1
            return out

        for row in rows:
            if row[5]:
                yield (*row[:4], True, "", None, None, None, None, None)
                continue
            if held is not None:
                yield close((row[0], row[1], row[2], row[4]))
                if row[0] != held[0]:
                    after, behind = END, 0
            held = row
        if held is not None:
            yield close(None)

    return lambda batches: _batches(told(_rows(batches)), schema)


def _forward(schema: pa.Schema):
    """Rows from first to last: one for each edit."""

    def told(rows):
        key, started, q, place = None, False, 0, 0

        def finish():
            nonlocal q, place
            while q in (1, 2):
                yield (key, place, "I", None, None, ROLE[q], "", "")
                q, place = NEXT[q], place + 1

        for own, turn, role, text, gone, fault, _, *after in rows:
            if started and own != key:
                yield from finish()
                q, place = 0, 0
            key, started = own, True
            if gone:
                yield (own, None, None, turn, role, None, None, "")
                continue
            letters, end = _edits(tuple(after), q, role[:1], fault)
            for _ in letters[:-1]:
                yield (key, place, "I", None, None, ROLE[q], "", "")
                q, place = NEXT[q], place + 1
            edit = letters[-1]
            yield (key, place, edit, turn, role, None if edit == "D" else ROLE[q] if edit == "R" else role, None if edit == "D" else text, fault)
            q, place = end, place + 1
        yield from finish()

    return lambda batches: _batches(told(_rows(batches)), schema)


def _schema(kinds: str, spark) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return kinds, to_arrow_schema(spark.createDataFrame([], kinds).schema)


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row for each edit: ``(key, place, edit, turn, was, role, text, fault)``.

    ``place`` counts a conversation's edits from 0; ``edit`` is K, R, D or I;
    ``was`` is the row's role before (null if inserted); ``role`` and ``text``
    make up the repaired turn and are null where it was deleted.  Rows come
    sorted by key and place within a partition.  Faults: ``blank``, else
    ``duplicate`` of an earlier row's role and text, else ``truncated``.

    Defined results: turns are taken from smallest to largest, nulls first, those
    of one number by role, then by the hash of their text; a null role or text
    counts as one space; rows without a key are one conversation; rows whose
    column ``gone`` is true count for nothing, but are returned without an edit,
    so their conversation stays known; very long texts and conversations stream;
    other columns are not read; an empty table gives an empty one.
    """
    at = lambda c: F.col(f"`{c}`")
    space = lambda c: F.coalesce(at(c).cast("string"), F.lit(" "))
    rows = df.select(at(key).alias("key"), at(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.coalesce(at(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"))
    rows = rows.withColumn("mark", F.sha2(F.col("text").cast("binary"), 256))
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.where("NOT gone").groupBy("key", "role", "mark").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last")
    first = first.select(F.col("key").alias("k"), F.col("role").alias("r"), F.col("mark").alias("m"), "first")
    rows = rows.join(first, F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m")) & (F.col("role") == F.col("r")), "left")
    trimmed = F.rtrim("text", F.lit(SPACE))
    rows = rows.select("key", "turn", "role", "text", "mark", "gone", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut_short"),
                       F.coalesce(order > F.col("first"), F.lit(False)).alias("later"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("key", "turn")}
    costs = ", ".join(f"c{q} long" for q in range(4))
    kinds, schema = _schema(f"key {kind['key']}, turn {kind['turn']}, role string, text string, gone boolean, fault string, behind long, {costs}", df.sparkSession)
    down = [F.asc("key"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("mark")]
    told = rows.repartition("key").sortWithinPartitions(*down).mapInArrow(_backward(schema), kinds)
    kinds, schema = _schema(f"key {kind['key']}, place long, edit string, turn {kind['turn']}, was string, role string, text string, fault string", df.sparkSession)
    return told.repartition("key").sortWithinPartitions("key", F.desc("behind")).mapInArrow(_forward(schema), kinds).withColumnRenamed("key", key)


def _digest(schema: pa.Schema):
    """One row for each conversation, of edits in order."""

    def told(rows):
        key, state = None, None

        def start():
            return {"turns": None, "n": dict.fromkeys(("blank", "duplicate", "truncated"), 0), "illegal": 0, "cost": 0, "audit": bytearray(), "sha": hashlib.sha256(), "was": None, "lines": 0}

        def out():
            low, high, distinct = state["turns"] or (0, 0, 1)
            return (key, high - low + 1 - distinct, *state["n"].values(), state["illegal"], state["cost"], state["audit"].decode(), state["sha"].hexdigest())

        for own, _, edit, turn, was, role, text, fault in rows:
            if state is None or own != key:
                if state is not None:
                    yield out()
                key, state = own, start()
            if edit is None:
                continue
            state["audit"] += edit.encode()
            if edit != "I":
                if turn is not None:
                    low, high, distinct = state["turns"] or (turn, turn - 1, 0)
                    state["turns"] = low, turn, distinct + (turn != high)
                if fault:
                    state["n"][fault] += 1
                if state["was"] is not None:
                    state["illegal"] += state["was"] + was[:1] not in LEGAL
                state["was"] = was[:1]
            state["cost"] += {"D": DELETE_COST, "I": INSERT_COST, "K": 0, "R": REROLE_COST}[edit] + TRUNCATED_COST * (fault == "truncated" and edit != "D")
            if edit != "D":
                state["sha"].update((b"\n" if state["lines"] else b"") + f"{role}:{text}".encode())
                state["lines"] += 1
        if state is not None:
            yield out()

    return lambda batches: _batches(told(_rows(batches)), schema)


def repair_digest(edits: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``repair``'s result, whose partitions it reads in order.

    ``gaps`` (turn numbers that are missing between the smallest and largest),
    counts of faults, ``illegal`` (neighbouring roles, before the repair, whose
    initials are not su, ua or au), ``cost``, ``audit`` (the edits' initials) and
    ``repaired_sha256`` (repaired ``role:text``, joined by newlines).  A
    conversation without rows has zeros, no edits and the hash of nothing.
    """
    names = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    kinds, schema = _schema(f"key {edits.schema[key].dataType.simpleString()}, {names}", edits.sparkSession)
    plain = edits.select(key, "place", "edit", F.col("turn").cast("long").alias("turn"), "was", "role", "text", "fault")
    return plain.mapInArrow(_digest(schema), kinds).withColumnRenamed("key", key)


def repaired_turns(edits: DataFrame, key: str = "conv_id") -> DataFrame:
    """The repaired conversations as rows ``(key, turn, role, text)``, turns numbered anew by their places."""
    return edits.where("role IS NOT NULL").select(key, F.col("place").alias("turn"), "role", "text")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of all conversations, damaged as it says; odd rows as ``damage`` and ``repair`` say."""
    return repair_digest(repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone="gone"))


def _option(cost: str, audit: str, lines: str) -> str:
    return f"{{'c': {cost}, 'a': {audit}, 't': {lines}}}"


def _oracle() -> str:
    """The same costs as a recursion over rows, which carries the least audit and the lines of each state."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""
    line = "r.role || ':' || r.text"

    def base(q: int) -> str:
        to = NEXT[q]
        kept = "".join(f" WHEN left(r.role, 1) = '{x}' THEN [{_option(f's.o[{k + 1}].c + r.extra', f"'K' || s.o[{k + 1}].a", f'list_prepend({line}, s.o[{k + 1}].t)')}]" for (x, at), k in KEEP.items() if at == q)
        options = [_option(f"s.o[{q + 1}].c + 3", f"'D' || s.o[{q + 1}].a", f"s.o[{q + 1}].t")]
        rerole = _option(f"s.o[{to + 1}].c + 2 + r.extra", f"'R' || s.o[{to + 1}].a", f"list_prepend('{ROLE[q]}:' || r.text, s.o[{to + 1}].t)")
        return f"list_sort([{options[0]}] || CASE WHEN r.must THEN [] ELSE [{rerole}] END || CASE WHEN r.must THEN []{kept} ELSE [] END)[1]"

    put = lambda x, to: _option(f"{x}.c + 2", f"'I' || {x}.a", f"list_prepend('{'user' if to == 2 else 'assistant'}:', {x}.t)")
    least = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    return f"""
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS fate FROM conversations),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) AS nth FROM f WHERE fate <> 0),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS was, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM i),
r AS (SELECT *, body = '' AS blank, body <> '' AND seen AS dup, body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS short, body = '' OR seen AS must,
  (body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?'))::BIGINT AS extra FROM e),
s AS (
  SELECT conv_id, max(i) AS i, [{_option('0::BIGINT', "''", '[]::VARCHAR[]')}, {_option('4::BIGINT', "'II'", "['user:', 'assistant:']")}, {_option('2::BIGINT', "'I'", "['assistant:']")}, {_option('0::BIGINT', "''", '[]::VARCHAR[]')}] AS o FROM r GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, [{least('b[1]', put('g2', 2))}, {least('b[2]', put('g2', 2))}, g2, g3] FROM (
    SELECT conv_id, i, b, {least('b[3]', put('b[4]', 3))} AS g2, {least('b[4]', put('b[3]', 2))} AS g3 FROM (
      SELECT s.conv_id, s.i - 1 AS i, [{', '.join(base(q) for q in range(4))}] AS b FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i))
),
z AS (SELECT conv_id, o[1] AS o FROM s WHERE i = 0),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE short) AS truncated,
  count(*) FILTER (WHERE i > 1 AND left(was, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(z.o.c, 0)::BIGINT AS cost, coalesce(z.o.a, '') AS audit, sha256(coalesce(array_to_string(z.o.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE_SQL = _oracle()
