"""Conversation repair against all edits of short conversations, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = {}
    for key, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out.setdefault(key, []).extend([(turn, "user" if fate == 4 else role, text)] * ((fate != 0) + (fate == 3)))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return {k: sorted(v, key=order) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


INSERTS = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]


def cheapest(rows):
    """The least (cost, audit) over all edits, at most two turns put in at a place."""
    marks, best = faults(rows), None
    choices = [[("D", None)] + ([] if f in ("blank", "duplicate") else [("K", r[1]), ("R", "user"), ("R", "assistant")]) for r, f in zip(rows, marks, strict=True)]
    for edits in itertools.product(*choices):
        for puts in itertools.product(INSERTS, repeat=len(rows) + 1):
            audit, lines = "I" * len(puts[0]), [(x, "") for x in puts[0]]
            cost = 2 * len(lines)
            for (e, role), row, f, put in zip(edits, rows, marks, puts[1:], strict=True):
                cost += {"D": 3, "K": 0, "R": 2}[e] + (f == "truncated" and e != "D") + 2 * len(put)
                audit += e + "I" * len(put)
                lines += ([(role, row[2])] if e != "D" else []) + [(x, "") for x in put]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return best


def want(rows):
    out = {}
    for key, own in damaged(rows).items():
        marks, turns = faults(own), [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[key] = (gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), bad, *cheapest(own))
    return out


def got(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    out = C.repair_digest(C.repair(C.damage(df), gone="gone")).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def test_short_conversations(spark):
    random.seed(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys"]
    rows = []
    for c in range(160):
        for t in range(random.randint(1, 3)):
            rows.append((c, random.choice([t, t, t, None, 2 * t, 7]), random.choice(roles), random.choice(["Yes.", "No", " ", "Yes.", "é? ", None, "x!\n", f"text {c}."])))
    assert got(spark, rows) == want(rows)


def test_order_repeats_and_nulls(spark):
    rows = [(1, 3, "assistant", "B."), (1, None, "user", "A."), (1, 3, "assistant", "B."), (None, 0, "user", "Q?"), (None, 1, "assistant", "R."), (2, 5, "user", ""), (3, None, "system", "S")]
    assert got(spark, rows) == want(rows)


def test_edits_lead_to_the_costs():
    """Both passes on random long conversations: the cost of the edits is the cost to go, and the roles follow the grammar."""
    random.seed(9)
    for _ in range(300):
        rows = [(random.choice("suax"), random.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(random.randint(0, 40))]
        after = [C.END]
        for initial, fault in reversed(rows):
            after.append(C._before(after[-1], initial, fault))
        after.reverse()
        q, cost, roles = 0, 0, ""
        for (initial, fault), behind in zip(rows, after[1:], strict=True):
            letters, end = C._edits(behind, q, initial, fault)
            for x in letters:
                cost += {"D": 3, "K": 0, "R": 2, "I": 2}[x] + (x in "KR" and fault == "truncated")
                roles += "" if x == "D" else initial if x == "K" else C.ROLE[q][0]
                q = q if x == "D" else C.NEXT[q] if x in "IR" else C.KEEP[initial, q]
            assert q == end
        cost, roles = cost + C.END[q], roles + {0: "", 1: "ua", 2: "a", 3: ""}[q]
        assert cost == after[0][0] and re.fullmatch("(s?(ua)+)?", roles)


def test_one_conversation_of_many_turns_and_a_long_text(spark):
    n = 20_000
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(n)] + [(8, 0, "user", "long " * 200_000 + "."), (8, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = {r.conv_id: r for r in C.repair_digest(C.repair(df)).collect()}
    for key in (7, 8):
        lines = "\n".join(f"{r}:{t}" for k, _, r, t in rows if k == key)
        assert out[key].cost == 0 and out[key].audit == "K" * (n if key == 7 else 2) and out[key].repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()
    broken = {r.conv_id: r for r in C.repair_digest(C.repair(C.damage(df), gone="gone")).collect()}
    own = damaged(rows)[7]
    marks = faults(own)
    assert (broken[7].blank, broken[7].duplicate, broken[7].truncated) == tuple(marks.count(f) for f in ("blank", "duplicate", "truncated")) and broken[7].duplicate > 500


def test_nothing_and_other_names(spark):
    kinds = "conv_id long, turn long, role string, text string"
    assert C.repair_digest(C.repair(C.damage(spark.createDataFrame([], kinds)), gone="gone")).count() == 0
    df = spark.createDataFrame([("a", 1, "user", "Q?", "x"), ("a", 2, "user", "R", "y")], "`key.of` string, no int, `my role` string, body string, fault string")
    edits = C.repair(df, "key.of", "no", "my role", "body")
    assert [(r["key.of"], r.place, r.edit, r.was, r.role, r.text, r.fault) for r in sorted(edits.collect(), key=lambda r: r.place)] == [
        ("a", 0, "K", "user", "user", "Q?", ""), ("a", 1, "R", "user", "assistant", "R", "truncated")]
    assert [tuple(r) for r in C.repaired_turns(edits.withColumnRenamed("key.of", "k"), "k").orderBy("turn").collect()] == [("a", 0, "user", "Q?"), ("a", 1, "assistant", "R")]


def test_checksum_is_of_key_and_turn(spark):
    df = spark.range(200).select(F.col("id").alias("conv_id"), (F.col("id") % 7).alias("turn"), F.lit("assistant").alias("role"), F.lit("A.").alias("text"))
    fate = {i: zlib.crc32(f"{i}:{i % 7}".encode()) % 20 for i in range(200)}
    rows = C.damage(df).collect()
    assert {r.conv_id for r in rows if r.gone} == {i for i, f in fate.items() if f == 0} and len(rows) == 200 + sum(f == 3 for f in fate.values())
    assert {r.conv_id for r in rows if r.role == "user"} == {i for i, f in fate.items() if f == 4} and {r.conv_id for r in rows if r.text == "A"} == {i for i, f in fate.items() if f == 2}
