"""Repair of conversations against plain versions: all edits of short ones, a table of texts for longer ones."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm import conversations as C

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
GOOD = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\f\r"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        kept = out.setdefault(conv, [])
        if code:
            row = (turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
            kept += [row] * (2 if code == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def applied(rows, fault, edits):
    """(cost, repaired rows) of edit letters, None where they don't fit."""
    out, at, cost = [], 0, 0
    for e in edits:
        turn_of = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e == "I":
            out.append((turn_of, ""))
            cost += 2
            continue
        if at == len(rows):
            return None
        _, role, text = rows[at]
        if e == "D":
            cost += 3
        elif fault[at] in ("blank", "duplicate"):
            return None
        else:
            out.append((role if e == "K" else turn_of, text))
            cost += (0 if e == "K" else 2) + (fault[at] == "truncated")
        at += 1
    if at < len(rows) or not GOOD.fullmatch("".join(r[:1] if r else "?" for r, _ in out)):
        return None
    return cost, out


def all_edits(rows, fault):
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            edits = "".join("I" * k + e for k, e in zip(inserts, letters)) + "I" * inserts[-1]
            got = applied(rows, fault, edits)
            if got is not None and (best is None or (got[0], edits) < best[:2]):
                best = (got[0], edits, got[1])
    return best


def table_of_texts(rows, fault):
    """The same for any length: whole edit strings in a table by state, inserts relaxed until nothing changes."""
    def relaxed(table):
        changed = True
        while changed:
            changed = False
            for state, (cost, edits) in list(table.items()):
                now = (cost + 2, edits + "I")
                to = "a" if state == "u" else "u"
                if to not in table or now < table[to]:
                    table[to], changed = now, True
        return table

    table = relaxed({"": (0, "")})
    for (_, role, _), f in zip(rows, fault):
        new, first = {}, role[:1]
        for state, (cost, edits) in table.items():
            moves = [(state, 3, "D")]
            if f not in ("blank", "duplicate"):
                more = f == "truncated"
                moves.append(("a" if state == "u" else "u", 2 + more, "R"))
                if (first == "s" and state == "") or (first == "u" and state != "u") or (first == "a" and state == "u"):
                    moves.append((first, more, "K"))
            for to, c, e in moves:
                now = (cost + c, edits + e)
                if to not in new or now < new[to]:
                    new[to] = now
        table = relaxed(new)
    cost, edits = min(v for s, v in table.items() if s in ("", "a"))
    return cost, edits, applied(rows, fault, edits)[1]


def plain(rows, repair=table_of_texts):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    fault = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [(a[1][:1] or "?") + (b[1][:1] or "?") for a, b in zip(rows, rows[1:])]
    cost, edits, out = repair(rows, fault)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, digest), out


def same(got, by_conv, repair=table_of_texts):
    assert len(got) == len(by_conv)
    for r in got:
        assert tuple(r[f] for f in FIELDS) == plain(by_conv[r.conv_id], repair)[0], r


def some_rows(seed, conversations, longest, roles=("system", "user", "assistant", "tool", "", "User")):
    rng = random.Random(seed)
    texts = ["Yes.", "yes", "No!", "", " \t", "Why?", "Because", "a.\n", "é?", "x . "]
    out = []
    for c in range(conversations):
        for _ in range(rng.randint(0, longest)):
            out.append((c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)))
    return out


def grouped(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, r, x))
    return out


def test_query_equals_the_plain_version(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    same(C.op11_conversations(table).collect(), damage(rows))


def test_all_edits_of_short_conversations(spark):
    rows = some_rows(1, 250, 4)
    same(C.repair_summaries(spark.createDataFrame(rows, SCHEMA)).collect(), grouped(rows), all_edits)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_long_conversations_across_batches_and_spills(spark, batch):
    rows = some_rows(2, 30, 300, ("system", "user", "assistant", "assistant", "user"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        same(C.repair_summaries(spark.createDataFrame(rows, SCHEMA).repartition(5), kept=7).collect(), grouped(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_rows_are_those_of_the_hash(spark):
    rows = some_rows(3, 120, 9)
    table = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in C.repair_turns(table, kept=4).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {c: plain(v)[1] for c, v in grouped(rows).items()}
    assert got == {c: v for c, v in want.items() if v}
    kept = C.repair_turns(table).where("edit = 'I'").first()
    assert kept.turn is None and kept.text == ""


def test_damaged_odd_rows(spark):
    rows = some_rows(4, 60, 12) + [(None, None, None, None), (None, 3, "user", "Hello."), (None, 3, "user", "Hello."), (99, 2**62, None, "x."), (99, -(2**62), "user", None)]
    dropped = next((c, t) for c in range(1000, 2000) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows.append((*dropped, "user", "Alone."))
    got = C.op11_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    same(got, damage(rows))
    nothing = next(r for r in got if r.conv_id == dropped[0])
    assert (nothing.audit, nothing.cost, nothing.repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())


def test_nothing_long_texts_and_a_giant_conversation(spark):
    assert C.op11_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "word " * 1_000_000
    got = C.repair_summaries(spark.createDataFrame([(1, 0, "user", long + "."), (1, 1, "assistant", long)], SCHEMA)).first()
    assert (got.audit, got.cost, got.truncated) == ("KK", 1, 1)
    giant = spark.range(60_000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    got = C.repair_summaries(giant, kept=1_000).first()
    rows = [(r.turn, r.role, r.text) for r in giant.collect()]
    small, _ = plain(rows[:600])
    assert len(got.audit) >= 60_000 and got.audit[:590] == small[6][:590] and got.gaps == 0


@pytest.mark.parametrize("name", ["conv", "place", "h1", "initial", "fault", "a`b", "audit"])
def test_other_columns_and_text_ids(spark, name):
    rows = grouped(some_rows(6, 20, 6))
    table = spark.createDataFrame([(c, t, r, x) for c, v in rows.items() for t, r, x in v], SCHEMA)
    same(C.op11_conversations(table.withColumn(name, F.create_map(F.lit("x"), F.lit(1)))).collect(), damage([(c, t, r, x) for c, v in rows.items() for t, r, x in v]))
    named = table.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    assert C.repair_summaries(named).count() == len(rows) and dict(C.repair_turns(named).dtypes)["conv_id"] == "string"
