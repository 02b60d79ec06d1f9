"""Repair of the turn structure of conversations."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.columns import BLANK, wide_hash

START, SYSTEM, USER, ASSISTANT = range(4)  # what the last kept row was
OTHER = 4
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
#: What an edit costs, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows whose backpointers stay in memory; those of longer conversations are spilled.
KEPT_ROWS = 1 << 18
MOST = (1 << 63) - 1
#: Edits of one row as letters, in the order of their codes: none, one or two inserts in front.
LETTERS = [b"I" * k + c for k in range(3) for c in (b"D", b"K", b"R")]
ORDER = {edit: i for i, edit in enumerate(sorted(range(9), key=lambda e: LETTERS[e]))}


def after_insert(state: int) -> int:
    return ASSISTANT if state == USER else USER


def after_keep(state: int, initial: int) -> int | None:
    """The state after a row with this initial is kept; None where it can't stand there."""
    if initial == SYSTEM:
        return SYSTEM if state == START else None
    if initial == USER:
        return USER if state != USER else None
    return ASSISTANT if initial == ASSISTANT and state == USER else None


def row_moves(initial: int, gone: bool) -> list[tuple[int, int, int, int, int]]:
    """(state before, state after, code of the edits, cost, undeleted) of everything that can be done with one row and up to two inserts
    before it. More inserts only go round in circles."""
    out = []
    for before in range(4):
        state = before
        for k in range(3):
            out.append((before, state, 3 * k, INSERT * k + DELETE, 0))
            if not gone:
                kept = after_keep(state, initial)
                if kept is not None:
                    out.append((before, kept, 3 * k + 1, INSERT * k, 1))
                out.append((before, after_insert(state), 3 * k + 2, INSERT * k + REROLE, 1))
            state = after_insert(state)
    return out


MOVES = {(initial, gone): row_moves(initial, gone) for initial in (SYSTEM, USER, ASSISTANT, OTHER) for gone in (False, True)}


class Backpointers:
    """Two bytes for each state of a row: the edit and the state before it. Those of giant conversations go to an unlinked file in the
    worker's temporary folder, as Spark's own spills do, and are read backwards in blocks."""

    def __init__(self, kept: int):
        self.block, self.kept, self.file, self.spilled = bytearray(), 8 * kept, None, 0

    def add(self, row: list[int]) -> None:
        self.block += bytes(row)
        if len(self.block) >= self.kept:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.block)
            self.spilled += len(self.block)
            self.block = bytearray()

    def backwards(self) -> Iterator[memoryview]:
        yield memoryview(self.block)
        while self.spilled:
            size = min(self.spilled, self.kept)
            self.spilled -= size
            self.file.seek(self.spilled)
            yield memoryview(self.file.read(size))

    def close(self) -> None:
        if self.file:
            self.file.close()


class Repair:
    """The cheapest edits of one conversation, row by row. For each state, the cost, the rank of the edits' letters among those of the four
    states, and the hash of the repaired rows so far. Edits that end with one row in two states differ and neither begins with the other, so
    ranks are all that is needed to compare what follows them."""

    def __init__(self, kept: int = KEPT_ROWS):
        self.cost = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.hash = [hashlib.sha256(), None, None, None]
        self.back = Backpointers(kept)
        self.blank = self.duplicate = self.truncated = self.illegal = self.gaps = self.voids = 0
        self.last, self.led_by_system = None, False

    def add(self, initial: int, fault: int, gap: int, role: str, text: str) -> None:
        """fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        self.gaps = min(MOST, self.gaps + gap)
        if self.last is not None:
            self.illegal += (self.last, initial) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        self.last = initial
        best: list[tuple | None] = [None] * 4
        for before, after, code, cost, undeleted in MOVES[initial, fault in (1, 2)]:
            if self.cost[before] is not None:
                total = self.cost[before] + cost + (TRUNCATED if undeleted and fault == 3 else 0)
                key = (total, self.rank[before], ORDER[code], before, code)
                if best[after] is None or key < best[after]:
                    best[after] = key
        pointers, hashes, costs = [0] * 8, [None] * 4, [None] * 4
        for state, key in enumerate(best):
            if key is not None:
                total, _, _, before, code = key
                pointers[2 * state : 2 * state + 2] = code, before
                costs[state], hashes[state] = total, self.written(before, code, role, text)
        order = sorted((s for s in range(4) if best[s] is not None), key=lambda s: best[s][1:3])
        self.rank = [order.index(s) if s in order else 0 for s in range(4)]
        self.cost, self.hash = costs, hashes
        self.back.add(pointers)

    def written(self, before: int, code: int, role: str, text: str):
        out, state = self.hash[before], before
        inserts, letter = divmod(code, 3)
        lines = []
        for _ in range(inserts):
            state = after_insert(state)
            lines.append(f"{ROLES[state]}:")
        if letter:
            lines.append(f"{role if letter == 1 else ROLES[after_insert(state)]}:{text}")
        if not lines:
            return out
        out = out.copy()
        out.update((("\n" if before != START else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return out

    def finish(self) -> tuple[int, bytes, str]:
        """(cost, letters of the edits, hash of the repaired rows)."""
        ends = []
        for state, cost in enumerate(self.cost):
            if cost is not None:
                k = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
                ends.append((cost + INSERT * k, self.rank[state], state, k))
        cost, _, state, k = min(ends)
        digest = self.written(state, 3 * k, "", "").hexdigest()
        parts = [b"I" * k]
        for block in self.back.backwards():
            now = []
            for at in range(len(block) - 8, -1, -8):
                self.led_by_system |= state == SYSTEM  # it stands only after a kept system row
                code, before = block[at + 2 * state], block[at + 2 * state + 1]
                now.append(LETTERS[code])
                state = before
            parts.append(b"".join(reversed(now)))
        self.back.close()
        return cost, b"".join(reversed(parts)), digest


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows (conv, place, void, initial, fault, gap, role, text) of `conversations` (conv_id, turn, role, text and, where a row only names its
    conversation, void), dealt by conversation and sorted by turn in it. One shuffle: what follows is sorted within its partitions. A
    duplicate is found by its place among rows of one role and text, so no conversation's texts are held."""
    rows = conversations.select("turn", "role", "text", "void", F.col("conv_id").cast("string").alias("conv"), *wide_hash(F.col("role"), F.char_length("role"), F.col("text")))
    rows = rows.repartition("conv")
    same = Window.partitionBy("conv", "void", "h1", "h2").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("copy", F.row_number().over(same))
    by_turn = Window.partitionBy("conv").orderBy(F.desc("void"), F.asc_nulls_first("turn"), "role", "text", "copy")
    bare = F.btrim(F.col("text"), F.lit(BLANK))
    wide = F.col("turn").cast("decimal(20,0)")
    gap = F.least(F.greatest(wide - F.lag(F.when(~F.col("void"), wide)).over(by_turn) - 1, F.lit(0)), F.lit(MOST))
    fault = F.when(bare == "", 1).when(F.col("copy") > 1, 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return rows.select(
        "conv", F.row_number().over(by_turn).alias("place"), "void", "turn",
        F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))), F.lit(0)), F.lit(OTHER)).alias("found"),
        fault.alias("fault"), F.coalesce(gap, F.lit(0)).cast("bigint").alias("gap"), "role", "text",
    ).withColumn("initial", F.when(F.col("role") == "", OTHER).otherwise(F.col("found"))).drop("found")


def repairs(batches: Iterator[pd.DataFrame], kept: int = KEPT_ROWS) -> Iterator[tuple[str | None, Repair]]:
    """Each conversation of sorted rows with its repair, carried from batch to batch."""
    conv, now = None, None
    for batch in batches:
        rows = zip(*(batch[c].tolist() for c in ("conv", "void", "initial", "fault", "gap", "role", "text")))
        for key, void, initial, fault, gap, role, text in rows:
            if now is None or key != conv:
                if now is not None:
                    yield conv, now
                conv, now = key, Repair(kept)
            if void:
                now.voids += 1
            else:
                now.add(initial, fault, gap, role, text)
    if now is not None:
        yield conv, now


SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv string, place long, position long, edit string, new_role string"
EDIT_ROWS = 10_000
STREAMED = ("conv", "void", "initial", "fault", "gap", "role", "text")


def prepared(conversations: DataFrame) -> DataFrame:
    """Missing roles and texts are one blank."""
    void = F.col("void") if "void" in conversations.columns else F.lit(False).alias("void")
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *filled, void)


def repair_summaries(conversations: DataFrame, kept: int = KEPT_ROWS) -> DataFrame:
    """A row for each conv_id of `conversations` (conv_id, turn, role, text): gaps between turn numbers, rows by their first fault, illegal
    neighbours, the least cost of a repair, its edits' letters and the hash of the repaired rows.

    Rows of a conversation go by turn, missing ones first, and rows of one turn by role, text. A row is blank without any character but
    blanks, a duplicate if role and text were seen before, truncated if its last character isn't one of .!? . Roles must become a system
    row or none and then pairs of user and assistant: Keep is free, Rerole costs 2, Delete 3 (and is required for blank and duplicate rows),
    Insert 2, an undeleted truncated row 1. Of equally cheap edits the least letters win.

    Rows are dealt by conversation and sorted by turn; mapInPandas carries four states of a dynamic program from batch to batch, with two
    bytes per state and row to trace the edits back, which giant conversations spill. A conversation is one stream in one task, as its states
    follow one another, but only its letters and backpointers are held.

    Missing roles and texts count as one blank, roles of other initials (also an empty one) can't be kept. Rows without conv_id are one
    conversation. Repeated rows are duplicates. Extra columns are not read, but for `void`, which marks rows that only name their
    conversation. An empty table gives an empty result."""

    def work(batches):
        out = []
        for conv, r in repairs(batches, kept):
            cost, audit, digest = r.finish()
            out.append((conv, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, cost, audit.decode(), digest))
            if len(out) >= EDIT_ROWS or len(audit) > EDIT_ROWS:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SUMMARY.split(", ")])
                out = []
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SUMMARY.split(", ")])

    got = ordered(prepared(conversations)).select(*STREAMED).mapInPandas(work, SUMMARY)
    return got.select(F.col("conv").cast(conversations.schema["conv_id"].dataType).alias("conv_id"), *[c.split()[0] for c in SUMMARY.split(", ")[1:]])


def repair_turns(conversations: DataFrame, kept: int = KEPT_ROWS) -> DataFrame:
    """The repaired rows themselves: conv_id, position (from 0), edit (K, R or I), turn, role, text, for `conversations` as
    `repair_summaries` takes them. An inserted row has no turn and an empty text. A conversation whose rows all go has none."""

    def work(batches):
        for conv, r in repairs(batches, kept):
            _, audit, _ = r.finish()
            letters = np.frombuffer(audit, np.uint8)
            own, stays = letters != ord("I"), letters != ord("D")
            place, position = np.cumsum(own) + r.voids, np.cumsum(stays) - 1
            names = np.where((position - r.led_by_system) % 2 == 0, "user", "assistant")
            for s in range(0, len(letters), EDIT_ROWS):
                at = np.flatnonzero(stays[s : s + EDIT_ROWS]) + s
                out = [(conv, int(place[i]) if own[i] else 0, int(position[i]), chr(letters[i]), None if letters[i] == ord("K") else str(names[i])) for i in at]
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in EDITS.split(", ")])

    rows = ordered(prepared(conversations))
    edits = rows.select(*STREAMED).mapInPandas(work, EDITS).withColumnsRenamed({"conv": "to", "place": "at"})
    told = edits.join(rows.select("conv", "place", "turn", "role", "text"), F.col("to").eqNullSafe(F.col("conv")) & (F.col("at") == F.col("place")), "left")
    return told.select(
        F.col("to").cast(conversations.schema["conv_id"].dataType).alias("conv_id"), "position", "edit", "turn",
        F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of `conversations` with faults put in by crc32 of `conv_id:turn`, modulo 20: 0 drops the row (what is left of it names the
    conversation), 1 empties the text, 2 takes its .!? out, 3 repeats the row, 4 makes the role user. What is missing counts as one blank."""
    conv_id, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    code = F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), code.alias("code"))
    void = F.col("code") == 0
    text = F.when(void | (F.col("code") == 1), "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(void, "").when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))
    return rows.select("conv_id", F.when(~void, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), void.alias("void"), F.explode(times)).drop("col")


def op11_conversations(conversations: DataFrame) -> DataFrame:
    return repair_summaries(damaged(conversations))
