"""Conversation repair as a lightest derivation, found with Knuth's agenda.

An item (i, state) says: the first i rows have been dealt with, and what stays of them leaves the grammar `(s?(ua)+)?` in this state.
Deductions are the edits: keep, rerole or delete row i, or insert an empty turn. Each is a function of an item's weight (cost, audit),
which adds a cost and a letter; it never makes a weight smaller and keeps their order, so the agenda pops every item at its least
weight, and the first goal that it pops is the cheapest repair with the least audit.

A conversation may hold most of all rows. Its rows arrive sorted, are dealt with in segments, and between two segments only four
items are kept: cost, audit and the digest of what they would leave.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_ROWS, SEGMENT_CHARS = 256, 4_000_000
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT, GOAL = range(5)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the turn that may always follow
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def after(state: int, initial: str) -> int | None:
    """The state that a kept row leads to, if it may stand there."""
    to = INITIAL.get(initial)
    return to if to is not None and (to == NEXT[state] or (state == NOTHING and to == SYSTEM)) else None


def lightest(rows: list[tuple[str, str]], entries: dict[int, tuple[int, int, str]], last: bool) -> dict[int, tuple[int, int, str, int]]:
    """Least weights of the items behind all rows (of the goal alone, if these rows are the last), by state.

    rows: (role initial, fault). entries: state before the rows -> (cost, rank of the audit so far, what its audit has beyond that).
    A weight is (cost, rank, audit from there on, entry state): audits of different ranks differ before they end, so ranks decide.
    """
    agenda = [(cost, rank, audit, state, 0, state) for state, (cost, rank, audit) in entries.items()]
    heapq.heapify(agenda)
    final, wanted, found = set(), 1 if last else 4, {}
    while agenda and len(found) < wanted:
        cost, rank, audit, entry, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if state == GOAL:
            found[GOAL] = (cost, rank, audit, entry)
            continue

        def deduce(more: int, letter: str, at: int, to: int) -> None:
            if (at, to) not in final:
                heapq.heappush(agenda, (cost + more, rank, audit + letter, entry, at, to))

        deduce(INSERT, "I", i, NEXT[state])
        if i == len(rows):
            if not last:
                found[state] = (cost, rank, audit, entry)
            elif state in (NOTHING, ASSISTANT):
                deduce(0, "", i, GOAL)
            continue
        initial, fault = rows[i]
        deduce(DELETE, "D", i + 1, state)
        if fault not in ("blank", "duplicate"):
            stays = UNFINISHED if fault == "truncated" else 0
            if (to := after(state, initial)) is not None:
                deduce(stays, "K", i + 1, to)
            deduce(REROLE + stays, "R", i + 1, NEXT[state])
    return found


def left_over(digest, state: int, edits: str, rows: list[tuple[str, str, str, str]]) -> None:
    """Add the lines `role:text` that the edits leave of the rows to a digest."""
    at = 0
    for letter in edits:
        role, text, initial, _ = rows[at] if letter != "I" else ("", "", "", "")
        at += letter != "I"
        if letter == "D":
            continue
        to = after(state, initial) if letter == "K" else NEXT[state]
        line = f"{role if letter == 'K' else NAMES[to]}:{text}"
        digest.update((line if state == NOTHING else "\n" + line).encode())
        state = to


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.turns, self.low, self.high, self.initial = 0, 0, None, None, None
        self.rows: list[tuple[str, str, str, str]] = []
        self.chars = 0
        self.entries = {NOTHING: (0, 0, "")}
        self.audits: list[tuple | None] = [None]  # by rank: (audit before, more of it), shared from the end
        self.digests = {NOTHING: hashlib.sha256()}

    def add(self, turn, role: str, text: str, initial: str, fault: str) -> None:
        if len(self.rows) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS:
            self.advance()
        self.rows.append((role, text, initial, fault))
        self.chars += len(text)
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn

    def advance(self) -> None:
        """Deal with the rows so far, of which more follow."""
        exits = lightest([r[2:] for r in self.rows], self.entries, last=False)
        digests, entries, audits = {}, {}, []
        for state, (_, _, audit, entry) in exits.items():
            digests[state] = self.digests[entry].copy()
            left_over(digests[state], entry, audit[len(self.entries[entry][2]) :], self.rows)
        base = None
        for rank, audit, cost, state in sorted((rank, audit, cost, state) for state, (cost, rank, audit, _) in exits.items()):
            if base is None or base[0] != rank or not audit.startswith(base[1]):
                base = (rank, audit)
                audits.append((self.audits[rank], audit))
            entries[state] = (cost, len(audits) - 1, audit[len(base[1]) :])
        self.entries, self.audits, self.digests, self.rows, self.chars = entries, audits, digests, [], 0

    def report(self) -> dict:
        cost, rank, audit, entry = lightest([r[2:] for r in self.rows], self.entries, last=True)[GOAL]
        left_over(self.digests[entry], entry, audit[len(self.entries[entry][2]) :], self.rows)
        parts, before = [audit], self.audits[rank]
        while before is not None:
            before, more = before
            parts.append(more)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": "".join(reversed(parts)), "repaired_sha256": self.digests[entry].hexdigest()}


def damage(turns: DataFrame) -> DataFrame:
    """Conversations with faults, by crc32 of `conv_id:turn` modulo 20; a null counts as one space there, and as a role or text.

    0 drops the row (it stays as one with `dropped`, so that its conversation is not lost), 1 empties its text, 2 removes `.`, `!`
    and `?` from it, 3 repeats the row, 4 makes the user its speaker.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    return (
        rows.withColumn("kind", kind)
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), (F.col("kind") == 0).alias("dropped"))
    )


def _fault(text: Column, copy: Column) -> Column:
    end = F.rtrim(text, F.lit(SPACE))
    return F.when(end == "", "blank").when(copy > 1, "duplicate").when(F.substring(end, -1, 1).isin(".", "!", "?"), "").otherwise("truncated")


def _plain(turns: DataFrame) -> DataFrame:
    dropped = F.col("dropped") if "dropped" in turns.columns and dict(turns.dtypes)["dropped"] == "boolean" else F.lit(False)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce(dropped, F.lit(False)).alias("dropped"))


def repair(turns: DataFrame) -> DataFrame:
    """One report for each conversation: its faults, the cost and audit of its cheapest repair, and the digest of what that leaves.

    Rows are taken by turn (nulls first), then role, then text. A row's first fault counts: blank, duplicate (role and text seen earlier
    in the conversation), truncated (the last character but space is none of `.!?`). gaps: turn numbers missing between the least and the
    largest; illegal: neighbours whose role initials are not su, ua or au. Audits hold K(eep), R(erole), D(elete), I(nsert). A null role or
    text is one space; a role without one of the initials s, u, a can't be kept. Rows without conv_id form one conversation. A boolean column
    `dropped` marks rows that don't count but whose conversation is reported; without rows it has zeros and an empty audit. Other
    columns are ignored; no rows, no reports.

    One exchange by conversation. The earlier copies of a row and the order of the turns come from external sorts, rows are streamed, so memory
    is that of a segment, plus one byte for each row of the conversation and item, as the audit itself has.
    """
    own = _plain(turns).repartition("conv_id")
    copy = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn"))
    faults = own.withColumn("copy", copy).select("*", F.substring("role", 1, 1).alias("initial"), _fault(F.col("text"), F.col("copy")).alias("fault"))
    ordered = faults.sortWithinPartitions("conv_id", "turn", "role", "text", "copy").drop("copy")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            for conv_id, turn, role, text, dropped, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.report())
                    current = _Conversation(conv_id)
                if not dropped:
                    current.add(turn, role, text, initial, fault)
            yield pa.RecordBatch.from_pylist(done, schema=SCHEMA)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.report()], schema=SCHEMA)

    return ordered.mapInArrow(read, REPORT)


def repaired_turns(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """The turns that the audits of repair() leave: conv_id, position from 0, role, text, edit, turn (null for inserted ones)."""
    by_place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = _plain(turns).where(~F.col("dropped")).select("conv_id", "turn", "role", "text", F.row_number().over(by_place).alias("row"))
    steps = reports.select("conv_id", F.posexplode(F.split("audit", "")).alias("step", "edit")).where(F.col("edit") != "")
    before = Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("*", F.when(F.col("edit") != "I", F.count(F.when(F.col("edit") != "I", 1)).over(before)).alias("row")).where(F.col("edit") != "D")
    joined = steps.withColumnRenamed("conv_id", "conv").join(rows, F.col("conv").eqNullSafe(F.col("conv_id")) & (steps["row"] == rows["row"]), "left")
    kept = Window.partitionBy("conv").orderBy("step")
    system = F.first(F.when((F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(kept)
    position = F.row_number().over(kept) - 1
    role = F.when(F.col("edit") == "K", F.col("role")).when((F.col("position") - F.col("system")) % 2 == 0, "user").otherwise("assistant")
    placed = joined.select(F.col("conv").alias("conv_id"), position.alias("position"), system.alias("system"), "role", "turn", "edit", F.coalesce("text", F.lit("")).alias("text"))
    return placed.select("conv_id", "position", role.alias("role"), "text", "edit", "turn")
