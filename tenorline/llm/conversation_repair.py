"""Repair of conversation structure by a weighted automaton that is determinised as rows come.

A conversation's roles should read (s?(ua)+)?: nothing, or a system turn or none and then user and assistant in turns. Edits have costs
(COSTS): keep, rerole to user or assistant, delete, insert an empty user or assistant turn. The weighted automaton has four states:
START, SYSTEM (after s), USER (after u), ASSISTANT (after a); in each state, an edit leads to one state at most.

Its cost vector (cheapest cost of each state after some rows, inserts included) less its minimum is one state of a deterministic automaton.
Vectors that differ by their minimum only have the same future, and entries that can't be on a cheapest way any more are dropped, so there
are few; they get numbers when they first come up, and steps (vector, row) are remembered in a table. So the scan of a row is one look-up,
and the sum of minima and the last vector give the cost. Then steps back over the same vectors mark the states from which tight arcs (whose
costs are just the difference of both ends) lead to the cheapest end; these steps are remembered, too. From the start, the ASCII-least
edit whose arc is tight and marked is the next of the audit, since an edit leads from a state to one state only.

Rows are kept as one number each while a conversation is scanned, about ten bytes a row, which is what the audit takes itself; texts stay
outside and are joined to the edits afterwards, and a digest over texts is a stream over sorted rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
#: Cost of each edit; TRUNCATED more for a truncated row that isn't deleted.
COSTS = {"D": 4, "I": 3, "K": 0, "R": 3}
TRUNCATED = 3
#: White space that doesn't count as content.
BLANK = " \t\n\x0b\x0c\r"
_NEVER = 1 << 30
_TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: A row as a number: class of its role (s, u, a, other), 4 if it is truncated, 8 if it is blank, 16 if it is a duplicate.
_CUT, _EMPTY, _AGAIN = 4, 8, 16


def arcs(state: int, row: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits of a row in a state, in the order of their letters."""
    out = [("D", COSTS["D"], state)]
    if not row & (_EMPTY | _AGAIN):
        role, more = row & 3, TRUNCATED if row & _CUT else 0
        if role == 0 and state == START:
            out.append(("K", COSTS["K"] + more, SYSTEM))
        elif role == 1 and state != USER or role == 2 and state == USER:
            out.append(("K", COSTS["K"] + more, _TURN[state]))
        out.append(("R", COSTS["R"] + more, _TURN[state]))
    return out


class Automaton:
    """The deterministic automaton, as far as it has come up."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self._number: dict[tuple[int, ...], int] = {}
        self._steps: dict[tuple[int, int], tuple[int, int]] = {}
        self._marks: dict[tuple[int, int, int], int] = {}
        self.start = self._state([0, _NEVER, _NEVER, _NEVER])[0]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """Number of a vector, inserts worked in, and its minimum."""
        v = list(costs)
        for _ in range(2):
            for s in range(4):
                v[_TURN[s]] = min(v[_TURN[s]], v[s] + COSTS["I"])
        # From ASSISTANT all goes on as from SYSTEM, and as from START but for a kept system row, which can be deleted instead.
        if v[SYSTEM] > v[ASSISTANT]:
            v[SYSTEM] = _NEVER
        if v[START] > v[ASSISTANT] + COSTS["D"]:
            v[START] = _NEVER
        low = min(v)
        key = tuple(x - low if x < _NEVER else _NEVER for x in v)
        if key not in self._number:
            self._number[key] = len(self.vectors)
            self.vectors.append(key)
        return self._number[key], low

    def step(self, at: int, row: int) -> tuple[int, int]:
        """Next state and what the minimum rises by."""
        key = (at, row & ~3 if row & (_EMPTY | _AGAIN) else row)
        if (known := self._steps.get(key)) is None:
            v, after = self.vectors[at], [_NEVER] * 4
            for s in range(4):
                for _, cost, to in arcs(s, row) if v[s] < _NEVER else ():
                    after[to] = min(after[to], v[s] + cost)
            known = self._steps[key] = self._state(after)
        return known

    def inserts(self, at: int, marks: int) -> int:
        """marks with the states from which tight inserts lead to a marked one."""
        v = self.vectors[at]
        for _ in range(2):
            for s in range(4):
                if v[s] < _NEVER and marks >> _TURN[s] & 1 and v[s] + COSTS["I"] == v[_TURN[s]]:
                    marks |= 1 << s
        return marks

    def back(self, at: int, row: int, marks: int) -> int:
        """The marked states before a row, given those after it."""
        key = (at, row, marks)
        if (known := self._marks.get(key)) is None:
            v, (after, rise) = self.vectors[at], self.step(at, row)
            w, before = self.vectors[after], 0
            for s in range(4):
                if v[s] < _NEVER and any(marks >> to & 1 and v[s] + cost == w[to] + rise for _, cost, to in arcs(s, row)):
                    before |= 1 << s
            known = self._marks[key] = self.inserts(at, before)
        return known

    def repair(self, rows: bytes | bytearray) -> tuple[int, str]:
        """Cost and audit of a conversation."""
        at, cost, seen = self.start, 0, array("i", [self.start])
        for row in rows:
            at, rise = self.step(at, row)
            cost += rise
            seen.append(at)
        v = self.vectors[at]
        best = min(v[START], v[ASSISTANT])
        marks = bytearray(len(seen))
        marks[-1] = self.inserts(at, sum(1 << s for s in (START, ASSISTANT) if v[s] == best))
        for i in range(len(rows) - 1, -1, -1):
            marks[i] = self.back(seen[i], rows[i], marks[i + 1])
        out, state, i = [], START, 0
        while i < len(rows) or not (state in (START, ASSISTANT) and v[state] == best):
            edit, state = self._least(seen, marks, rows, i, state)
            out.append(edit)
            i += edit != "I"
        return cost + best, "".join(out)

    def _least(self, seen: array, marks: bytearray, rows: bytes | bytearray, i: int, state: int) -> tuple[str, int]:
        v = self.vectors[seen[i]]
        choices = [("I", _TURN[state])] if marks[i] >> _TURN[state] & 1 and v[state] + COSTS["I"] == v[_TURN[state]] else []
        if i < len(rows):
            after, rise = self.step(seen[i], rows[i])
            choices += [(e, to) for e, cost, to in arcs(state, rows[i]) if marks[i + 1] >> to & 1 and v[state] + cost == self.vectors[after][to] + rise]
        return min(choices)


def role_class(role: Column) -> Column:
    """0 to 3 for a role by its first letter: system, user, assistant, another."""
    return F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3)


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0, by turn, nulls first, then role and text), turn, role, text and code (the row as a number) of rows (conv_id, turn, role, text).

    A row's first fault counts: blank, duplicate (role and text stood at an earlier place), truncated (its last character that isn't white is no end mark).
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    # Within what is partitioned by conversation already: another sort, no other shuffle.
    again = F.row_number().over(Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy("place")) > 1
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = F.when(end == "", _EMPTY).when(again, _AGAIN).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), _CUT).otherwise(0)
    return rows.select("conv_id", "place", "turn", "role", "text", (role_class(F.col("role")) + fault).cast("int").alias("code"))


_EDITS = "conv_id long, step long, place long, edit string, role string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def edits(rows: DataFrame) -> DataFrame:
    """For each conversation of placed() a row with its counts, cost and audit (step is null), and a row for each edit: step, place of the edited row (null: inserted), edit, new role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton()
        schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in _EDITS.split(", "))])

        def close(conv: int | None, codes: bytearray, low: int | None, high: int | None, turns: int) -> pa.RecordBatch:
            cost, audit = machine.repair(codes)
            kinds = [c & 3 for c in codes]
            illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(kinds, kinds[1:]))
            faults = [sum(1 for c in codes if c & f) for f in (_EMPTY, _AGAIN, _CUT)]
            whole = [high - low + 1 - turns if turns else 0, *faults, illegal, cost, audit]
            places, roles, state, i = [], [], START, 0
            for e in audit:
                places.append(None if e == "I" else i)
                state = next(to for x, _, to in arcs(state, codes[i]) if x == e) if e != "I" else _TURN[state]
                roles.append(("user", "assistant")[state == ASSISTANT] if e in "IR" else None)
                i += e != "I"
            n = len(audit)
            columns = [[conv] * (n + 1), [None, *range(n)], [None, *places], [None, *audit], [None, *roles], *([x] + [None] * n for x in whole)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        held: list[pa.RecordBatch] = []
        size, now, codes, low, high, turns = 0, (), bytearray(), None, None, 0
        for batch in batches:
            for conv, turn, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv,) != now:
                    if now:
                        held.append(close(now[0], codes, low, high, turns))
                        size += len(codes)
                    now, codes, low, high, turns = (conv,), bytearray(), None, None, 0
                    if size > 50_000:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, size = [], 0
                codes.append(code)
                if turn is not None:
                    turns += turn != high
                    low, high = turn if low is None else low, turn
        if now:
            held.append(close(now[0], codes, low, high, turns))
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    small_batches(rows.sparkSession)
    ordered = rows.select("conv_id", "turn", "code", "place").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "turn", "code").mapInArrow(run, _EDITS)


def repaired(rows: DataFrame, done: DataFrame) -> DataFrame:
    """conv_id, step, role, text of the repaired conversations, from placed() and edits(); steps rise with the rows."""
    own = rows.select(F.col("conv_id").alias("_conv"), F.col("place").alias("_place"), F.col("role").alias("_role"), "text")
    kept = done.where("step is not null and edit <> 'D'").select("conv_id", "step", "place", "role")
    both = kept.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place")), "left")
    return both.select("conv_id", "step", F.coalesce("role", "_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 (lowercase hex) of each conversation's lines role:text, from repaired(): a stream over sorted rows, so a conversation may be of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda out: pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["conv_id", "sha256"])
        now, state = (), None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv,) != now:
                    if now:
                        out.append((now[0], state.hexdigest()))
                    now, state = (conv,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield give(out)
        if now:
            yield give([(now[0], state.hexdigest())])

    small_batches(rows.sparkSession)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "step")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, step, role, text of all conversations, repaired (see report() for odd rows)."""
    own = materialize(placed(rows), "placed")
    return repaired(own, materialize(edits(own), "edits"))


def report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows (conv_id, turn, role, text).

    ids: a table with all conv_ids that the result should have; one without rows has zeros, an empty audit and the digest of nothing.
    Null roles and texts are one space; rows with a null conv_id are one conversation; null turns come first; rows of one turn go by role and
    text; repeated rows are duplicates. Texts may be very long, and conversations, too: a task holds some ten bytes for each row of one.
    Other columns don't matter; an empty table gives a row for each of ids.
    """
    own = materialize(placed(rows), "placed")
    done = materialize(edits(own), "edits")
    hashes = digests(repaired(own, done))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = done.where("step is null").select("conv_id", *names)
    every = (rows if ids is None else ids).select(F.col("conv_id").cast("long").alias("_id")).distinct()
    same = lambda c: F.col("_id").eqNullSafe(F.col(c))
    out = every.join(whole, same("conv_id"), "left").drop("conv_id").join(hashes.select(F.col("conv_id").alias("_h"), "sha256"), same("_h"), "left")
    none = hashlib.sha256(b"").hexdigest()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names[:-1]]
    return out.select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(none)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with damage by a checksum of id and turn: a row is dropped, emptied, loses its end marks, comes twice, or gets the role user; others stay. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("kind")
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text")
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role, said, F.explode(times).alias("copy")).drop("copy")

