"""Repair of the turn structure of conversations by iterative-deepening A*.

A conversation is well formed if its roles are a system row at most, then pairs of user and
assistant, or if it has no rows. Rows with a fault or out of place are edited at a cost: ``D`` deletes
a row, ``I`` inserts an empty one, ``K`` keeps a row and ``R`` gives it another role. The search goes
depth first in the ASCII order of these letters, under a bound that starts at the cost the faults
alone force and rises to the least cost that went beyond it. What failed is remembered per state with
the cost that was left for it, so that a state is searched again only if more is left. The first
accepting path is the cheapest, and of those the first in ASCII order.

Which role an inserted or changed row gets follows from the state: nothing written yet, or written
last a system, a user or an assistant row. Rows are searched in stretches of at most STRETCH, once
for each pair of states at their ends; every stretch but the rows inserted at the very end closes with
a row of the input, so no path of a stretch is a prefix of another, and the cheapest paths of a
conversation are made of cheapest paths of its stretches. A task reads the rows in order and holds, for
each state, the letters so far and a running hash, not the rows of the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 8
#: States: nothing written, or the role that was written last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (EMPTY, ASSISTANT)
#: Kinds of row: its first fault.
SOUND, TRUNCATED, UNUSABLE = range(3)
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: Least cost that a kind of row adds whatever is done with it.
FORCED = (0, min(DELETE, CUT_OFF), DELETE)
WHITE = r"\x20\x09-\x0D"
OUT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def _next(state: int) -> int:
    """The state after writing the role that a made-up row gets: assistant after user, else user."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The state after keeping a row of this role, if that is allowed."""
    if initial == "s" and state == EMPTY:
        return SYSTEM
    if initial == "u" and state != USER:
        return USER
    if initial == "a" and state == USER:
        return ASSISTANT
    return None


def search(rows: tuple[tuple[str, int], ...], start: int, goal: int | None) -> tuple[int, str] | None:
    """Cost and letters of the cheapest path over rows of (role initial, kind), ASCII-least of equal ones.

    With a ``goal`` the path ends with the last row, in that state; without, in an accepting state,
    and rows may be inserted after the last one. None if no path leads to the goal.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + FORCED[rows[i][1]]
    if goal is not None and not _reachable(rows, start, goal):
        return None
    failed: dict[tuple[int, int], int] = {}
    bound = rest[0]
    while True:
        beyond = None  # the least estimate over the bound
        letters: list[str] = []
        # open nodes on the way down: index, state, cost so far, the moves not yet tried
        stack = [(0, start, 0, _moves(rows, 0, start, goal))]
        while stack:
            i, state, cost, moves = stack[-1]
            if i == n and (state in ACCEPTING if goal is None else state == goal):
                return cost, "".join(letters)
            for letter, step, j, then in moves:
                left = bound - cost - step
                if left < rest[j]:
                    over = cost + step + rest[j]
                    beyond = over if beyond is None else min(beyond, over)
                elif failed.get((j, then), -1) < left:
                    letters.append(letter)
                    stack.append((j, then, cost + step, _moves(rows, j, then, goal)))
                    break
            else:
                stack.pop()
                if letters:
                    letters.pop()
                failed[i, state] = max(failed.get((i, state), -1), bound - cost)
        if beyond is None:
            return None
        bound = beyond
        failed.clear()


def _moves(rows: tuple, i: int, state: int, goal: int | None) -> Iterator[tuple[str, int, int, int]]:
    """Edits in ASCII order: letter, cost, next row, next state."""
    if i == len(rows):
        if goal is None:
            yield "I", INSERT, i, _next(state)
        return
    initial, kind = rows[i]
    yield "D", DELETE, i + 1, state
    yield "I", INSERT, i, _next(state)
    if kind != UNUSABLE:
        extra = CUT_OFF if kind == TRUNCATED else 0
        then = _kept(state, initial)
        if then is not None:
            yield "K", extra, i + 1, then
        yield "R", REROLE + extra, i + 1, _next(state)


def _reachable(rows: tuple, start: int, goal: int) -> bool:
    if not rows or goal == EMPTY:
        return goal == start
    if goal == SYSTEM:
        return start == SYSTEM or start == EMPTY and any(r[0] == "s" and r[1] != UNUSABLE for r in rows)
    # user and assistant rows: by inserting before the last row, which must then be consumed
    return True


@lru_cache(maxsize=20_000)
def ways(stretch: str, start: int) -> tuple[tuple[int, int, str], ...]:
    """(end state, cost, letters) for every state that a stretch can end in.

    The stretch is a role initial and a kind for each row: texts do not matter, so stretches repeat.
    """
    rows = tuple(zip(stretch[::2], map(int, stretch[1::2])))
    found = ((goal, search(rows, start, goal)) for goal in range(4))
    return tuple((goal, *way) for goal, way in found if way)


class Repair:
    """One conversation, row after row."""

    def __init__(self) -> None:
        self.turns: list | None = None
        self.distinct = self.illegal = 0
        self.counts = [0, 0, 0]
        self.before = ""
        self.pending: list[tuple] = []
        # state -> cost, letters, hash of the repaired rows, whether there are any
        self.held = {EMPTY: (0, "", hashlib.sha256(), False)}

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            if self.turns is None:
                self.turns, self.distinct = [turn, turn], 1
            elif turn != self.turns[1]:
                self.turns[1] = turn
                self.distinct += 1
        initial = role[:1]
        if self.pending or self.before:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial or "?"
        if fault:
            self.counts[("blank", "duplicate", "truncated").index(fault)] += 1
        kind = SOUND if not fault else TRUNCATED if fault == "truncated" else UNUSABLE
        self.pending.append((initial, kind, role, text))
        if len(self.pending) == STRETCH:
            self._advance()

    def _advance(self) -> None:
        stretch = "".join(f"{initial or '?'}{kind}" for initial, kind, _, _ in self.pending)
        best: dict[int, tuple] = {}
        for state, (cost, letters, _, _) in self.held.items():
            for goal, more, path in ways(stretch, state):
                way = (cost + more, letters + path, state, path)
                if goal not in best or way < best[goal]:
                    best[goal] = way
        held = {}
        for goal, (cost, letters, state, path) in best.items():
            _, _, before, some = self.held[state]
            digest = before.copy()
            some = self._write(digest, some, state, path)
            held[goal] = (cost, letters, digest, some)
        self.held, self.pending = held, []

    def _write(self, digest, some: bool, state: int, path: str) -> bool:
        rows = iter(self.pending)
        for letter in path:
            if letter == "I":
                role, text = ("", "user", "assistant")[_next(state) - 1], ""
                state = _next(state)
            else:
                initial, _, role, text = next(rows)
                if letter == "D":
                    continue
                if letter == "R":
                    role = ("", "user", "assistant")[_next(state) - 1]
                    state = _next(state)
                else:
                    state = _kept(state, initial)
            digest.update(f"\n{role}:{text}".encode() if some else f"{role}:{text}".encode())
            some = True
        return some

    def result(self) -> tuple:
        if self.pending:
            self._advance()
        ends = []
        for state, (cost, letters, digest, some) in self.held.items():
            more, path = search((), state, None)
            ends.append((cost + more, letters + path, state, path, digest, some))
        cost, letters, state, path, digest, some = min(ends, key=lambda e: e[:3])
        self._write(digest, some, state, path)
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return min(gaps, 2**63 - 1), *self.counts, self.illegal, cost, letters, digest.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the planted damage and ``copy`` (0, or 1 for a repeat).

    A checksum of ``conv_id:turn`` decides: the row goes, loses its text or its stops, is repeated, or
    becomes the user's. Nulls of role and text, and in the checksum, are one space. A dropped row stays
    with ``copy`` null, so that its conversation is not forgotten.
    """
    space = F.lit(" ")
    known = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    )
    ids = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).when(kind != 0, F.array(F.lit(0)))
    return known.withColumn("kind", F.crc32(F.concat(ids[0], F.lit(":"), ids[1])) % 20).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode_outer(copies).alias("copy"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``: blank, duplicate (role and text were there earlier), truncated, or null.

    Earlier is by turn, nulls first, then role, text and copy. Equal rows of one conversation meet in a
    task by a digest of role and text, so a long conversation is spread, and are only numbered there.
    """
    same = Window.partitionBy("conv_id", "role", "_digest", F.col("copy").isNull())
    order = same.orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault = (
        F.when(~F.col("text").rlike(f"[^{WHITE}]"), "blank")
        .when(F.row_number().over(order) > 1, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{WHITE}]*\z"), "truncated")
    )
    keyed = rows.withColumn("_digest", F.unhex(F.sha2("text", 256)))
    return keyed.withColumn("fault", fault).drop("_digest")


def repair(
    rows: DataFrame, conversation: str, turn: str, role: str, text: str, copy: str | None = None
) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and a digest of the repaired rows.

    ``copy`` names a column that orders equal rows; a row in which it is null only names its conversation. A null
    conversation is one of its own, null turns come first, rows of one turn go by role, text and copy. A
    conversation without rows has zeros, no edits and the hash of nothing; a table without rows none.
    A role that is neither system, user nor assistant by its initial can only be changed or deleted.
    """
    number: Column = F.col(copy) if copy else F.lit(0)
    known = rows.select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        number.cast("int").alias("copy"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    dealt = faults(known).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(_runner(), OUT)


def _runner() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        done: list[tuple] = []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "text", "copy", "fault")]
            for conv, turn, role, text, copy, fault in zip(*columns, strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, *state.result()))
                    current, state = conv, Repair()
                if copy is not None:
                    state.add(turn, role, text, fault)
            yield _batch(done)
            done = []
        if state is not None:
            yield _batch([(current, *state.result())])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [field.split()[0] for field in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
