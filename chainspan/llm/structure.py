"""Repair of damaged conversations: the cheapest edits that make each one an optional system turn and then pairs of a user
and an assistant turn, or nothing.

Keeping a turn costs 0, giving it the role user or assistant 1, deleting it 2, inserting an empty turn 5; a truncated
turn that stays costs 5 more, and blank turns and repeated ones must go. The grammar has four states (nothing yet, after
the system turn, after a user turn, after an assistant turn), so what a conversation's end costs is a vector of four
numbers. The vectors are computed backward, and kept only at every k-th turn, k the square root of the number of turns;
walking forward, the vectors of one block at a time are computed again from its checkpoint, and each step takes the
ASCII-least edit that is tight: whose cost and the cost of the rest add up to the vector's. One letter leads to one
state, so these letters are the ASCII-least of all cheapest edits.

Two passes follow each other. The first needs a byte for each turn (its role's initial and its fault), dealt out by
conversation, and gives each conversation its edits. The second deals out the texts once, and streams every
conversation's turns, with its edits in front of them, into the hash of the repaired text. Neither holds the texts of a
conversation: the first pass holds a byte for each of its turns, the second a letter for each edit.

Results in edge cases: null roles and texts count as one space. Null conversation ids are one conversation. Turns of the
same number are taken in the order of role and text. A role whose initial is not s, u or a cannot be kept. A conversation
without turns needs no edits. An empty table gives an empty one. Other columns are left aside.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainspan.llm.common import with_python

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or renamed turn: user follows nothing, system and assistant; assistant follows user.
_NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a kept turn, by its initial and the state before; -1: not allowed.
_KEPT = {0: (SYSTEM, -1, -1, -1), 1: (USER, USER, -1, USER), 2: (-1, -1, ASSISTANT, -1), 3: (-1, -1, -1, -1)}
FINE, CUT, GONE = 0, 1, 2  # what a turn's fault asks for: nothing, a surcharge, deletion
_WHITE = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60

Vector = tuple[int, int, int, int]
#: Costs of the end of a conversation.
_END: Vector = (0, 2 * INSERT, INSERT, 0)


def _steps(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """The edits that consume a turn: letter, cost, state after."""
    initial, fault = divmod(code, 3)
    yield "D", DELETE, state
    if fault != GONE:
        extra = TRUNCATED if fault == CUT else 0
        if (kept := _KEPT[initial][state]) >= 0:
            yield "K", extra, kept
        yield "R", REROLE + extra, _NEXT[state]


@cache
def before(code: int, after: Vector) -> tuple[Vector, int]:
    """Costs before a turn from those after it: less their least, and that least. The vectors that arise are few."""
    v = [min(cost + after[to] for _, cost, to in _steps(code, s)) for s in range(4)]
    for _ in range(3):
        v = [min(v[s], INSERT + v[_NEXT[s]]) for s in range(4)]
    least = min(v)
    return tuple(x - least for x in v), least


@cache
def step(code: int, after: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least tight edits from a state up to and with those of one turn, and the state they lead to."""
    here, least = before(code, after)
    letters = ""
    while True:
        cost = here[state] + least
        tight = [(letter, to) for letter, c, to in _steps(code, state) if c + after[to] == cost]
        if here[_NEXT[state]] + INSERT == here[state]:
            tight.append(("I", -1))
        letter, to = min(tight)
        letters += letter
        if to >= 0:
            return letters, to
        state = _NEXT[state]


def cheapest(codes: bytes) -> tuple[int, str]:
    """The least cost of turns given as initial * 3 + fault, and the ASCII-least edits of that cost."""
    n = len(codes)
    k = max(1, math.isqrt(n))
    marks: dict[int, Vector] = {n: _END}
    v, total = _END, 0
    for i in range(n - 1, -1, -1):
        v, least = before(codes[i], v)
        total += least
        if i % k == 0:
            marks[i] = v
    cost, state, letters = total + v[NOTHING], NOTHING, []
    for lo in range(0, n, k):
        hi = min(lo + k, n)
        block = [marks[hi]]
        for i in range(hi - 1, lo, -1):
            block.append(before(codes[i], block[-1])[0])
        for i in range(lo, hi):
            more, state = step(codes[i], block[hi - 1 - i], state)
            letters.append(more)
    while state in (SYSTEM, USER):
        letters.append("I")
        state = _NEXT[state]
    return cost, "".join(letters)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by the checksum of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops the turn, 1
    empties its text, 2 removes its stops, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(F.col("text"), space)
    return turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _place(text: Column) -> Column:
    """What orders turns of the same number and role: the text, by its hash, so that the first pass moves no texts."""
    return F.sha2(text, 256)


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_AUDIT_COLUMNS = [c.split(" ")[0] for c in _AUDIT.split(", ")]
_LEGAL = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)


def _runs(ids: pa.Array) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of equal ids."""
    v, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((v[1:] != v[:-1]) | (null[1:] != null[:-1])) + 1
    edges = [0, *cuts.tolist(), len(v)]
    return list(zip(edges, edges[1:], strict=False))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a stream of (conv_id, turn, kind, initial, fault) in order."""
    current, known, codes, faults, illegal, last, turns, low, high = None, False, bytearray(), [0, 0, 0], 0, -1, 0, None, None
    out: list[tuple] = []

    def close() -> None:
        cost, audit = cheapest(bytes(codes))
        gaps = 0 if low is None else high - low + 1 - turns
        out.append((current, gaps, *faults, illegal, cost, audit))

    def batch() -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string()]
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _AUDIT_COLUMNS)
        out.clear()
        return b

    for b in batches:
        if not b.num_rows:
            continue
        conv, turn = b.column("conv_id"), b.column("turn")
        kind = b.column("kind").to_numpy(zero_copy_only=False)
        initial = b.column("initial").to_numpy(zero_copy_only=False)
        fault = b.column("fault").to_numpy(zero_copy_only=False)
        for lo, hi in _runs(conv):
            ident = conv[lo].as_py()
            if not known or ident != current:
                if known:
                    close()
                current, known, codes, faults, illegal, last, turns, low, high = ident, True, bytearray(), [0, 0, 0], 0, -1, 0, None, None
            own = lo + int(np.count_nonzero(kind[lo:hi] == 0))
            if own == hi:
                continue
            who, what = initial[own:hi], fault[own:hi]
            codes += (who * 3 + np.minimum(np.where(what == 0, 0, np.where(what == 3, CUT, GONE)), GONE)).astype(np.uint8).tobytes()
            faults = [n + int(np.count_nonzero(what == f)) for n, f in zip(faults, (1, 2, 3), strict=True)]
            pairs = who if last < 0 else np.concatenate([[last], who])
            illegal += int(np.count_nonzero(~_LEGAL[pairs[:-1], pairs[1:]]))
            last = int(who[-1])
            numbered = turn[own:hi] if turn.null_count == 0 else turn[own:hi].drop_null()
            if len(numbered):
                t = numbered.to_numpy(zero_copy_only=False)
                turns += int(np.count_nonzero(t[1:] != t[:-1])) + (high is None or int(t[0]) != high)
                low = int(t[0]) if low is None else low
                high = int(t[-1])
        if len(out) >= 4_096:
            yield batch()
    if known:
        close()
    if out:
        yield batch()


def _dealt(df: DataFrame, *order: Column) -> DataFrame:
    return with_python(df).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def audits(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Faults, cost and edits of every id in ``conversations``: the first pass."""
    rest = F.rtrim("text", F.lit(_WHITE))
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = turns.select(
        "conv_id", "turn", "role", _place(F.col("text")).alias("place"), same.alias("same"),
        (rest == "").alias("blank"), F.right(rest, F.lit(1)).isin(".", "!", "?").alias("whole"),
    )
    again = F.row_number().over(W.partitionBy("conv_id", "same").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), 1).when(again, 2).when(~F.col("whole"), 3).otherwise(0)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    coded = rows.select("conv_id", "turn", F.lit(1).alias("kind"), "role", "place", initial.alias("initial"), fault.alias("fault"))
    nothing = F.lit(None)
    heads = conversations.select("conv_id", nothing.cast("long").alias("turn"), F.lit(0).alias("kind"), nothing.cast("string").alias("role"),
                                 nothing.cast("string").alias("place"), F.lit(0).alias("initial"), F.lit(0).alias("fault"))
    # Of equal turns the first is not the repeated one.
    order = ("kind", F.col("turn").asc_nulls_first(), "role", "place", F.col("fault") == 2)
    return _dealt(heads.unionByName(coded), *order).select("conv_id", "turn", "kind", "initial", "fault").mapInArrow(_audits, _AUDIT)


class _Repair:
    """Applies a conversation's edits to its turns as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.empty, self.sha = audit, 0, NOTHING, True, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        line = f"{role}:{text}" if self.empty else f"\n{role}:{text}"
        self.sha.update(line.encode("utf-8", "surrogatepass"))
        self.empty = False

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._given("")
            self.at += 1

    def _given(self, text: str) -> None:
        self.state = _NEXT[self.state]
        self._write("user" if self.state == USER else "assistant", text)

    def turn(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _KEPT["sua".find(role[0])][self.state]
            self._write(role, text)
        elif letter == "R":
            self._given(text)

    def digest(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


_REPAIRED = _AUDIT + ", repaired_sha256 string"


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a stream of its audit and then its turns in order."""
    head: tuple | None = None
    repair: _Repair | None = None
    out: list[tuple] = []
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*_AUDIT_COLUMNS, "repaired_sha256"])
        out.clear()
        return b

    for b in batches:
        kinds, roles, texts = (b.column(c).to_pylist() for c in ("kind", "role", "text"))
        facts = [b.column(c) for c in _AUDIT_COLUMNS]
        for i, kind in enumerate(kinds):
            if kind == 0:
                if repair is not None:
                    out.append((*head, repair.digest()))
                head = tuple(c[i].as_py() for c in facts)
                repair = _Repair(head[-1])
            else:
                repair.turn(roles[i], texts[i])
        if len(out) >= 4_096:
            yield batch()
    if repair is not None:
        out.append((*head, repair.digest()))
    if out:
        yield batch()


def repaired(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``conversations`` names the ids to report on, all those of ``turns`` where it is not given.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    ids = (turns if conversations is None else conversations).select("conv_id").distinct()
    nothing = F.lit(None)
    heads = audits(clean, ids).select("*", F.lit(0).alias("kind"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"))
    rows = clean.select(*[nothing.cast("string" if c == "audit" else "long").alias(c) for c in _AUDIT_COLUMNS if c != "conv_id"], "conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    order = ("kind", F.col("turn").asc_nulls_first(), "role", _place(F.col("text")))
    stream = _dealt(heads.unionByName(rows), *order).select(*_AUDIT_COLUMNS, "kind", "role", "text")
    return stream.mapInArrow(_repairs, _REPAIRED)
