"""Repair of conversation structure by a run-length min-plus dynamic program.

A conversation should read `(s?(ua)+)?` by its roles' first letters. Keep costs 0, Rerole to user or assistant 1, Delete 2
(required for blank and repeated turns), Insert an empty user or assistant turn 5; a truncated turn that stays adds 5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.session import cut

BLANKS = " \t\n\x0b\x0c\r"
_INF = 1 << 60
# what has been written so far ends in: nothing, system, user, assistant
_NEXT = (2, 2, 3, 2)
_KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_AT_END = (0, 10, 5, 0)
_MADE = {2: "user", 3: "assistant"}


def _options(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of the edits that consume a turn, in ASCII order: `d` must go, a capital is truncated."""
    out = [("D", 2, state)]
    if symbol != "d":
        more = 5 if symbol.isupper() else 0
        to = _KEEPS.get(symbol.lower(), {}).get(state)
        out += [("K", more, to)] if to is not None else []
        out.append(("R", 1 + more, _NEXT[state]))
    return out


@lru_cache(maxsize=None)
def _power(symbol: str, k: int) -> tuple[tuple[int, ...], ...]:
    """The min-plus matrix of 2**k equal turns: least cost from a state before them to a state after them."""
    if k:
        half = _power(symbol, k - 1)
        return tuple(tuple(min(half[p][m] + half[m][q] for m in range(4)) for q in range(4)) for p in range(4))
    rows = []
    for p in range(4):
        row, at, cost = [_INF] * 4, p, 0
        for _ in range(3):  # more than two insertions in a row come back to the same state
            for _, c, q in _options(symbol, at):
                row[q] = min(row[q], cost + c)
            at, cost = _NEXT[at], cost + 5
        rows.append(tuple(row))
    return tuple(rows)


@lru_cache(maxsize=1 << 16)
def _before(symbol: str, n: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least cost to the end from each state before a run, given that after it."""
    k = 0
    while n:
        if n & 1:
            matrix = _power(symbol, k)
            after = tuple(min(m + v for m, v in zip(row, after, strict=True)) for row in matrix)
        n >>= 1
        k += 1
    return after


@lru_cache(maxsize=1 << 16)
def _unroll(symbol: str, n: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """(edits, state after) of a run: the ASCII-least of the cheapest. Long runs are unrolled in halves."""
    if n > 1:
        first, at = _unroll(symbol, n // 2, state, _level(_before(symbol, n - n // 2, after)))
        second, at = _unroll(symbol, n - n // 2, at, after)
        return first + second, at
    before, edits = _before(symbol, 1, after), ""
    while True:
        for edit, cost, to in _options(symbol, state):
            if edit != "D" and before[state] == 5 + before[_NEXT[state]]:
                break
            if before[state] == cost + after[to]:
                return edits + edit, to
        edits, state = edits + "I", _NEXT[state]


def _level(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs less the least of them; only differences matter to choices, and few distinct tuples make the caches hit."""
    least = min(costs)
    return tuple(min(c - least, _INF) for c in costs)


def cheapest_edits(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of runs of equal symbols: s, u, a or x (other), capital if truncated, d if the turn must go."""
    after, total, ahead = _AT_END, 0, []
    for symbol, n in reversed(runs):
        ahead.append(after)
        whole = _before(symbol, n, after)
        after = _level(whole)
        total += min(whole)
    cost, state, parts = total + after[0], 0, []
    for (symbol, n), rest in zip(runs, reversed(ahead), strict=True):
        edits, state = _unroll(symbol, n, state, rest)
        parts.append(edits)
    return cost, "".join(parts) + "I" * (_AT_END[state] // 5)


def conversation_key(key: str) -> Column:
    """The conversation id as a text that is never null, so that rows without an id are one conversation."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.lit(""))


def _said(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    said, named = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (text, role))
    return turns.select(
        conversation_key(key).alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), named.alias("role"), said.alias("text"),
        F.md5(said.cast("binary")).alias("text_md5"),
    )


_ORDER = ("turn", "role", "text_md5")
_SEGMENTS = ("conv string, part int, runs string, lengths array<bigint>, first string, last string, low bigint, high bigint, "
             "turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint")
_PLANS = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_LEGAL = {"su", "ua", "au"}


class _Segment:
    """What one task has seen of one conversation, in order."""

    def __init__(self, part: int):
        self.part, self.runs, self.lengths = part, [], []
        self.first = self.last = None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, is_blank: bool, is_cut: bool, is_first: bool, n: int) -> None:
        letter = role[:1]
        if self.last is not None:
            self.illegal += self.last + letter not in _LEGAL
        self.illegal += (n - 1) * (letter * 2 not in _LEGAL)
        self.first, self.last = letter if self.first is None else self.first, letter
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        again = n if is_blank else n - is_first
        self.blank += n if is_blank else 0
        self.duplicate += 0 if is_blank else again
        if again < n:
            self.truncated += is_cut
            kind = letter if letter in ("s", "u", "a") else "x"
            self._run(kind.upper() if is_cut else kind, 1)
        self._run("d", again)

    def _run(self, symbol: str, n: int) -> None:
        if n and self.runs and self.runs[-1] == symbol:
            self.lengths[-1] += n
        elif n:
            self.runs.append(symbol)
            self.lengths.append(n)

    def row(self, key: str) -> tuple:
        return (key, self.part, "".join(self.runs), self.lengths, self.first, self.last, self.low, self.high,
                self.turns, self.blank, self.duplicate, self.truncated, self.illegal)


def _batches(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _in_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, key, segment, out = TaskContext.get().partitionId(), None, None, []
    for batch in batches:
        for conv, *facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment is None or conv != key:
                if segment:
                    out.append(segment.row(key))
                key, segment = conv, _Segment(part)
            segment.add(*facts)
        if len(out) > 1000:
            yield _batches(out, _SEGMENTS)
            out = []
    if segment:
        out.append(segment.row(key))
    yield _batches(out, _SEGMENTS)


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def close(parts: list[dict]) -> tuple:
        runs: list[tuple[str, int]] = []
        illegal, turns, low, high, last = 0, 0, None, None, None
        for p in parts:
            runs += zip(p["runs"], p["lengths"], strict=True)
            illegal += p["illegal"] + (last is not None and last + p["first"] not in _LEGAL)
            last = p["last"]
            turns += p["turns"] - (p["low"] is not None and p["low"] == high)
            low, high = p["low"] if low is None else low, high if p["high"] is None else p["high"]
        merged: list[tuple[str, int]] = []
        for symbol, n in runs:
            if merged and merged[-1][0] == symbol:
                merged[-1] = symbol, merged[-1][1] + n
            else:
                merged.append((symbol, n))
        blank, duplicate, truncated = (sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated"))
        return (parts[0]["conv"], 0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, *cheapest_edits(merged))

    parts: list[dict] = []
    out: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            if parts and parts[0]["conv"] != row["conv"]:
                out.append(close(parts))
                parts = []
            parts.append(row)
        if len(out) > 1000:
            yield _batches(out, _PLANS)
            out = []
    if parts:
        out.append(close(parts))
    yield _batches(out, _PLANS)


def plan_repairs(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows.

    `conv` is `conversation_key`. Rows come by turn (nulls first), then role, then md5 of the text; a null role or text is
    one space. The first fault of a row counts: blank, duplicate (role and text seen earlier), truncated. `audit` holds
    the initials of the cheapest edits, the ASCII-least where several are. An empty table gives an empty one; other
    columns are not read; repeated rows are turns of their own.

    No text is shuffled. Equal rows meet as one row with a count, and rows are dealt out by ranges of their order, so a
    conversation with a third of all rows is spread over tasks; each task sends runs of equal symbols. What meets in one
    task are the runs of one conversation, never longer than its audit.
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    said = _said(turns, key, turn, role, text).select("conv", *_ORDER, (bare == "").alias("is_blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("is_cut"))
    rows = said.groupBy("conv", *_ORDER).agg(F.max("is_blank").alias("is_blank"), F.max("is_cut").alias("is_cut"), F.count("*").alias("n"))
    seen = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    earliest = rows.groupBy("conv", "role", "text_md5").agg(F.min(seen).alias("earliest"))
    marked = rows.join(earliest, ["conv", "role", "text_md5"]).withColumn("is_first", seen == F.col("earliest"))
    ordered = marked.repartitionByRange("conv", *_ORDER).sortWithinPartitions("conv", *_ORDER)
    segments = ordered.select("conv", "turn", "role", "is_blank", "is_cut", "is_first", "n").mapInArrow(_in_segments, _SEGMENTS)
    return segments.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_planned, _PLANS)


_REPAIRED = "conv string, position bigint, edit string, role string, text string"


class _Repair:
    """One conversation's edits, taken one by one as its rows pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.position = audit, 0, 0, 0

    def _turn(self, edit: str, role: str, text: str) -> tuple:
        self.position += 1
        return self.position - 1, edit, role, text

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield self._turn("I", _MADE[self.state], "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEEPS[role[:1]][self.state]
            yield self._turn(edit, role, text)
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield self._turn(edit, _MADE[self.state], text)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, repair = None, None

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return _batches(rows, _REPAIRED)

    for batch in batches:
        out: list[tuple] = []
        for conv, role, text, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is not None:
                out += ((key, *t) for t in (repair.inserts() if repair else ()))
                key, repair = conv, _Repair(audit)
            else:
                out += ((conv, *t) for t in repair.row(role, text))
        yield flush(out)
    yield flush([(key, *t) for t in (repair.inserts() if repair else ())])


def apply_repairs(turns: DataFrame, plans: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, edit, role, text): the turns that stay, are given a role or are inserted, in order within partitions.

    `plans` are those of the same rows. Every conversation lies in one partition, its rows pass one by one behind its
    audit, so memory does not grow with its texts. A conversation all of whose turns go has no rows.
    """
    rows = _said(turns, key, turn, role, text).select("conv", *_ORDER, "text", F.lit(None).cast("string").alias("audit"))
    heads = plans.select("conv", F.lit(None).cast("bigint").alias("turn"), *(F.lit("").alias(c) for c in ("role", "text_md5", "text")), "audit")
    both = heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), *_ORDER)
    return both.select("conv", "role", "text", "audit").mapInArrow(_applied, _REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of `apply_repairs` rows: of `role:text`, newline-joined; streams over its order, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, schema = None, None, "conv string, repaired_sha256 string"
        for batch in batches:
            done: list[tuple] = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != key:
                    done += [(key, state.hexdigest())] if state else []
                    key, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield _batches(done, schema)
        yield _batches([(key, state.hexdigest())] if state else [], schema)

    return repaired.select("conv", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


def repair_report(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The plan of every conversation with the hash of its repaired text; that of an empty text where nothing stays."""
    plans = cut(plan_repairs(turns, key, turn, role, text))
    done = plans.join(digests(apply_repairs(turns, plans, key, turn, role, text)), "conv", "left")
    return done.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
