"""Repair the structure of conversations by their cheapest edits.

A whole conversation is at most one system turn, then pairs of a user's and an
assistant's turn. Rows are kept, given another role, deleted, or turns are
inserted; a dynamic program over the states of that pattern finds the cheapest
edits, among equals those whose initials come first in ASCII order.

The rows are secondary-sorted: partitioned by conversation and sorted by turn.
Every task streams through its rows with the program's state for the one
conversation that it is in, from Arrow batch to batch. The way back is one byte
for each state and row; a conversation of more than ``BLOCK`` rows gives its
decisions away block by block, for each state that a block may end in, and the
blocks are chained afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.sources import scratch_path

#: Costs of the edits; an undeleted truncated row adds the cost of a turn that is missing.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a conversation whose way back is held at a time.
BLOCK = 1 << 16

_BLANKS = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60
# States: 0 nothing yet, 1 after the system's turn, 2 after a user's, 3 after an assistant's.
_STATES = range(4)
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_NEXT_ROLE = ("user", "user", "assistant", "user")
_ENDS = (0, 3)


def _next(state: int) -> int:
    return 3 if state == 2 else 2


@cache
def _stepped(costs: tuple, ranks: tuple, initial: str, fault: str) -> tuple:
    """One row further: least added cost, costs above it, ranks, and the way back.

    ``costs`` and ``ranks`` are of the audits that end in each state with their
    last row's edit. Such audits are never each other's beginnings, so their
    order by ``ranks`` and then by what is appended is that of the whole
    texts. The way back is (state before, inserted turns, edit). Costs of
    states differ by a few insertions at most, so there are few distinct calls.
    """
    found: dict[int, tuple] = {}

    def offer(state: int, cost: int, before: int, inserted: int, edit: str) -> None:
        new = (cost, ranks[before], "I" * inserted + edit, (before, inserted, edit))
        if state not in found or new < found[state]:
            found[state] = new

    for before in _STATES:
        if costs[before] >= _NEVER:
            continue
        state, cost = before, costs[before]
        for inserted in range(3):
            offer(state, cost + DELETE, before, inserted, "D")
            if fault in ("", "truncated"):
                late = TRUNCATED if fault else 0
                offer(_next(state), cost + REROLE + late, before, inserted, "R")
                if (state, initial) in _AFTER:
                    offer(_AFTER[state, initial], cost + late, before, inserted, "K")
            state, cost = _next(state), cost + INSERT
    least = min(f[0] for f in found.values())
    order = sorted(set(f[1:3] for f in found.values()))
    new_costs = tuple(found[q][0] - least if q in found else _NEVER for q in _STATES)
    new_ranks = tuple(order.index(found[q][1:3]) if q in found else 0 for q in _STATES)
    back = bytes(
        (lambda b: b[0] | b[1] << 2 | "DRK".index(b[2]) << 4)(found[q][3]) if q in found else 255 for q in _STATES
    )
    return least, new_costs, new_ranks, back


_FRESH = ((0, _NEVER, _NEVER, _NEVER), (0, 0, 0, 0))


def _finish(costs: tuple, ranks: tuple) -> tuple[int, int, int]:
    """Added cost, state of the last row's edit and turns inserted after it, for the best whole audit."""
    best = []
    for before in _STATES:
        state, cost = before, costs[before]
        for inserted in range(3):
            if state in _ENDS and cost < _NEVER:
                best.append((cost, ranks[before], "I" * inserted, before))
            state, cost = _next(state), cost + INSERT
    cost, _, inserted, before = min(best)
    return cost, before, len(inserted)


def _walked_back(way: bytearray, end: int) -> tuple[int, str]:
    """The state before a block's first row, and the edits of its rows, where it ends in state ``end``."""
    edits, state = [], end
    for at in range(len(way) - 4, -1, -4):
        code = way[at + state]
        edits.append("I" * (code >> 2 & 3) + "DRK"[code >> 4])
        state = code & 3
    return state, "".join(reversed(edits))


class _Conversation:
    """What is known of the conversation that the stream is in."""

    def __init__(self, key: str) -> None:
        self.key = key
        self.costs, self.ranks = _FRESH
        self.cost = self.block = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.way = bytearray()
        self.low = self.high = self.last_turn = self.first = self.previous = self.initial = None
        self.turns = 0

    def see(self, turn: int | None, role: str, digest: bytes, blank: bool, ended: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
            self.turns += 1
        own = (turn, role, digest)
        repeated = own != self.first or own == self.previous
        self.previous = own
        fault = "blank" if blank else "duplicate" if repeated else "" if ended else "truncated"
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        added, self.costs, self.ranks, back = _stepped(self.costs, self.ranks, role[:1] if role[:1] in "sua" else "", fault)
        self.cost += added
        self.way += back

    def full(self) -> bool:
        return len(self.way) >= 4 * BLOCK

    def given_away(self) -> tuple:
        """A row with the block's edits for each state it may end in; nothing else is known yet."""
        ends = [_walked_back(self.way, q) if self.costs[q] < _NEVER else (-1, "") for q in _STATES]
        row = (self.key, self.block, [e[0] for e in ends], [e[1] for e in ends], *[0] * 7, "")
        self.block += 1
        self.way = bytearray()
        return row

    def closed(self) -> tuple:
        added, end, inserted = _finish(self.costs, self.ranks)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        before, edits = _walked_back(self.way, end)
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + added)
        return self.key, self.block, [before] * 4, [edits] * 4, *counts, end, "I" * inserted


_PLAN = (
    "key string, block int, before array<int>, edits array<string>, gaps long, blank long, duplicate long, "
    "truncated long, illegal long, cost long, last int, added string"
)
_PLAN_NAMES = [c.split()[0] for c in _PLAN.split(", ")]


def _planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of decisions; a conversation's last one carries its counts."""
    now: _Conversation | None = None
    for batch in batches:
        out = []
        columns = (batch[c].tolist() for c in ("key", "has_turn", "turn", "role", "digest", "row", "blank", "ended"))
        for key, has_turn, turn, role, digest, row, blank, ended in zip(*columns):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.closed())
                now = _Conversation(key)
            at = int(turn) if has_turn else None
            if not row:
                now.first, now.previous = (at, role, digest), None
                continue
            if now.full():
                out.append(now.given_away())
            now.see(at, role, digest, blank, ended)
        yield pd.DataFrame(out, columns=_PLAN_NAMES)
    if now is not None:
        yield pd.DataFrame([now.closed()], columns=_PLAN_NAMES)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _key() -> Column:
    """The conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")


def _slim(rows: DataFrame) -> DataFrame:
    """Keys of the rows with nulls replaced by one space, and what the program must know of the text."""
    text = F.coalesce("text", F.lit(" "))
    body = F.rtrim(text, F.lit(_BLANKS))
    return rows.select(
        _key(),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.lit(True).alias("row"),
        (body == "").alias("blank"),
        F.right(body, F.lit(1)).isin(".", "!", "?").alias("ended"),
        text.alias("text"),
    )


_ORDER = ("key", "has_turn", "turn", "role", "digest", "row")


def repair_plan(rows: DataFrame) -> DataFrame:
    """``key, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation.

    ``rows`` has conv_id, turn, role and text; other columns are ignored. Rows
    go by turn, null turns first, rows of one turn by role and digest. ``key``
    is the id as text after a sign, or empty for null ids, which are one conversation. A null role or text is
    one space. Rows said before (role and text, in any earlier row) are found
    by an aggregate that combines before its shuffle: it names the turn where
    each was said first, as a mark in the stream before that row. Texts are
    not shuffled, only their digests. A role with no letter s, u or a in front
    cannot be kept.
    """
    slim = _slim(rows).drop("text")
    said = slim.groupBy("key", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("first"))
    marks = said.select(
        "key", "first.has_turn", "first.turn", "role", "digest",
        F.lit(False).alias("row"), F.lit(False).alias("blank"), F.lit(False).alias("ended"),
    )
    stream = slim.unionByName(marks).repartition("key").sortWithinPartitions(*_ORDER)
    blocks = stream.mapInPandas(_planned, _PLAN)
    own = F.struct("block", "before", "edits")
    whole = blocks.groupBy("key").agg(
        *[F.max(c).alias(c) for c in _COUNTS],
        F.max("last").alias("last"),
        F.max("added").alias("added"),
        F.reverse(F.array_sort(F.collect_list(own))).alias("blocks"),
    )
    chained = F.expr(
        "aggregate(blocks, struct(last as state, array(added) as parts), "
        "(a, b) -> struct(b.before[a.state] as state, array_append(a.parts, b.edits[a.state]) as parts), "
        "a -> array_join(reverse(a.parts), ''))"
    )
    return whole.select("key", *_COUNTS, chained.alias("audit"))


_REPAIRED = "key string, place long, edit string, role string, text string"
_REPAIRED_NAMES = [c.split()[0] for c in _REPAIRED.split(", ")]


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole conversations from rows that follow their audit."""
    audit, at, place, state, key = "", 0, 0, 0, None
    for batch in batches:
        out = []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, state
            out.append((key, place, edit, role, text))
            place += 1
            state = _AFTER.get((state, role[:1]), state)

        for k, row, own, role, text in zip(*(batch[c].tolist() for c in ("key", "row", "audit", "role", "text"))):
            if not row:
                audit, at, place, state, key = own, 0, 0, 0, k
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(edit, role if edit == "K" else _NEXT_ROLE[state], text)
            while at < len(audit) and audit[at] == "I":
                put("I", _NEXT_ROLE[state], "")
                at += 1
        yield pd.DataFrame(out, columns=_REPAIRED_NAMES)


def repaired_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``key, place, edit, role, text``: the rows of the repaired conversations, in order in each partition.

    ``plan`` is ``repair_plan(rows)``. ``edit`` is K, R or I; ``place`` counts
    from 0. Rows of a conversation stay together in one partition.
    """
    heads = plan.select(
        "key", F.lit(False).alias("has_turn"), F.lit(-(2**63)).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit(b"").alias("digest"), F.lit(False).alias("row"), F.lit("").alias("text"), "audit",
    )
    own = _slim(rows).drop("blank", "ended").withColumn("audit", F.lit(""))
    stream = own.unionByName(heads).repartition("key").sortWithinPartitions(F.asc("key"), F.asc("row"), *_ORDER[1:5])
    return stream.select("key", "row", "audit", "role", "text").mapInPandas(_applied, _REPAIRED)


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, digest = None, None
    for batch in batches:
        out = []
        for k, place, role, text in zip(*(batch[c].tolist() for c in ("key", "place", "role", "text"))):
            if place == 0:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            line = f"{role}:{text}" if place == 0 else f"\n{role}:{text}"
            digest.update(line.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=["key", "sha256"])
    if digest is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """``key, sha256`` of the lines ``role:text`` of each conversation of ``repaired_rows``, joined by newlines."""
    return repaired.select("key", "place", "role", "text").mapInPandas(_digested, "key string, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults that a checksum of conversation and turn chooses.

    Nulls are one space first, in the checksum's text too. Of the remainders by
    20, 0 drops the row, 1 empties its text, 2 takes its sentence ends away, 3
    repeats it and 4 makes it the user's.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    text = known("text")
    times = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(known("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(True), times)).alias("_copy"),
    ).drop("_copy")


def repair_summary(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations`` on the repair of its ``rows``, which may be none."""
    spark = rows.sparkSession
    path = scratch_path(spark, "repair-plan")
    repair_plan(rows).write.parquet(path)
    plan = spark.read.parquet(path)
    every = conversations.select(_key(), "conv_id").groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    found = every.join(plan, "key", "left").join(digests(repaired_rows(rows, plan)), "key", "left")
    return found.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_summary(conversations, damaged(conversations))
