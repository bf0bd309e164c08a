"""Conversation structure repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tripweave.llm import repair

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
WHOLE = re.compile(r"(s?(ua)+)?\Z")


def rows_of(conversations):
    """Damaged rows of each conversation by turn, written from the contract."""
    out = {}
    for conv, turn, role, text in conversations:
        out.setdefault(conv, [])
        say = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def cheapest(rows, faults):
    """Dijkstra over (row, state) with the audit as second key: the least audit of the least cost."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, lines = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, "\n".join(lines)
        if (i, q) in done:
            continue
        done.add((i, q))
        for role in ("user", "assistant"):
            if (q, role[0]) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", i, step[q, role[0]], (*lines, f"{role}:")))
        if i == len(rows):
            continue
        (_, own, text), fault = rows[i], faults[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, lines))
        if fault in (None, "truncated"):
            late = 5 if fault else 0
            if (q, own[:1]) in step:
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, step[q, own[:1]], (*lines, f"{own}:{text}")))
            for role in ("user", "assistant"):
                if (q, role[0]) in step:
                    heapq.heappush(heap, (cost + 1 + late, audit + "R", i + 1, step[q, role[0]], (*lines, f"{role}:{text}")))


def brute(conversations):
    out = {}
    for conv, rows in rows_of(conversations).items():
        faults, seen = [], set()
        for _, role, text in rows:
            body = text.strip(BLANKS)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, text = cheapest(rows, faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def found(df):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert df.columns == names
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def summary(spark, conversations):
    df = spark.createDataFrame(
        [(*c, "x", "y") for c in conversations], "conv_id long, turn long, role string, text string, key string, audit string"
    )
    return found(repair.repair_summary(df, repair.damaged(df)))


def test_whole_table_against_search(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = brute([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert found(repair.op13(spark, SF)) == want


def odd(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "unknown"]
    texts = ["Yes.", "No", "ok!", "", " \n", None, "what?  ", "a\tb", "ünï。", "same.", "same."]
    out = []
    for c in conversations:
        for t in range(rng.randrange(longest)):
            turn = None if rng.random() < 0.1 else t // rng.choice([1, 1, 2]) + rng.choice([0, 0, 3])
            out.append((c, turn, rng.choice(roles), rng.choice(texts)))
    return out


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_odd_rows_ties_nulls_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = odd(block, [None, *range(120)], 14)
    rows += [(500, 2**63 - 1, "user", "far."), (500, -(2**63), "user", "apart."), (501, None, None, None)]
    rows += [(502, 7, "user", "again.")] * 9  # repeated rows
    rows += [(503, t, r, "x " * 50_000 + ".") for t, r in enumerate(["user", "assistant"] * 3)]
    got, want = summary(spark, rows), brute(rows)
    far = want.pop(500)
    assert got.pop(500)[1:] == far[1:]
    assert got == want


def test_each_state_sequence_has_the_least_audit():
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randrange(9)
        rows = [(i, rng.choice(["user", "assistant", "system", "x"]), f"t{i}") for i in range(n)]
        faults = [rng.choice([None, None, "truncated", "blank"]) for _ in rows]
        one = repair._Conversation("=1")
        for (_, role, _), fault in zip(rows, faults):
            added, one.costs, one.ranks, back = repair._stepped(one.costs, one.ranks, role[0], fault or "")
            one.cost += added
            one.way += back
        key, block, before, edits, *counts, last, added = one.closed()
        cost, audit, _ = cheapest(rows, faults)
        assert (counts[-1], edits[0] + added) == (cost, audit)


def test_repaired_rows_are_whole_conversations(spark):
    df = spark.createDataFrame(
        [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi!"), (1, 2, "user", "Bye."), (2, 0, "user", " "), (3, 0, "system", "S.")],
        "conv_id long, turn long, role string, text string",
    )
    plan = repair.repair_plan(df)
    assert {r["key"]: r["audit"] for r in plan.collect()} == {"=1": "DKR", "=2": "D", "=3": "D"}
    rows = [(r.place, r.edit, r.role, r.text) for r in repair.repaired_rows(df, plan).collect()]
    assert rows == [(0, "K", "user", "Hi!"), (1, "R", "assistant", "Bye.")]


def test_empty_table(spark):
    assert summary(spark, []) == {}
