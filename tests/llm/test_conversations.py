"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.llm import conversations as cv

SHAPE = re.compile(r"(s?(ua)+)?\Z")
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))


def brute(rows):
    """Cheapest edits by uniform-cost search over (row, automaton state); of equal costs the least audit comes first."""
    rows = damage(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for role, c in (("user", "u"), ("assistant", "a")):
            if (state, c) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, c, (*out, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            more = faults[i] == 3
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in (1, 2):
                if role[:1] and (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for to, c in (("user", "u"), ("assistant", "a")):
                    if (state, c) in NEXT:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, c, (*out, f"{to}:{text}")))
    assert SHAPE.match("".join(x[0] for x in out))
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def some_rows(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "And then", "  ", "", "Well?\n", "Why", None, "É.", "A b c."]
    out = []
    for conv in [*range(n), None]:
        turn = 0
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            out.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts) if rng.random() < 0.5 else f"Word {rng.random()}."))
            turn += rng.choice([0, 1, 1, 1, 1, 3])
    return out


SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def held(spark, rows):
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r)
    want = {k: brute(v) for k, v in want.items()}
    got = cv.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[c] for c in NAMES) for r in got} == want


def test_repair_against_search(spark):
    held(spark, some_rows(400, 1))


@pytest.mark.parametrize(("block", "wide"), [(2, 2), (3, 2)])
def test_long_conversations_in_many_blocks(spark, monkeypatch, block, wide):
    monkeypatch.setattr(cv, "BLOCK", block)
    monkeypatch.setattr(cv, "WIDE", wide)
    rng = random.Random(5)
    long = [(10_000 + k, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No", f"{i}."])) for k in range(2) for i in range(300)]
    held(spark, some_rows(40, 2) + long)


def test_every_split_gives_the_same_cell():
    rng = random.Random(3)
    for _ in range(60):
        leaves = [cv.row_cell(rng.choice(["u", "a", "s", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(7)]
        table = {(i, i + 1): list(leaves[i]) for i in range(7)}
        for size in range(2, 8):
            for i in range(8 - size):
                cells = [cv.joined(table[i, k], table[k, i + size]) for k in range(i + 1, i + size)]
                assert all(c == cells[0] for c in cells)
                table[i, i + size] = cells[0]
        assert cv.parsed(leaves) == table[0, 7]


def test_empty_table_and_clashing_columns(spark):
    assert cv.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = some_rows(20, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.withColumns({c: F.lit("x") for c in ("kind", "copy", "digest", "audit", "cost", "part", "again")})
    assert sorted(map(str, cv.repair(more).collect())) == sorted(map(str, cv.repair(df).collect()))
