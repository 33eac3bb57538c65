"""Stratified, grouped and connected splits."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.operators import ranks, splits


def test_stratified_to_one_row(spark, monkeypatch):
    rows = [(i, "abc"[i % 7 % 3] if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y string")
    want = splits.stratified_split(df, "y", "id").collect()
    counts = Counter((r.y, r.split) for r in want)
    for y in ("a", "b", "c", None):
        n = sum(v for (k, _), v in counts.items() if k == y)
        assert all(abs(counts[y, s] - n * share) <= 1 for s, share in zip(splits.NAMES, (0.6, 0.2, 0.2), strict=True))
    assert len(want) == len(rows) and len({r.id for r in want}) == len(rows)
    monkeypatch.setattr(ranks, "PART", 20)
    again = splits.stratified_split(df.repartition(9), "y", "id").collect()
    assert {(r.id, r.split) for r in again} == {(r.id, r.split) for r in want}


def test_whole_groups(spark):
    rng = random.Random(2)
    rows = [(i, f"g{rng.randrange(120)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = splits.group_split(df, "g").collect()
    by = defaultdict(set)
    for r in got:
        by[r.g].add(r.split)
    assert len(got) == 3000 and all(len(s) == 1 for s in by.values())
    share = Counter(r.split for r in got)
    assert all(abs(share[s] / 3000 - p) < 0.02 for s, p in zip(splits.NAMES, (0.6, 0.2, 0.2), strict=True))
    with pytest.raises(ValueError, match="have no g"):
        splits.group_split(df.withColumn("g", F.when(F.col("id") > 5, F.col("g"))), "g")
    with pytest.raises(ValueError, match="different groups"):
        splits.group_split(df.withColumn("g", F.col("id") % 4), "g")


def test_connected_components(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, f"t{rng.randrange(400)}"]), rng.choice([None, f"t{rng.randrange(400)}"]), f"c{i // 3}" if i < 90 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, *v in rows:
        names = [f"{k}={x}" for k, x in zip("abc", v, strict=True) if x is not None]
        for n in names[1:]:
            p, q = sorted((root(names[0]), root(n)))
            parent[q] = p
    want = {i: root(names[0]) if (names := [f"{k}={x}" for k, x in zip("abc", v, strict=True) if x is not None]) else None for i, *v in rows}
    assert {r.row: r.component for r in splits.connected(df, "id", ["a", "b", "c"]).collect()} == want
    got = splits.connected_split(df, "id", ["a", "b", "c"])
    joined = df.join(got, F.col("id") == F.col("row"))
    assert got.count() == 600 and splits.split_faults(joined, "id", ["a", "b", "c"]).where("fault not like 'no %'").isEmpty()
    alone = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id long, a string")
    assert {r.row: r.component for r in splits.connected(alone, "id", ["a"]).collect()} == {1: "a=x", 2: "a=x", 3: None}
    bad = spark.createDataFrame([(1, "x", "train"), (1, "x", "test"), (2, None, "test")], "id long, a string, split string")
    assert {r.fault for r in splits.split_faults(bad, "id", ["a"]).collect()} == {"duplicate id", "no a", "a in several splits"}
