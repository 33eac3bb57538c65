"""Row sets within tolerances against a maximum matching; bundles for several partitionings."""

import json
import random
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairn.operators import bundles, rowsets
from cairn.sources.sealed import SealError


def most_pairs(expected, actual, tolerance):
    """Size of a maximum matching by augmenting paths."""
    near = [[j for j, y in enumerate(actual) if (x is None) == (y is None) and (x is None or abs(Decimal(str(x)) - Decimal(str(y))) <= tolerance)] for x in expected]
    owner = {}

    def place(i, seen):
        for j in near[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(expected)))


@pytest.mark.parametrize("tolerance", ["0", "0.1", "0.25"])
def test_as_many_matches_as_possible(spark, tolerance):
    rng = random.Random(4)
    some = lambda: [(rng.choice(["a", "b", None]), rng.choice([None, round(rng.uniform(0, 3), 1), round(rng.uniform(0, 300), 1)])) for _ in range(150)]
    expected, actual = some(), some()
    e, a = (spark.createDataFrame(r, "k string, v double").repartition(4) for r in (expected, actual))
    got = rowsets.match_rows(e, a, ["k"], "v", tolerance).collect()
    limit = Decimal(tolerance)
    for k in ("a", "b", None):
        x, y = [v for g, v in expected if g == k], [v for g, v in actual if g == k]
        mine = [r for r in got if r.k == k]
        count = lambda *s: sum(r.n for r in mine if r.status in s)  # noqa: B023, E731
        assert count("matched") == most_pairs(x, y, limit)
        assert (count("matched", "missing"), count("matched", "surplus")) == (len(x), len(y))
        assert Counter({v: n for v, n in Counter(x).items()}) == sum((Counter({r.expected: r.n}) for r in mine if r.status != "surplus"), Counter())
        assert all(r.expected is r.actual is None or abs(Decimal(str(r.expected)) - Decimal(str(r.actual))) <= limit for r in mine if r.status == "matched")


def test_edge_of_the_tolerance_and_report(spark):
    e = spark.createDataFrame([(1, Decimal("0.30")), (2, Decimal("1.00")), (3, None)], "k int, v decimal(10,2)")
    a = spark.createDataFrame([(1, Decimal("0.20")), (2, Decimal("1.11")), (3, None)], "k int, v decimal(10,2)")
    got = {r.k: r.status for r in rowsets.match_rows(e, a, ["k"], "v", "0.1").where("status <> 'surplus'").collect()}
    assert got == {1: "matched", 2: "missing", 3: "matched"}
    assert tuple(rowsets.match_report(rowsets.match_rows(e, a, ["k"], "v", "0.1")).first()) == (3, 3, 2, 1, 1, False)
    assert tuple(rowsets.match_report(rowsets.match_rows(e, a, [], "v", "0.11")).first()) == (3, 3, 3, 0, 0, True)
    assert tuple(rowsets.match_report(rowsets.match_rows(e.limit(0), a.limit(0), ["k"], "v")).first()) == (0, 0, 0, 0, 0, True)
    with pytest.raises(ValueError, match="negative"):
        rowsets.match_rows(e, a, ["k"], "v", -1)


def test_same_bundles_for_any_partitions(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 20).alias("g"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("É "), F.col("id"))).alias("text"), F.array("id").alias("a"))
    df = df.unionByName(df.where("g = 3"))
    one, two = str(tmp_path / "a"), str(tmp_path / "b")
    m = bundles.write_bundle(df.repartition(3), one, ["g"], 2000)
    assert bundles.write_bundle(df.repartition(7), two, ["g"], 2000) == m
    files = sorted(Path(one).glob("shard=*/*.txt"), key=lambda p: int(p.parent.name.split("=")[1]))
    lines = [json.loads(x) for p in files for x in p.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == m["records"] == 420 and [x["g"] for x in lines] == sorted(x["g"] for x in lines)
    assert all(list(x) == ["a", "g", "text"] for x in lines) and len(files) == len(m["shards"]) > 5
    assert all(s["n_bytes"] <= 2000 + 100 for s in m["shards"]) and bundles.bundle_faults(spark, one) == []
    for crc in Path(one).rglob(".*.crc"):
        crc.unlink()
    files[2].write_bytes(files[2].read_bytes().replace(b"text", b"tExt", 1))
    files[4].unlink()
    assert bundles.bundle_faults(spark, one) == [(2, "changed"), (4, "missing")]
    with pytest.raises(SealError):
        bundles.bundle_faults(spark, str(tmp_path / "none"))
