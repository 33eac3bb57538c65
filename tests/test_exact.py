"""Exact sums against Python's decimals, for several partitionings."""

import random
from decimal import Context, Decimal

import pytest
from pyspark.sql import functions as F

from cairn.functions.exact import ExactFloats
from cairn.operators import analytics, explore
from cairn.operators.analytics import Join, Metric

WIDE = Context(prec=2000)


def total(values):
    out = Decimal(0)
    for v in values:
        out = WIDE.add(out, Decimal(repr(v)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    odd = [1e16, -1e16, 1e-3, 1e300, -1e300, 5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 123456789.123456789, 1e22, 0.1, 0.012345678901234567, 9999999999.999998, 1e10, -0.0, 0.0]
    out = [("odd", rng.choice(odd) if rng.random() < 0.5 else rng.gauss(0, 1) * 10 ** rng.randrange(-30, 30)) for _ in range(400)]
    out += [("price", round(rng.uniform(0, 1e5), 2)) for _ in range(600)] + [("tiny", rng.random() * 1e-5) for _ in range(200)]
    return out + [("none", None), ("odd", float("nan")), ("odd", float("inf")), ("price", None)]


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_and_averages(spark, rows, parts):
    df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
    got = {r.g: r for r in analytics.aggregate(df, ["g"], [Metric("sum", "x", "s"), Metric("average", "x", "a")], evidence=True).collect()}
    for g in ("odd", "price", "tiny"):
        values = [v for k, v in rows if k == g and v is not None and abs(v) < float("inf")]
        want = total(values)
        assert got[g].s == float(want) and got[g].s_valid == len(values)
        assert got[g].a == float(WIDE.divide(want, Decimal(len(values))))
    assert (got["none"].s, got["none"].a) == (0.0, None)


def test_plain_sums_need_no_python(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] == "price"], "g string, x double")
    exact = ExactFloats(df, ["x"])
    assert exact.classes == {"x": []}
    plan = df.agg(exact.total("x").alias("s"), exact.average("x").alias("a"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_other_numbers_and_joined_tables(spark):
    a = spark.createDataFrame([(1, 0.1, 3), (2, 0.2, None), (3, 1e16, 5)], "k long, x double, i int")
    b = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "k long, g string")
    r = analytics.analyze({"a": a, "b": b}, [Join("a", "k", "b", "k")], ["b.g"], [Metric("sum", "a.x", "x"), Metric("sum", "a.i", "i"), Metric("average", "a.i", "m")]).first()
    assert (r.x, r.i, r.m) == (float(Decimal("0.3") + Decimal(10**16)), 8, 4.0)
    d = a.select(F.col("x").cast("float").alias("f"), F.col("x").cast("decimal(20,1)").alias("d"))
    s = analytics.aggregate(d.where("d < 1"), [], [Metric("sum", "f", "f"), Metric("sum", "d", "d")]).first()
    assert s.f == float(total([0.10000000149011612, 0.20000000298023224])) and s.d == Decimal("0.3")


def test_mean_of_numeric_summary(spark):
    x = [1e16, 1e-3, -1e16, 0.7, 0.1]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert {explore.numeric_summary(df.repartition(n), "x").first()["mean"] for n in (1, 5)} == {float(total(x) / 5)}
