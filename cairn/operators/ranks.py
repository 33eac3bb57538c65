"""Exact ranks and percentiles of any number of values, without a task that sees all of them.

Different values are counted, dealt to parts by ranges of value and counted up
within each part; a part starts where the parts before it end. The ranges are
found first and stand in the plan as numbers, so a value's part is the same
wherever and however often Spark evaluates it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.guards import col, is_float, kind_of

#: Different values of a part on average, and the most parts (which bounds what the driver and the plan hold).
PART, PARTS = 200_000, 1024


def _ranges(counts: DataFrame, value: str) -> list[float]:
    """Where the parts begin, from all different values: none if one part holds them."""
    n = counts.count()
    parts = min(PARTS, -(-n // PART))
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return sorted(set(counts.agg(F.percentile_approx(F.col(value).cast("double"), shares, 8 * parts).alias("edges")).first().edges))


def counted_up(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counts`` (keys, value, n) with before: how many rows of the same keys have a smaller value.

    Values are numbers, neither null nor NaN. The ranges are those of the values
    of all keys together, so no part of a key has more than its share of them.
    """
    edges = _ranges(counts, value)
    if not edges:
        return counts.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy(value)) - F.col("n"))
    splits = [float("-inf"), *edges, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_x", outputCol="_part").transform(counts.withColumn("_x", F.col(value).cast("double"))).drop("_x")
    sizes = ranged.groupBy("_part", *keys).agg(F.sum("n").alias("_size"))
    # at most one row for each part and each key that it has
    starts = sizes.withColumn("_start", F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_size")).drop("_size")
    within = F.sum("n").over(Window.partitionBy("_part", *keys).orderBy(value)) - F.col("n")
    joined = ranged.withColumn("_within", within).join(starts, ["_part", *keys])
    return joined.withColumn("before", F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")


def average_ranks(counts: DataFrame, value: str) -> DataFrame:
    """value and the average rank of each distinct value, from counts per value (value, n)."""
    ranked = counted_up(counts.withColumn("_one", F.lit(0)), ["_one"], value)
    return ranked.select(value, (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def _percentiles_of(counts: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    ranked = counted_up(counts, keys, value)
    rows = ranked.join(counts.groupBy(*keys).agg(F.sum("n").alias("_all")), keys)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))

    columns = []
    for i, s in enumerate(shares):
        place = F.lit(float(s)) * (F.col("_all") - 1)
        columns += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
    ends = rows.groupBy(*keys, "_all").agg(*columns)

    def between(i: int, s: float) -> Column:
        place = F.lit(float(s)) * (F.col("_all") - 1)
        over = place - F.floor(place)
        return F.col(f"_lo{i}") * (1 - over) + F.col(f"_hi{i}") * over

    return ends.select(*keys, F.col("_all").alias("n"), F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("q"))


def percentiles_by(values: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, n and q: the percentiles (linear between neighbours) of the values of each key that are not null."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return _percentiles_of(counts, keys, value, shares)


def frequencies(df: DataFrame, columns: list[Column]) -> DataFrame:
    """i, x, n: how often each value that is not null occurs in the i-th column."""
    if len(columns) == 1:
        long = df.select(F.lit(0).alias("i"), columns[0].cast("double").alias("x"))
    else:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("x")) for i, c in enumerate(columns)])).alias("r")).select("r.i", "r.x")
    return long.where("x is not null").groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))


def _found(counts: DataFrame, shares: list[float]) -> dict[int, list[float]]:
    """q by i of frequencies (i, x, n), on the driver: a few numbers a column. The frequencies are kept while they are looked at."""
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {r.i: r.q for r in _percentiles_of(counts, ["i"], "x", shares).collect()}
    finally:
        counts.unpersist()


def median_and_deviation(df: DataFrame, column: Column, shares: list[float]) -> tuple[int, list[float], float] | None:
    """(number of values, their percentiles, the median of their distances from their median), all from one count of the values; None without any."""
    counts = frequencies(df, [column]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        one = _percentiles_of(counts, ["i"], "x", [0.5, *shares]).first()
        if one is None:
            return None
        middle, *q = one.q
        apart = counts.groupBy("i", F.abs(F.col("x") - middle).alias("x")).agg(F.sum("n").alias("n"))
        return one.n, q, _percentiles_of(apart, ["i"], "x", [0.5]).first().q[0]
    finally:
        counts.unpersist()


def percentiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> DataFrame:
    """One row: for each name the array of its column's percentiles, null where the column has no value."""
    found = _found(frequencies(df, list(columns.values())), shares)
    return df.sparkSession.createDataFrame([tuple(found.get(i) for i in range(len(columns)))], T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in columns]))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_distinct:<column> of each column (-0.0 is 0.0). Values are counted by column, not rows by all columns."""
    text = lambda c: (F.when(F.isnan(col(c)), F.lit(float("nan"))).otherwise(col(c) + F.lit(0.0)) if is_float(kind_of(df, c)) else col(c)).cast("string")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), text(c).alias("v")) for i, c in enumerate(columns)])).alias("r")).select("r.*")
    counts = long.where("v is not null").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(f"n_distinct:{c}") for i, c in enumerate(columns)])
