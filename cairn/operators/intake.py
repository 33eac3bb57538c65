"""Profiles of tables whose columns are text, as they come in: types, missing marks, dates, cardinality."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.functions.guards import col

# What stands for a missing value, and endings of names of columns with dates.
MISSING = ("", "na", "n/a", "null", "none", "nan")
DATE_NAME = r"(date|time|month|week|quarter|year)$"
FAMILIES = ("integer", "number", "date_like", "boolean", "string")
#: Share of different values beyond which a column counts as of high cardinality.
HIGH = 0.9


def missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING)


def family(c: Column) -> Column:
    """integer, number, date_like, boolean or string, by the text; null where it is missing."""
    t = F.trim(c)
    kind = F.when(t.rlike(r"^[+-]?\d+$"), "integer").when(t.rlike(r"^[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?$"), "number").when(t.rlike(text.DATE_LIKE), "date_like").when(F.lower(t).isin("true", "false"), "boolean").otherwise("string")
    return F.when(~missing(c), kind)


def intake_profile(df: DataFrame) -> DataFrame:
    """One row per column: missing values, different ones, counts of families, invalid dates, inferred type, constant, high_cardinality.

    Values are counted once per column and value, so a column costs its
    different values; every row takes part.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("v")) for c in df.columns])).alias("r")).select("r.*")
    counts = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.withColumn("family", family(F.col("v")))
    usable = F.col("family").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    out = kinds.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), total(~usable).alias("n_missing"), F.count(F.when(usable, F.lit(1))).alias("n_distinct"),
        *[total(F.col("family") == f).alias(f"n_{f}") for f in FAMILIES], total(usable & text.parsed_date(F.col("v")).isNull()).alias("n_no_date"),
        F.max(F.when(usable, F.col("v").rlike("[T ]"))).alias("timed"),
    )
    n = F.col("n_rows") - F.col("n_missing")
    dated = F.lower("column_name").rlike(DATE_NAME)
    n_families = sum((F.when(F.col(f"n_{f}") > 0, 1).otherwise(0) for f in FAMILIES), F.lit(0))
    kind = (
        F.when(n == 0, "string").when(dated & (F.col("n_date_like") == n), F.when(F.col("timed"), "datetime").otherwise("date"))
        .when(F.col("n_integer") == n, "integer").when(F.col("n_integer") + F.col("n_number") == n, "number").when(F.col("n_boolean") == n, "boolean")
        .when(n_families <= 2, "category").otherwise("string")
    )
    return out.select(
        "column_name", "n_rows", "n_missing", "n_distinct", *[f"n_{f}" for f in FAMILIES], F.when(dated, F.col("n_no_date")).otherwise(0).alias("n_invalid_dates"), kind.alias("inferred_type"),
        ((n > 0) & (F.col("n_distinct") <= 1)).alias("constant"), (n_families > 1).alias("mixed"), (F.col("n_distinct") > HIGH * F.col("n_rows")).alias("high_cardinality"),
    )


def roll_up(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: table_name, n_rows, n_columns, n_cells, n_null, null_share. One aggregate a table."""
    out = None
    for name, df in tables.items():
        nulls = sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0)).cast("long")
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), nulls.alias("n_null"))
        out = one if out is None else out.unionByName(one)
    cells = F.col("n_rows") * F.col("n_columns")
    return out.select("table_name", "n_rows", "n_columns", cells.alias("n_cells"), "n_null", F.coalesce(F.try_divide(F.col("n_null").cast("double"), cells), F.lit(0.0)).alias("null_share"))


def chart_suggestions(profile: DataFrame, sensitive: list[str]) -> DataFrame:
    """chart, x, y for pairs of columns of an intake profile; columns that may hold personal data take no part.

    A line over a date for each number, a bar over a category for each number, a
    histogram of each number. The profile has one row a column.
    """
    usable = profile.where(~F.col("column_name").isin(*sensitive) & ~F.col("constant")) if sensitive else profile.where(~F.col("constant"))
    numbers = usable.where(F.col("inferred_type").isin("integer", "number") & ~F.col("high_cardinality")).select(F.col("column_name").alias("y"))
    axes = usable.where(F.col("inferred_type").isin("date", "datetime", "category", "boolean") & (~F.col("high_cardinality") | F.col("inferred_type").isin("date", "datetime")))
    axes = axes.select(F.col("column_name").alias("x"), F.when(F.col("inferred_type").isin("date", "datetime"), "line").otherwise("bar").alias("chart"))
    # one row a column on both sides
    pairs = axes.join(F.broadcast(numbers), F.col("x") != F.col("y")).select("chart", "x", "y")
    return pairs.unionByName(numbers.select(F.lit("histogram").alias("chart"), F.col("y").alias("x"), F.lit(None).cast("string").alias("y")))


def is_date_name(name: str) -> bool:
    return bool(re.search(DATE_NAME, name.lower()))
