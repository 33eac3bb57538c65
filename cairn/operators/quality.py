"""Profiles and data-quality findings. Each check is one aggregate over the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.guards import col, finite, is_float, is_numeric, kind_of
from cairn.operators.ranks import distinct_counts, percentiles

#: Rows that a finding shows as examples.
EXAMPLES = 5


def _long(df: DataFrame, columns: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per column of an aggregate whose fields are named field:column."""
    names = sorted({k.split(":", 1)[0] for k in values})
    one = df.agg(*[v.alias(k) for k, v in values.items()])
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{n}:{c}`").alias(n) for n in names]) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _empty(df: DataFrame, c: str) -> Column:
    return F.count_if(col(c) == "") if isinstance(kind_of(df, c), T.StringType) else F.lit(0).cast("long")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_rows, n_null, n_empty, n_nonfinite, n_distinct (exact), and minimum, maximum, mean, median of numbers."""
    columns, out = columns or df.columns, {}
    numbers = [c for c in columns if is_numeric(kind_of(df, c))]
    for c in columns:
        x = finite(df, c).cast("double") if c in numbers else F.lit(None).cast("double")
        out |= {
            f"n_rows:{c}": F.count(F.lit(1)), f"n_null:{c}": F.count_if(col(c).isNull()), f"n_empty:{c}": _empty(df, c),
            f"n_nonfinite:{c}": F.count(col(c)) - F.count(finite(df, c)), f"minimum:{c}": F.min(x), f"maximum:{c}": F.max(x), f"mean:{c}": F.avg(x),
        }
    one = df.agg(*[v.alias(k) for k, v in out.items()]).join(F.broadcast(distinct_counts(df, columns)))
    if numbers:
        one = one.join(F.broadcast(percentiles(df, {f"q:{c}": finite(df, c) for c in numbers}, [0.5])))
    for c in columns:
        one = one.withColumn(f"median:{c}", F.col(f"`q:{c}`")[0] if c in numbers else F.lit(None).cast("double"))
    names = sorted({k.split(":", 1)[0] for k in out} | {"n_distinct", "median"})
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{n}:{c}`").alias(n) for n in names]) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def coerced_numbers(df: DataFrame, column: str) -> DataFrame:
    """How many values of a text column are finite numbers after trimming: n_values, n_numeric, all_numeric."""
    c = F.trim(col(column))
    x = c.try_cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.agg(F.count_if(c != "").alias("n_values"), F.count_if((c != "") & good).alias("n_numeric")).withColumn("all_numeric", (F.col("n_values") > 0) & (F.col("n_values") == F.col("n_numeric")))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """value, n, share (percent of values that are not null) of the k most frequent values, ties by value."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.orderBy(F.desc("n"), "value").limit(k).join(F.broadcast(total)).select("value", "n", (100.0 * F.col("n") / F.col("total")).alias("share"))


def missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    out = {f"n_null:{c}": F.count_if(col(c).isNull()) for c in columns} | {f"n_empty:{c}": _empty(df, c) for c in columns}
    return _long(df, columns, out).withColumn("affected", F.col("n_null") + F.col("n_empty"))


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns with two or more values (empty texts left out) that are all the same."""
    columns = columns or df.columns
    value = {c: F.when(col(c) != "", col(c)) if isinstance(kind_of(df, c), T.StringType) else col(c) for c in columns}
    out = {f"n_values:{c}": F.count(v) for c, v in value.items()} | {f"_same:{c}": F.min(v).eqNullSafe(F.max(v)) for c, v in value.items()}
    return _long(df, columns, out).select("column_name", "n_values", (F.col("_same") & (F.col("n_values") >= 2)).alias("constant"))


def whitespace(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts with white space (Unicode) at an end, or two or more inside."""
    out = {}
    for c in columns:
        edge, double = col(c).rlike(r"(?U)^\s|\s$"), col(c).rlike(r"(?U)\S\s{2,}\S")
        out |= {f"n_edge:{c}": F.count_if(edge), f"n_repeated:{c}": F.count_if(double), f"affected:{c}": F.count_if(edge | double)}
    return _long(df, columns, out)


def nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    return _long(df, columns, {f"n_values:{c}": F.count(col(c)) for c in columns} | {f"affected:{c}": F.count(col(c)) - F.count(finite(df, c)) for c in columns})


def type_families(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many texts read as integer, number, boolean, date or other text; consistent: one family (integer and number are one)."""
    out = {}
    for c in columns:
        t = F.trim(col(c))
        integer, number = t.rlike(r"^[+-]?\d+$"), t.try_cast("double").isNotNull()
        boolean, date = F.lower(t).isin("true", "false"), t.rlike(r"^\d{4}-\d{2}-\d{2}")
        kind = F.when(t.isNull() | (t == ""), None).when(integer | number, "number").when(boolean, "boolean").when(date, "date").otherwise("text")
        out |= {f"{k}:{c}": F.count_if(kind == k) for k in ("number", "boolean", "date", "text")}
    kinds = sum((F.when(F.col(k) > 0, 1).otherwise(0) for k in ("number", "boolean", "date", "text")), F.lit(0))
    return _long(df, columns, out).withColumn("consistent", kinds <= 1)


def _bounds(df: DataFrame, column: str, method: str, threshold: float) -> DataFrame:
    x = finite(df, column).cast("double")
    if method == "iqr":
        one = df.agg(F.count(x).alias("n")).join(F.broadcast(percentiles(df, {"q": x}, [0.25, 0.75])))
        spread = F.col("q")[1] - F.col("q")[0]
        return one.select((F.col("q")[0] - threshold * spread).alias("lo"), (F.col("q")[1] + threshold * spread).alias("hi"), (F.col("n") >= 4).alias("usable"))
    one = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.count(x).alias("n"))
    return one.select((F.col("m") - threshold * F.col("s")).alias("lo"), (F.col("m") + threshold * F.col("s")).alias("hi"), (F.coalesce(F.col("s"), F.lit(0.0)) > 0).alias("usable"))


def outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows strictly beyond the quartile fences (iqr) or so many population deviations from the mean (zscore)."""
    b = _bounds(df, column, method, threshold)  # one row
    x = finite(df, column).cast("double")
    return df.join(F.broadcast(b), (x < b["lo"]) | (x > b["hi"])).where("usable").drop("lo", "hi", "usable")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_duplicates (rows beyond the first of each kind)."""
    kinds = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def business_key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keyed rows, rows with a null in the key, rows beyond the first of their key."""
    absent = reduce(lambda a, b: a | b, (col(k).isNull() for k in keys))
    counts = df.groupBy(absent.alias("absent"), *[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counts.agg(total(F.when(~F.col("absent"), F.col("n"))).alias("n_keyed"), total(F.when(F.col("absent"), F.col("n"))).alias("n_null_key"), total(F.when(~F.col("absent"), F.col("n") - 1)).alias("n_duplicates"))


def examples(df: DataFrame, group: str, order: str, k: int = EXAMPLES) -> DataFrame:
    """The first k rows of each group; groups with many rows are cut before the shuffle's sort by Spark's group limit."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(col(group)).orderBy(col(order)))).where(F.col("nth") <= k)
