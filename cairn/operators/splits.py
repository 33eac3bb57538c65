"""Splits that keep the share of every class, whole groups, or everything that is connected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.guards import col, is_float, kind_of
from cairn.operators.ranks import counted_up
from cairn.sources.shared import settled

#: Groups that a split by groups needs.
GROUPS = 5
NAMES = ("train", "validation", "test")


def _place(*columns: Column) -> Column:
    """A number of 52 bits from a hash: rows stand in this order, which no other row changes."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(42), *columns), 12).cast("double")


def _dealt(counts: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """keys, place, n -> with split: the first share of each key's rows by place, and so on; rows of one place stay together."""
    ranked = counted_up(counts, keys, "place")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    middle = F.col("before") + (F.col("n") - 1) / 2  # a place is where most of its rows are
    split, upto = F.lit(NAMES[len(shares) - 1]), 0.0
    edges = [upto := upto + s for s in shares[:-1]]
    for name, edge in reversed(list(zip(NAMES, edges, strict=False))):
        split = F.when(middle < F.round(F.col("_all") * F.lit(round(edge, 12))), name).otherwise(split)
    return ranked.join(totals, keys).select(*keys, "place", split.alias("split"))


def stratified_split(df: DataFrame, label: str, key: str, shares: tuple[float, ...] = (0.6, 0.2, 0.2)) -> DataFrame:
    """The frame with split: of each label the shares, to one row if keys differ. Null is a label. Rows with the same key and label stay together."""
    rows = df.withColumn("_label", col(label).cast("string")).withColumn("_place", _place(col(key).cast("string")))
    counts = rows.groupBy(F.coalesce("_label", F.lit("")).alias("label"), F.col("_label").isNull().alias("none"), F.col("_place").alias("place")).agg(F.count(F.lit(1)).alias("n"))
    dealt = _dealt(counts, ["label", "none"], shares)
    # where a label's splits begin: a row a label and split, not a row a row
    starts = dealt.groupBy("label", "none").agg(*[F.min(F.when(F.col("split") == s, F.col("place"))).alias(f"_from_{s}") for s in NAMES[1 : len(shares)]])
    joined = rows.join(starts, (F.coalesce("_label", F.lit("")) == F.col("label")) & (F.col("_label").isNull() == F.col("none")), "left")
    split = F.lit(NAMES[0])
    for s in NAMES[1 : len(shares)]:
        split = F.when(F.col("_place") >= F.col(f"_from_{s}"), s).otherwise(split)
    return joined.select(*[rows[f"`{c}`"] for c in df.columns], split.alias("split"))


def group_split(df: DataFrame, group: str, shares: tuple[float, ...] = (0.6, 0.2, 0.2)) -> DataFrame:
    """The frame with split: whole groups, dealt by a hash until a split has its share of the rows (to half a group at each edge).

    A null (or NaN) group and fewer than GROUPS groups are errors.
    """
    c = col(group)
    unknown = c.isNull() | F.isnan(c) if is_float(kind_of(df, group)) else c.isNull()
    sizes = settled(df.groupBy(c.cast("string").alias("_group"), unknown.alias("unknown")).agg(F.count(F.lit(1)).alias("n")))
    seen = sizes.agg(F.coalesce(F.sum(F.when(F.col("unknown"), F.col("n"))), F.lit(0)).alias("lost"), F.count(F.lit(1)).alias("groups")).first()
    if seen.lost:
        raise ValueError(f"{seen.lost} rows have no {group}")
    if seen.groups < GROUPS:
        raise ValueError(f"{GROUPS} different groups are needed, there are {seen.groups}")
    counts = sizes.select("_group", _place(F.col("_group")).alias("place"), "n", F.lit(0).alias("all"))
    dealt = _dealt(counts.groupBy("all", "place").agg(F.sum("n").alias("n")), ["all"], shares)
    named = counts.select("_group", "place").join(dealt.select("place", "split"), "place").drop("place")
    return df.join(named, c.cast("string") == F.col("_group")).select(*[df[f"`{x}`"] for x in df.columns], "split")


def connected(df: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """row, component: rows that share a value of any of the key columns belong together, and what they are connected to.

    The component is named by its smallest value, as key=value; a row without
    any value is alone (component null). Only values are walked, not pairs of
    rows: a value that many rows have costs one edge a row.
    """
    values = F.array_compact(F.array(*[F.when(col(k).isNotNull(), F.concat(F.lit(f"{k}="), col(k).cast("string"))) for k in keys]))
    rows = df.select(col(row).alias("row"), values.alias("v"))
    first = rows.select(F.element_at("v", 1).alias("a"), F.explode(F.slice("v", 2, max(1, len(keys)))).alias("b")).distinct() if len(keys) > 1 else rows.select(F.lit("").alias("a"), F.lit("").alias("b")).limit(0)
    edges = settled(first.unionAll(first.select("b", "a")).where("a <> b").distinct())
    names = rows.select(F.explode("v").alias("value")).distinct()
    labels = settled(names.join(edges.groupBy(F.col("a").alias("value")).agg(F.min("b").alias("least")), "value", "left").select("value", F.coalesce(F.least("value", "least"), "value").alias("label")))
    while not edges.isEmpty():
        near = edges.join(labels.select(F.col("value").alias("b"), "label"), "b").groupBy(F.col("a").alias("value")).agg(F.min("label").alias("near"))
        step = labels.join(near, "value", "left").select("value", "label", F.coalesce(F.least("label", "near"), "label").alias("best"))
        # the label of the label: paths are halved in each round
        jump = labels.select(F.col("value").alias("best"), F.col("label").alias("far"))
        moved = settled(step.join(jump, "best").select("value", "label", F.least("best", "far").alias("new")))
        labels = moved.select("value", F.col("new").alias("label"))
        if moved.where("new <> label").isEmpty():
            break
    return rows.select("row", F.try_element_at("v", F.lit(1)).alias("value")).join(labels, "value", "left").select("row", F.col("label").alias("component"))


def connected_split(df: DataFrame, row: str, keys: list[str], shares: tuple[float, ...] = (0.8, 0.1, 0.1)) -> DataFrame:
    """row, component, split: whole components, so that no value of a key is in two splits; rows without values are components of their own."""
    found = settled(connected(df, row, keys))
    own = F.coalesce("component", F.concat(F.lit("row="), F.col("row").cast("string")))
    return group_split(found.withColumn("_own", own), "_own", shares).drop("_own")


def split_faults(df: DataFrame, row: str, keys: list[str], split: str = "split") -> DataFrame:
    """fault, value, n: rows whose id repeats, rows without a value of a key, values of a key that are in several splits."""
    out = df.groupBy(col(row).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate id").alias("fault"), "value", "n")
    for k in keys:
        blank = df.where(col(k).isNull() | (col(k).cast("string") == "")).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        out = out.unionByName(blank.select(F.lit(f"no {k}").alias("fault"), F.lit(None).cast("string").alias("value"), "n"))
        several = df.where(col(k).isNotNull()).select(col(k).cast("string").alias("value"), col(split).alias("s")).distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(several.select(F.lit(f"{k} in several splits").alias("fault"), "value", "n"))
    return out
