"""Joining several tables in a chain and grouping the result, with evidence about keys and rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.exact import ExactFloats
from cairn.functions.guards import col, family, finite, is_float, is_numeric, kind_of, same_family
from cairn.functions.text import normal_name
from cairn.operators.ranks import distinct_counts


@dataclass(frozen=True)
class Join:
    """The table ``right`` joins the chain on left_table.left_key = right.right_key."""

    left_table: str
    left_key: str
    right: str
    right_key: str
    how: str = "inner"
    allow_many_to_many: bool = False


@dataclass(frozen=True)
class Metric:
    """operation: count, sum, average, minimum, maximum or distinct_count of a column (count: or of rows)."""

    operation: str
    column: str | None = None
    name: str | None = None


def qualified(alias: str, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns as alias.column."""
    return df.select(*[col(c).alias(f"{alias}.{c}") for c in columns or df.columns])


def cardinality(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> str:
    """one_to_one, one_to_many (the left key is unique), many_to_one or many_to_many, from one count of both sides' keys."""
    side = lambda df, k, n: df.select(finite(df, k).alias("k"), F.lit(n).alias("l"), F.lit(1 - n).alias("r"))
    counts = side(left, left_key, 1).unionAll(side(right, right_key, 0)).where("k is not null").groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    most = counts.agg(F.max("l").alias("l"), F.max("r").alias("r")).first()
    return {(False, False): "one_to_one", (False, True): "one_to_many", (True, False): "many_to_one", (True, True): "many_to_many"}[(most["l"] or 0) > 1, (most["r"] or 0) > 1]


def join_chain(sources: dict[str, DataFrame], joins: list[Join], guard: bool = True) -> DataFrame:
    """All columns as alias.column, joined in the order given; the first source starts the chain.

    Null, NaN and infinite keys match nothing. Keys of different type families
    are an error. With ``guard`` a step whose two keys both repeat is an error
    unless it is allowed.
    """
    names = list(sources)
    if [j.right for j in joins] != names[1:]:
        raise ValueError("each join must add the next source")
    frame, seen = qualified(names[0], sources[names[0]]), {names[0]}
    for j in joins:
        if j.how not in ("inner", "left"):
            raise ValueError(f"no join type {j.how!r}")
        if j.left_table not in seen:
            raise ValueError(f"{j.left_table} is not joined yet")
        left, right = sources[j.left_table], sources[j.right]
        if not same_family(kind_of(left, j.left_key), kind_of(right, j.right_key)):
            raise ValueError(f"{j.left_table}.{j.left_key} and {j.right}.{j.right_key} have incompatible types")
        if guard and not j.allow_many_to_many and cardinality(left, j.left_key, right, j.right_key) == "many_to_many":
            raise ValueError(f"{j.left_key} and {j.right_key} both repeat; allow_many_to_many is needed")
        other = qualified(j.right, right)
        frame = frame.join(other, finite(frame, f"{j.left_table}.{j.left_key}") == finite(other, f"{j.right}.{j.right_key}"), j.how)
        seen.add(j.right)
    return frame


def join_evidence(left: DataFrame, left_key: str, right: DataFrame, right_key: str, how: str = "inner") -> DataFrame:
    """One row about a join before it runs: rows, null keys, unmatched left rows, exact output rows and cardinality."""
    a = left.select(finite(left, left_key).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("l"))
    b = right.select(finite(right, right_key).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("r"))
    both = a.join(b, a["k"].eqNullSafe(b["k"]), "full").select(F.coalesce(a["k"], b["k"]).alias("k"), F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    matched = F.when(F.col("k").isNotNull(), F.col("l") * F.col("r")).otherwise(0)
    unmatched = F.when(F.col("k").isNull() | (F.col("r") == 0), F.col("l")).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    many = lambda c: F.coalesce(F.max(F.when(F.col("k").isNotNull(), F.col(c))), F.lit(0)) > 1
    out = both.agg(
        total("l").alias("left_rows"), total("r").alias("right_rows"),
        total(F.when(F.col("k").isNull(), F.col("l"))).alias("left_null_keys"), total(F.when(F.col("k").isNull(), F.col("r"))).alias("right_null_keys"),
        total(unmatched).alias("unmatched_left_rows"), (total(matched) + (total(unmatched) if how == "left" else F.lit(0))).alias("output_rows"),
        many("l").alias("_l"), many("r").alias("_r"),
    )
    label = F.when(F.col("_l") & F.col("_r"), "many_to_many").when(F.col("_l"), "many_to_one").when(F.col("_r"), "one_to_many").otherwise("one_to_one")
    return out.withColumn("cardinality", label).drop("_l", "_r")


def unmatched(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Left rows whose key the right side does not have."""
    r = right.select(finite(right, right_key).alias("_k"))
    return left.join(r, finite(left, left_key) == r["_k"], "left_anti")


def metric_column(df: DataFrame, m: Metric, exact: ExactFloats) -> Column:
    if m.operation == "count":
        return F.count(col(m.column) if m.column else F.lit(1))
    if m.column is None:
        raise ValueError(f"{m.operation} needs a column")
    kind, c = kind_of(df, m.column), finite(df, m.column)
    if m.operation in ("sum", "average"):
        if not is_numeric(kind):
            raise ValueError(f"{m.operation} needs a number, {m.column} is {kind.simpleString()}")
        return exact.total(m.column) if m.operation == "sum" else exact.average(m.column)
    if m.operation in ("minimum", "maximum"):
        if isinstance(kind, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"{m.column} has no order")
        return F.min(c) if m.operation == "minimum" else F.max(c)
    if m.operation == "distinct_count":
        return F.count_distinct(c)
    raise ValueError(f"no metric {m.operation!r}")


def aggregate(frame: DataFrame, dimensions: list[str], metrics: list[Metric], evidence: bool = False, sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """Metrics of each group; NaN belongs to the null group. evidence: also valid and missing values and rows of each group.

    Sums and averages are exact. ``sources``: the joined tables by alias, where
    the magnitudes of floats are looked up without running the join.
    """
    keys = [F.when(~F.isnan(col(d)), col(d)).alias(d) if is_float(kind_of(frame, d)) else col(d) for d in dimensions]
    summed = [m.column for m in metrics if m.operation in ("sum", "average") and m.column]
    exact = ExactFloats(frame, summed, sources)
    out = []
    for m in metrics:
        name = m.name or (f"{m.operation}_{m.column}" if m.column else m.operation)
        out.append(metric_column(frame, m, exact).alias(name))
        if evidence and m.column:
            valid = F.count(finite(frame, m.column))
            out += [valid.alias(f"{name}_valid"), (F.count(F.lit(1)) - valid).alias(f"{name}_missing")]
    if evidence:
        out.append(F.count(F.lit(1)).alias("group_rows"))
    return frame.groupBy(*keys).agg(*out)


def analyze(sources: dict[str, DataFrame], joins: list[Join], dimensions: list[str], metrics: list[Metric], evidence: bool = False, guard: bool = True) -> DataFrame:
    return aggregate(join_chain(sources, joins, guard), dimensions, metrics, evidence, sources)


def overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Distinct keys of both sides, their intersection, and its share of the smaller side and of each side."""
    a = left.select(finite(left, left_key).alias("k")).where("k is not null").distinct().withColumn("l", F.lit(1))
    b = right.select(finite(right, right_key).alias("k")).where("k is not null").distinct().withColumn("r", F.lit(1))
    n = a.join(b, "k", "full").agg(F.count("l").alias("left_distinct"), F.count("r").alias("right_distinct"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"))
    share = lambda d: F.coalesce(F.try_divide(F.col("common").cast("double"), d), F.lit(0.0))
    return n.withColumns({"overlap": share(F.least("left_distinct", "right_distinct")), "left_coverage": share(F.col("left_distinct")), "right_coverage": share(F.col("right_distinct"))})


def pair_overlaps(tables: dict[str, DataFrame]) -> DataFrame:
    """left, right, common: different key values that two columns of different tables share, for all pairs of the same type family at once.

    Columns are told table.column. Every value is looked at once with the set of
    columns that have it; a set is no larger than the number of columns.
    """
    parts = []
    for t, df in tables.items():
        for c in df.columns:
            if not same_family(df.schema[c].dataType, df.schema[c].dataType):
                continue
            kind = df.schema[c].dataType
            value = (finite(df, c).cast("double") + F.lit(0.0) if is_numeric(kind) else col(c)).cast("string")
            parts.append((df, F.struct(F.lit(f"{t}.{c}").alias("name"), F.lit(t).alias("t"), F.lit(family(kind)).alias("family"), value.alias("v"))))
    long = reduce(DataFrame.unionByName, [df.select(F.explode(F.array(*[p for d, p in parts if d is df])).alias("r")).select("r.*") for df in tables.values()])
    held = long.where("v is not null").distinct().groupBy("family", "v").agg(F.sort_array(F.collect_set(F.struct("t", "name"))).alias("s")).where(F.size("s") > 1)
    ends = held.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a.t < b.t")
    return ends.groupBy(F.col("a.name").alias("left"), F.col("b.name").alias("right")).agg(F.count(F.lit(1)).alias("common"))


def recommend_joins(tables: dict[str, DataFrame], least: float = 0.0, most: int = 50) -> list[dict]:
    """The ``most`` best of all column pairs of the same type family that share a key, judged over all rows.

    Score: 0.30 for the same normal name, 0.25 for compatible types, 0.20 of
    the smaller uniqueness, 0.10 of the keys that are not null, 0.15 of the
    overlap. Runs two aggregates a table and one over the values of all.
    """
    stats = {}
    for t, df in tables.items():
        keys = [c for c in df.columns if same_family(df.schema[c].dataType, df.schema[c].dataType)]
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(finite(df, c)).alias(f"v:{c}") for c in keys]).first()
        kinds = distinct_counts(df.select(*[finite(df, c).alias(c) for c in keys]), keys).first()
        for c in keys:
            stats[f"{t}.{c}"] = (kinds[f"n_distinct:{c}"], counts[f"v:{c}"], counts["n"])
    out = []
    for r in pair_overlaps(tables).collect():  # one row a pair of columns
        (da, va, na), (db, vb, nb) = stats[r.left], stats[r.right]
        ua, ub = da / max(va, 1), db / max(vb, 1)
        same = normal_name(r.left.split(".", 1)[1]) == normal_name(r.right.split(".", 1)[1])
        absent = max(1 - va / max(na, 1), 1 - vb / max(nb, 1))
        score = 0.30 * same + 0.25 + 0.20 * min(ua, ub) + 0.10 * (1 - absent) + 0.15 * r.common / max(min(da, db), 1)
        kind = {(True, True): "one_to_one", (True, False): "one_to_many", (False, True): "many_to_one", (False, False): "many_to_many"}[ua == 1, ub == 1]
        if score >= least:
            out.append({"left": r.left, "right": r.right, "score": score, "overlap": r.common, "cardinality": kind, "same_name": same})
    return sorted(out, key=lambda r: (-round(r["score"], 12), r["left"], r["right"]))[:most]
