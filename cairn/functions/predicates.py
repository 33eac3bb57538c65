"""Typed predicates with three-valued logic and a policy for unknown rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.guards import col, is_float, is_numeric, kind_of

ORDERED = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: str
    value: Any = None


def literal(kind: T.DataType, value: Any) -> Column:
    """The value in the column's type; what would change in the cast is an error."""
    if isinstance(kind, T.BooleanType) != isinstance(value, bool):
        raise ValueError(f"{value!r} does not fit {kind.simpleString()}")
    if is_numeric(kind):
        if not isinstance(value, (int, float)) or value != value or abs(value) == float("inf"):
            raise ValueError(f"{value!r} is no finite number")
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and value != int(value):
            raise ValueError(f"{value!r} is no integer")
    elif isinstance(kind, T.StringType) and not isinstance(value, str):
        raise ValueError(f"{value!r} is no string")
    return F.lit(value).cast(kind)


def mask(df: DataFrame, p: Predicate) -> Column:
    """True, false or null (unknown). NaN is unequal to everything and in no order."""
    kind, c = kind_of(df, p.column), col(p.column)
    if p.operator in ("is_null", "is_not_null"):
        if p.value is not None:
            raise ValueError(f"{p.operator} takes no value")
        return c.isNull() if p.operator == "is_null" else c.isNotNull()
    number = (lambda test, nan: F.when(F.isnan(c), F.lit(nan)).otherwise(test)) if is_float(kind) else (lambda test, nan: test)
    if p.operator in ("in", "not_in"):
        values = [literal(kind, v) for v in p.value]
        if not values:
            raise ValueError("no values")
        hit = number(c.isin(*values), False)
        return hit if p.operator == "in" else ~hit
    if p.operator in ("eq", "ne"):
        hit = number(c == literal(kind, p.value), False)
        return hit if p.operator == "eq" else ~hit
    if p.operator in ORDERED and is_numeric(kind):
        return number(ORDERED[p.operator](c, literal(kind, p.value)), False)
    raise ValueError(f"{p.operator} does not apply to {p.column} of type {kind.simpleString()}")


def combined(df: DataFrame, predicates: list[Predicate], composition: str = "all") -> Column:
    masks = [mask(df, p) for p in predicates]
    if not masks or composition not in ("all", "any"):
        raise ValueError("predicates and all or any are needed")
    return reduce((lambda a, b: a & b) if composition == "all" else (lambda a, b: a | b), masks)


def rule_filter(df: DataFrame, predicates: list[Predicate], composition: str = "all", null_policy: str = "exclude") -> DataFrame:
    """Rows that satisfy the predicates; unknown ones stay if the policy is include."""
    return df.where(F.coalesce(combined(df, predicates, composition), F.lit(null_policy == "include")))


def rule_review(df: DataFrame, predicates: list[Predicate], composition: str = "all") -> DataFrame:
    """One row: rows, satisfied, failed, review (unknown)."""
    m = df.select(combined(df, predicates, composition).alias("m"))
    return m.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("m").alias("satisfied"), F.count_if(~F.col("m")).alias("failed"), F.count_if(F.col("m").isNull()).alias("review"))
