"""Types of text columns, found over all rows, and tables cast to them.

Every cell has a kind: integer, number, float (with an exponent), boolean, date,
timestamp, zoned (a timestamp with an offset) or text; empty cells have none.
A column's kinds are joined in one aggregate over all columns: integers beside
numbers are numbers, dates beside timestamps are timestamps, whatever else is
mixed is text. A number with a leading zero is text, as identifiers are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.guards import col
from cairn.sources import files

KINDS = ("integer", "number", "float", "boolean", "date", "timestamp", "zoned", "text")
#: Most digits of a decimal, and of a whole number that surely is a long.
DIGITS, LONG = 38, 18
_BIT = {k: 1 << i for i, k in enumerate(KINDS)}
_NUMBER = r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?$"
_FLOAT = r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?[eE][+-]?[0-9]{1,3}$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?"


@dataclass(frozen=True)
class Found:
    """A column's joined kind, the type that holds it, and how many cells have a value."""

    column: str
    kind: str
    type: str
    n_values: int


def _seconds(c: Column) -> Column:
    """A zoned time without seconds gets them, as the cast needs them."""
    return F.regexp_replace(c, "^(.{16})(Z|[+-])", "$1:00$2")


def cell_kind(c: Column) -> Column:
    """The kind of a text cell; null for a missing one."""
    dated = c.rlike(_DATE) & c.try_cast("date").isNotNull()
    timed = c.rlike(_TIME + "$") & c.try_cast("timestamp_ntz").isNotNull()
    zoned = c.rlike(_TIME + "(Z|[+-][0-9]{2}:[0-9]{2})$") & _seconds(c).try_cast("timestamp").isNotNull()
    kind = F.when(c.rlike(r"^[+-]?(0|[1-9][0-9]*)$"), "integer").when(c.rlike(_NUMBER), "number").when(c.rlike(_FLOAT), "float")
    kind = kind.when(F.lower(c).isin("true", "false"), "boolean").when(dated, "date").when(timed, "timestamp").when(zoned, "zoned").otherwise("text")
    return F.when(c.isNotNull() & (c != ""), kind)


def _joined(bits: int, whole: int, places: int) -> tuple[str, str]:
    """(kind, type) of a column whose cells have these kinds, most digits before and after the point."""
    kinds = {k for k in KINDS if bits & _BIT[k]}
    if kinds == {"integer"}:
        return ("integer", "bigint") if whole <= LONG else ("integer", f"decimal({whole},0)") if whole <= DIGITS else ("text", "string")
    if kinds and kinds <= {"integer", "number"}:
        return ("number", f"decimal({whole + places},{places})") if whole + places <= DIGITS else ("text", "string")
    if kinds and kinds <= {"integer", "number", "float"}:
        return "float", "double"
    if kinds and kinds <= {"date", "timestamp"}:
        return ("date", "date") if kinds == {"date"} else ("timestamp", "timestamp_ntz")
    if len(kinds) == 1 and (kind := kinds.pop()) in ("boolean", "zoned"):
        return kind, {"boolean": "boolean", "zoned": "timestamp"}[kind]
    return ("text" if bits else "missing"), "string"


def infer(df: DataFrame, columns: list[str] | None = None) -> list[Found]:
    """What each text column holds, from one pass over all rows; columns of other types are left out."""
    texts = [c for c in columns or df.columns if df.schema[c].dataType.simpleString() == "string"]
    if not texts:
        return []
    out = []
    for i, c in enumerate(texts):
        kind, number = cell_kind(col(c)), col(c).rlike(_NUMBER)
        digits = F.regexp_replace(col(c), "^[+-]", "")
        out += [
            F.bit_or(F.create_map(*[F.lit(x) for k in KINDS for x in (k, _BIT[k])])[kind]).alias(f"b{i}"),
            F.max(F.when(number, F.char_length(F.split(digits, r"\.")[0]))).alias(f"w{i}"),
            F.max(F.when(number, F.greatest(F.lit(0), F.char_length(digits) - F.char_length(F.split(digits, r"\.")[0]) - 1))).alias(f"p{i}"),
            F.count(kind).alias(f"n{i}"),
        ]
    one = df.agg(*out).first()
    return [Found(c, *_joined(one[f"b{i}"] or 0, one[f"w{i}"] or 0, one[f"p{i}"] or 0), one[f"n{i}"]) for i, c in enumerate(texts)]


def _cast(c: Column, kind: str) -> Column:
    """The cell as the type; null for a missing one and for one that the type cannot hold as it is."""
    value = (_seconds(c) if kind == "timestamp" else c).try_cast(kind)
    if kind.startswith("decimal"):  # nothing is rounded
        places = kind[:-1].split(",")[1].strip()
        value = F.when(c.rlike(rf"^[+-]?[0-9]+(\.[0-9]{{0,{places}}}0*)?$"), value)
    return F.when(c != "", value)


def cast_table(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The columns as their types; missing cells are null, and so are those that ``rejected`` tells."""
    return df.select(*[_cast(col(c), types[c]).alias(c) if types.get(c, "string") != "string" else col(c) for c in df.columns])


def rejected(df: DataFrame, types: dict[str, str], row: str | None = None) -> DataFrame:
    """row (if named), column_name, value, type of the cells that have a value but not one of their column's type."""
    cells = [F.when((col(c) != "") & _cast(col(c), t).isNull(), F.struct(F.lit(c).alias("column_name"), col(c).alias("value"), F.lit(t).alias("type"))) for c, t in types.items() if t != "string"]
    own = [col(row).alias("row")] if row else []
    return df.select(*own, F.inline(F.array_compact(F.array(*cells)))) if cells else df.select(*own, *[F.lit(None).cast("string").alias(n) for n in ("column_name", "value", "type")]).limit(0)


def typed(df: DataFrame) -> DataFrame:
    """The table with every text column as the type that holds all of its cells."""
    return cast_table(df, {f.column: f.type for f in infer(df)})


def read_typed(spark: SparkSession, path: str, record: str | None = None) -> DataFrame:
    """``files.read`` with types found for the formats that have none (CSV, TSV, XML, XLSX)."""
    df = files.read(spark, path, record)
    return typed(df) if path.rstrip("/").rsplit(".", 1)[-1].lower() in ("csv", "tsv", "xml", "xlsx") else df


def read_loose(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON or JSON lines for intake: repeated column names of a CSV get __duplicate_ and their place, blank names are an error; blank lines are skipped."""
    if not path.rstrip("/").lower().endswith(".csv"):
        return files.read(spark, path)
    import csv

    head = spark.read.text(path).limit(1).collect()
    names = next(csv.reader([head[0].value.lstrip("﻿")])) if head else []
    if not names or any(not n.strip() for n in names):
        raise ValueError(f"{path!r} has blank column names: {names}")
    own = [f"{n}__duplicate_{i}" if names.count(n) > 1 else n for i, n in enumerate(names, 1)]
    return files.read_named(spark, path, own)
