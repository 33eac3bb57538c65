"""Readers by file extension, and a Parquet writer with counts and a digest of what it wrote.

All files are read by Spark, so any path that Spark can open will do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.guards import col, is_float

#: A value that no cell has, so that no cell is read as null.
_NEVER = "\u0001never\u0001"
_CSV = {"header": True, "mode": "FAILFAST", "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "nullValue": _NEVER}


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Text columns named by the first row; empty cells stay empty, a row of another width is an error when it is read."""
    # column pruning would hide rows of another width
    names = spark.read.options(**_CSV, sep=separator, enforceSchema=False).csv(path).columns
    if len({n.lower() for n in names}) != len(names):
        raise ValueError(f"column names repeat: {names}")
    return _named(spark, path, names, separator, False)


def read_named(spark: SparkSession, path: str, names: list[str], separator: str = ",") -> DataFrame:
    """Text columns under these names, whatever the first row says."""
    return _named(spark, path, names, separator, True)


def _named(spark: SparkSession, path: str, names: list[str], separator: str, enforce: bool) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).options(**_CSV, sep=separator, enforceSchema=enforce).csv(path).na.fill("")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a malformed line is an error."""
    return spark.read.options(mode="FAILFAST", prefersDecimal=True).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, one flat object, or an object whose only property is such an array."""
    df = spark.read.options(multiLine=True, mode="FAILFAST", prefersDecimal=True, allowNonNumericNumbers=False).json(path)
    if len(df.columns) == 1:
        kind = df.schema[0].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return df.select(F.inline(col(df.columns[0])))
    return df


def read_xml(spark: SparkSession, path: str, record: str) -> DataFrame:
    """One row per ``record`` element; nested leaves are named a/b, attributes @name or a/@name, the record's own text #text."""
    df = spark.read.options(rowTag=record, mode="FAILFAST", attributePrefix="@", valueTag="#text", ignoreNamespace=True).xml(path)
    out = []

    def flat(kind: T.DataType, at, name: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                own = name if field.name == "#text" and name else f"{name}/{field.name}" if name else field.name
                flat(field.dataType, at.getField(field.name) if at is not None else col(field.name), own)
        elif isinstance(kind, T.ArrayType):
            raise ValueError(f"element {name!r} repeats in a record")
        else:
            out.append(at.alias(name))

    flat(df.schema, None, "")
    return df.select(*out)


def read(spark: SparkSession, path: str, record: str | None = None) -> DataFrame:
    """The reader of the path's extension; an unknown extension is an error, and so are JSON texts nested too deep or with a name twice."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending in ("csv", "tsv"):
        return read_delimited(spark, path, "," if ending == "csv" else "\t")
    if ending in ("json", "jsonl", "ndjson"):
        from cairn.sources.sheets import json_faults

        faults = [(r.fault, r.n) for r in json_faults(spark, path, ending != "json").collect()]  # three kinds at most
        if faults:
            raise ValueError(f"{path!r} is not taken: {faults}")
        return read_json(spark, path) if ending == "json" else read_lines(spark, path)
    if ending == "xml":
        from cairn.sources.sheets import read_xml_found

        return read_xml(spark, path, record) if record else read_xml_found(spark, path)
    if ending == "xlsx":
        from cairn.sources.sheets import read_sheets

        sheets = read_sheets(spark, path)
        if len(sheets) != 1:
            raise ValueError(f"{path!r} has the sheets {sorted(sheets)}; use read_sheets")
        return next(iter(sheets.values()))
    if ending == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path!r}: csv, tsv, json, jsonl, ndjson, xml, xlsx and parquet are known")


def content_summary(df: DataFrame) -> DataFrame:
    """One row: rows, digest, and per column <name>__nulls and <name>__empties.

    The digest is a sum of row hashes: it does not depend on the order of rows
    and combines before the shuffle.
    """
    counts = []
    for f in df.schema.fields:
        c = col(f.name)
        missing = c.isNull() | F.isnan(c) if is_float(f.dataType) else c.isNull()
        counts.append(F.count_if(missing).alias(f"{f.name}__nulls"))
        counts.append((F.count_if(c == "") if isinstance(f.dataType, T.StringType) else F.lit(0).cast("long")).alias(f"{f.name}__empties"))
    # a null changes a row's hash only through the flags that are hashed beside the values
    flags = F.concat_ws("", *[F.when(col(c).isNull(), "0").otherwise("1") for c in df.columns])
    row = F.xxhash64(flags, *[col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"), *counts)


def write_parquet(df: DataFrame, path: str) -> dict:
    """Writes the rows, reads them again and returns their summary; a difference from the rows' own columns, counts or digest is an error."""
    df.write.option("compression", "snappy").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.columns != df.columns:
        raise ValueError(f"{path!r} has columns {back.columns}, not {df.columns}")
    given, got = (content_summary(x).first().asDict() for x in (df, back))
    if given != got:
        raise ValueError(f"{path!r} holds {got}, not {given}")
    return got


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of tables with the same column names, in the first table's column order; other names are an error."""
    if not frames:
        raise ValueError("no tables")
    if any(set(f.columns) != set(frames[0].columns) for f in frames):
        raise ValueError("the tables have different columns")
    return reduce(lambda a, b: a.unionByName(b), frames)
