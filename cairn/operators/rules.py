"""A registry of quality rules, what a plan of them still needs, and findings with stable ids."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.guards import col, finite, is_float, is_numeric, kind_of
from cairn.operators import quality

FINDING = "rule_id string, column_name string, affected long, total long"
SCALES = ((0.0, "none"), (0.01, "low"), (0.1, "medium"), (1.01, "high"))


@dataclass(frozen=True)
class Rule:
    """run(df, config) gives rows of FINDING; needs: what the config must hold; schema: name -> (type, least, most) of its values."""

    rule_id: str
    run: Callable[[DataFrame, dict], DataFrame]
    needs: tuple[str, ...] = ()
    schema: dict = field(default_factory=dict)


def config_faults(schema: dict, config: dict) -> list[str]:
    """What is wrong with a configuration: unknown names, wrong types, values out of range."""
    out = [f"{k}: unknown" for k in sorted(config.keys() - schema.keys())]
    for k, (kind, low, high) in sorted(schema.items()):
        if k not in config:
            continue
        v = config[k]
        if not isinstance(v, kind) or (isinstance(v, bool) and kind is not bool):
            out.append(f"{k}: wrong type")
        elif low is not None and not low <= (len(v) if isinstance(v, (str, list)) else v) <= high:
            out.append(f"{k}: not within {low} and {high}")
    return out


def _columns(df: DataFrame, accept) -> list[str]:
    return [c for c in df.columns if accept(kind_of(df, c))]


def _finding(rule_id: str, rows: DataFrame, affected: str = "affected", total: str = "total") -> DataFrame:
    return rows.select(F.lit(rule_id).alias("rule_id"), "column_name", F.col(affected).cast("long").alias("affected"), F.col(total).cast("long").alias("total"))


def _missing(df: DataFrame, config: dict) -> DataFrame:
    out = quality.missing(df)
    return _finding("missing_values", out.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))))


def _whitespace(df: DataFrame, config: dict) -> DataFrame:
    columns = _columns(df, lambda k: isinstance(k, T.StringType))
    if not columns:
        return df.sparkSession.createDataFrame([], FINDING)
    values = df.agg(*[F.count(col(c)).alias(f"total:{c}") for c in columns])
    totals = values.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`total:{c}`").alias("total")) for c in columns])).alias("r")).select("r.*")
    return _finding("whitespace", quality.whitespace(df, columns).join(F.broadcast(totals), "column_name"))


def _nonfinite(df: DataFrame, config: dict) -> DataFrame:
    columns = _columns(df, is_float)
    return _finding("non_finite", quality.nonfinite(df, columns), total="n_values") if columns else df.sparkSession.createDataFrame([], FINDING)


def _constant(df: DataFrame, config: dict) -> DataFrame:
    out = quality.constant_columns(df).withColumn("affected", F.when(F.col("constant"), F.col("n_values")).otherwise(0))
    return _finding("constant_column", out, total="n_values")


def _duplicates(df: DataFrame, config: dict) -> DataFrame:
    return _finding("duplicate_rows", quality.duplicate_rows(df).withColumn("column_name", F.lit(None).cast("string")), "n_duplicates", "n_rows")


def _key(df: DataFrame, config: dict) -> DataFrame:
    out = quality.business_key_duplicates(df, config["key"]).withColumn("column_name", F.lit(",".join(config["key"])))
    return _finding("business_key", out, "n_duplicates", "n_keyed")


def _outliers(df: DataFrame, config: dict) -> DataFrame:
    frames = []
    for c in config.get("columns") or _columns(df, is_numeric):
        n = df.agg(F.count(finite(df, c)).alias("total"))
        found = quality.outliers(df, c, config.get("method", "iqr"), config.get("threshold", 1.5)).agg(F.count(F.lit(1)).alias("affected"))
        frames.append(found.join(F.broadcast(n)).withColumn("column_name", F.lit(c)))
    return _finding("outliers", reduce(DataFrame.unionByName, frames)) if frames else df.sparkSession.createDataFrame([], FINDING)


REGISTRY = {
    r.rule_id: r
    for r in (
        Rule("missing_values", _missing), Rule("whitespace", _whitespace), Rule("non_finite", _nonfinite), Rule("constant_column", _constant), Rule("duplicate_rows", _duplicates),
        Rule("business_key", _key, ("key",), {"key": (list, 1, 8)}),
        Rule("outliers", _outliers, (), {"columns": (list, 1, 256), "method": (str, 3, 6), "threshold": (float, 0.1, 10.0)}),
    )
}


def plan(configs: dict[str, dict]) -> list[dict]:
    """For each rule of the registry whether it is ready, needs context or has a wrong configuration. Nothing runs."""
    out = []
    for rule_id, r in sorted(REGISTRY.items()):
        config = configs.get(rule_id, {})
        absent, faults = [n for n in r.needs if n not in config], config_faults(r.schema, config)
        out.append({"rule_id": rule_id, "status": "invalid" if faults else "needs_context" if absent else "ready", "missing": absent, "faults": faults})
    return out


#: Columns that a rule looks at; rules that are not named look at all.
_LOOKS_AT = {"whitespace": lambda k: isinstance(k, T.StringType), "non_finite": is_float, "outliers": is_numeric}


def planned(df: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """rule_id, status, n_columns, n_values: the plan for a table, with how many of its columns and values each rule would look at.

    A rule that is ready but has no column to look at is not_applicable. One
    aggregate counts the values of all columns.
    """
    counts = df.agg(*[F.count(col(c)).alias(c) for c in df.columns])
    own = {r["rule_id"]: [c for c in df.columns if _LOOKS_AT.get(r["rule_id"], lambda k: True)(kind_of(df, c))] for r in plan(configs)}
    rows = []
    for r in plan(configs):
        columns = own[r["rule_id"]]
        status = "not_applicable" if r["status"] == "ready" and not columns else r["status"]
        n_values = sum((col(c) for c in columns), F.lit(0)).cast("long")
        rows.append(F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(status).alias("status"), F.lit(len(columns)).cast("long").alias("n_columns"), n_values.alias("n_values")))
    return counts.select(F.inline(F.array(*rows)))


def findings(df: DataFrame, configs: dict[str, dict], table: str) -> DataFrame:
    """Findings of all rules that are ready, with affected > 0: finding_id, rule_id, column_name, affected, total, severity, in scope order.

    The id is a digest of table, rule and column, so it stays the same from run to run.
    """
    ready = [p["rule_id"] for p in plan(configs) if p["status"] == "ready"]
    rows = reduce(DataFrame.unionByName, [REGISTRY[r].run(df, configs.get(r, {})) for r in ready]).where("affected > 0")
    share = F.col("affected") / F.greatest(F.col("total"), F.lit(1))
    severity = F.lit("high")
    for limit, name in reversed(SCALES[1:3]):
        severity = F.when(share < limit, name).otherwise(severity)
    out = rows.withColumn("severity", severity).withColumn("finding_id", F.substring(F.sha2(F.concat_ws("|", F.lit(table), "rule_id", F.coalesce("column_name", F.lit(""))), 256), 1, 32))
    return out.select("finding_id", "rule_id", "column_name", "affected", "total", "severity").orderBy("rule_id", F.col("column_name").asc_nulls_first())
