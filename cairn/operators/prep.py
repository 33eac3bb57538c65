"""Preparation steps as fit and transform: statistics are learned on one frame and applied to any with the same columns."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.functions.guards import col, finite, is_float, is_numeric, kind_of
from cairn.functions.predicates import ORDERED, Predicate, literal, rule_filter, rule_review
from cairn.operators.ranks import percentiles


@dataclass(frozen=True)
class Fitted:
    """A step with what it has learned; it applies only to frames whose columns have the types it was fitted on."""

    operator: str
    config: dict
    learned: dict = field(default_factory=dict)
    types: dict = field(default_factory=dict)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.operator, self.config, self.learned, self.types], sort_keys=True, default=str).encode()).hexdigest()

    def transform(self, df: DataFrame) -> DataFrame:
        for c, kind in self.types.items():
            if kind_of(df, c).simpleString() != kind:
                raise ValueError(f"{c} is {kind_of(df, c).simpleString()}, fitted on {kind}")
        return OPERATORS[self.operator][1](df, self.config, self.learned)


def fit(df: DataFrame, operator: str, **config: Any) -> Fitted:
    """Learns what the operator needs from ``df`` (one aggregate at most)."""
    if operator not in OPERATORS:
        raise ValueError(f"no operator {operator!r}; there are {sorted(OPERATORS)}")
    columns = config.get("columns") or []
    return Fitted(operator, config, OPERATORS[operator][0](df, config), {c: kind_of(df, c).simpleString() for c in columns})


def _nothing(df: DataFrame, config: dict) -> dict:
    return {}


def _numbers(df: DataFrame, columns: list[str]) -> None:
    for c in columns:
        if not is_numeric(kind_of(df, c)):
            raise ValueError(f"{c} is no number")


def _one(df: DataFrame, columns: dict[str, Column]) -> dict:
    return df.agg(*[c.alias(n) for n, c in columns.items()]).first().asDict() if columns else {}


def _strings(df: DataFrame, config: dict, learned: dict) -> DataFrame:
    """Trims Unicode white space, changes case (lower or upper), turns empty texts into null."""
    out = {}
    for name in config["columns"]:
        c = text.trim(col(name)) if config.get("trim", True) else col(name)
        if config.get("case"):
            c = {"lower": F.lower, "upper": F.upper}[config["case"]](c)
        out[name] = F.when(c != "", c) if config.get("empty_to_null") else c
    return df.withColumns(out)


def _fit_missing(df: DataFrame, config: dict) -> dict:
    strategy, columns = config["strategy"], config["columns"]
    if strategy in ("mean", "median"):
        _numbers(df, columns)
        if strategy == "mean":
            return _one(df, {c: F.avg(finite(df, c).cast("double")) for c in columns})
        return {c: q and q[0] for c, q in percentiles(df, {c: finite(df, c) for c in columns}, [0.5]).first().asDict().items()}
    if strategy == "most_frequent":
        return _one(df, {c: F.mode(col(c), True) for c in columns})
    return {}


def _missing(df: DataFrame, config: dict, learned: dict) -> DataFrame:
    """strategy: leave, drop_rows, constant (value), mean, median or most_frequent."""
    strategy, columns = config["strategy"], config["columns"]
    if strategy == "leave":
        return df
    if strategy == "drop_rows":
        return df.na.drop(subset=columns)
    if strategy == "constant":
        return df.withColumns({c: F.coalesce(col(c), literal(kind_of(df, c), config["value"])) for c in columns})
    if strategy in ("mean", "median"):
        return df.withColumns({c: F.coalesce(finite(df, c).cast("double"), F.lit(learned[c])) for c in columns})
    return df.withColumns({c: F.coalesce(col(c), F.lit(learned[c])) for c in columns})


def _fit_clip(df: DataFrame, config: dict) -> dict:
    columns = config["columns"]
    _numbers(df, columns)
    if config["strategy"] == "clip_bounds":
        return {c: [config["lower"], config["upper"]] for c in columns}
    got = _one(df, {f"n:{c}": F.count(finite(df, c)) for c in columns}) | percentiles(df, {c: finite(df, c) for c in columns}, [0.25, 0.75]).first().asDict()
    out = {}
    for c in columns:
        if got[f"n:{c}"] < 4:
            raise ValueError(f"{c} has fewer than 4 values")
        (low, high), k = got[c], config.get("multiplier", 1.5)
        out[c] = [low - k * (high - low), high + k * (high - low)]
    return out


def _clip(df: DataFrame, config: dict, learned: dict) -> DataFrame:
    """Values beyond the bounds become the bounds; null stays null."""
    out = {}
    for c, (low, high) in learned.items():
        x = col(c).cast("double")
        out[c] = F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)
    return df.withColumns(out)


def _fit_scale(df: DataFrame, config: dict) -> dict:
    columns = config["columns"]
    _numbers(df, columns)
    a, b = (F.avg, F.stddev_pop) if config["strategy"] == "standard" else (F.min, F.max)
    got = _one(df, {f"a:{c}": a(finite(df, c).cast("double")) for c in columns} | {f"b:{c}": b(finite(df, c).cast("double")) for c in columns})
    return {c: [got[f"a:{c}"], got[f"b:{c}"]] for c in columns}


def _scale(df: DataFrame, config: dict, learned: dict) -> DataFrame:
    """standard: by mean and population deviation (0 for a constant); min_max: to [low, high], not clipped."""
    out, (low, high) = {}, config.get("target", (0.0, 1.0))
    for c, (a, b) in learned.items():
        x = col(c).cast("double")
        if a is None:
            out[c] = x
        elif config["strategy"] == "standard":
            out[c] = F.when(x.isNotNull(), (x - a) / b if b else F.lit(0.0))
        else:
            out[c] = F.when(x.isNotNull(), low + (x - a) / (b - a) * (high - low) if b > a else F.lit(float(low)))
    return df.withColumns(out)


def _filter(df: DataFrame, config: dict, learned: dict) -> DataFrame:
    return rule_filter(df, [Predicate(**p) if isinstance(p, dict) else p for p in config["predicates"]], config.get("composition", "all"), config.get("null_policy", "exclude"))


def _mapping(df: DataFrame, config: dict, learned: dict) -> DataFrame:
    """Replaces values by a mapping; unmapped and null values: preserve, constant or error."""
    (name,) = config["columns"]
    c, mapping = col(name), config["mapping"]
    found = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[c] if mapping else F.lit(None)

    def policy(kind: str) -> Column:
        what = config.get(kind, "preserve")
        if what == "error":
            return F.raise_error(F.lit(f"{name} has a value that is {kind}")).cast(df.schema[name].dataType)
        return F.lit(config[f"{kind}_value"]) if what == "constant" else c

    return df.withColumn(name, F.when(c.isNull(), policy("null")).when(found.isNotNull(), found).otherwise(policy("unmapped")))


def _derived(df: DataFrame, config: dict, learned: dict) -> DataFrame:
    """name = left operation right as double; division by zero is null or an error, other results that are not finite are errors."""
    if config["name"] in df.columns:
        raise ValueError(f"{config['name']} exists")
    a, b = (col(config[k]).cast("double") for k in ("left", "right"))
    op = config["operation"]
    if op == "divide":
        zero = F.raise_error(F.lit("division by zero")).cast("double") if config.get("zero", "null") == "error" else F.lit(None).cast("double")
        value = F.when(b == 0, zero).otherwise(F.try_divide(a, b))
    else:
        value = {"add": a + b, "subtract": a - b, "multiply": a * b}[op]
    wrong = F.isnan(value) | (F.abs(value) == float("inf"))
    return df.withColumn(config["name"], F.when(wrong, F.raise_error(F.lit("the result is not finite")).cast("double")).otherwise(value))


def _unchanged(df: DataFrame, config: dict, learned: dict) -> DataFrame:
    return df


#: name -> (fit, transform)
OPERATORS = {
    "string_normalization": (_nothing, _strings),
    "missing_values": (_fit_missing, _missing),
    "outliers": (_fit_clip, _clip),
    "scaling": (_fit_scale, _scale),
    "rule_filter": (_nothing, _filter),
    "category_mapping": (_nothing, _mapping),
    "derived_metric": (_nothing, _derived),
    "rule_validation": (_nothing, _unchanged),
}


def validate(df: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per rule: rule (its number), kind, affected, review (unknown) rows. The data stays as it is.

    Kinds: required; allowed (values); range (lower, upper); compare (left, operator, right).
    """
    masks = []
    for r in rules:
        if r["kind"] == "required":
            ok = col(r["column"]).isNotNull()
        elif r["kind"] == "allowed":
            ok = col(r["column"]).isin(*r["values"])
        elif r["kind"] == "range":
            c = finite(df, r["column"])
            ok = (c >= r.get("lower", float("-inf"))) & (c <= r.get("upper", float("inf")))
            if is_float(kind_of(df, r["column"])):
                ok = F.when(col(r["column"]).isNotNull() & c.isNull(), F.lit(False)).otherwise(ok)
        else:
            a, b = col(r["left"]), col(r["right"])
            ok = a == b if r["operator"] == "eq" else ORDERED[r["operator"]](a, b)
        masks.append(ok)
    counts = df.agg(*[F.struct(F.count_if(~m).alias("affected"), F.count_if(m.isNull()).alias("review")).alias(str(i)) for i, m in enumerate(masks)])
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("rule"), F.lit(r["kind"]).alias("kind"), F.col(f"`{i}`.affected").alias("affected"), F.col(f"`{i}`.review").alias("review")) for i, r in enumerate(rules)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@dataclass
class PlanResult:
    frames: dict[str, DataFrame]
    fitted: list[Fitted]
    lineage: list[dict]


def run_plan(train: DataFrame, steps: list[dict], evaluation: DataFrame | None = None) -> PlanResult:
    """Fits each step on the training frame as the steps before have left it, and applies it to both frames.

    Nothing is learned from the evaluation frame. Stops at the first step that
    fails; later ones are marked not_executed. Frames stay lazy.
    """
    frames = {"train": train} | ({"evaluation": evaluation} if evaluation is not None else {})
    for s in steps:
        if s.get("operator") not in OPERATORS:
            raise ValueError(f"no operator {s.get('operator')!r}")
    fitted, lineage, failed = [], [], False
    for i, s in enumerate(steps):
        entry = {"step": i, "operator": s["operator"], "status": "not_executed"}
        if not failed:
            try:
                f = fit(frames["train"], s["operator"], **{k: v for k, v in s.items() if k != "operator"})
                frames = {k: f.transform(df) for k, df in frames.items()}
                fitted.append(f)
                entry |= {"status": "done", "digest": f.digest()}
            except ValueError as e:
                failed, entry = True, entry | {"status": "failed", "error": str(e)}
        lineage.append(entry)
    return PlanResult(frames, fitted, lineage)


__all__ = ["OPERATORS", "Fitted", "PlanResult", "fit", "rule_review", "run_plan", "validate"]
