"""Charts, evidence, claims and lineage over grouped results. Data stay in DataFrames; only specifications are Python."""

from __future__ import annotations

import hashlib
import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.guards import col, family, finite, is_numeric, kind_of
from cairn.functions.text import canonical_json

# Points and series of a chart, findings of a report, groups below which a finding warns, and tolerances of a claim.
POINTS, SERIES, FINDINGS, FEW = 200, 8, 500, 30
ABSOLUTE, RELATIVE = 1e-12, 1e-9
CHARTS = ("bar", "line", "pie", "scatter")
EXACT_CLAIMS = ("identifier", "boolean", "count", "categorical", "schema")
CLOSE_CLAIMS = ("floating_point", "percentage", "statistical_summary")


def text_ordered(df: DataFrame, dimensions: list[str], limit: int | None = None) -> DataFrame:
    """Groups in the order of their dimensions' texts (10 before 9), nulls first, with their number; the first ``limit``."""
    order = [F.col(f"`{d}`").cast("string").asc_nulls_first() for d in dimensions]
    out = df.orderBy(*order)
    return out.limit(limit) if limit else out


def chart(df: DataFrame, kind: str, x: str, y: str, series: str | None = None, total: bool = False) -> DataFrame:
    """x, y and series of a chart over grouped rows: the first POINTS in order (lines by x, others by the groups' texts); total: with n_points, how many there are.

    Nulls in x or y, a pie with a negative value or no positive total, and more
    than SERIES series are errors; one small aggregate runs.
    """
    if kind not in CHARTS:
        raise ValueError(f"no chart {kind!r}; there are {CHARTS}")
    if not is_numeric(kind_of(df, y)) or (kind == "scatter" and not is_numeric(kind_of(df, x))):
        raise ValueError(f"{y} is no number, or {x} of a scatter chart")
    if kind == "line" and family(kind_of(df, x)) not in ("number", "date", "timestamp"):
        raise ValueError(f"{x} has no order for a line")
    value = finite(df, y).cast("double")
    checks = [F.count_if(col(x).isNull() | value.isNull()).alias("bad"), F.count_if(value < 0).alias("negative"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total")]
    got = df.agg(*checks, *([F.count_distinct(col(series)).alias("series")] if series else [])).first()
    if got["bad"]:
        raise ValueError("a chart needs x and y in all rows")
    if kind == "pie" and (got["negative"] or got["total"] <= 0):
        raise ValueError("a pie needs values that are not negative and a positive total")
    if series and got["series"] > SERIES:
        raise ValueError(f"a chart has at most {SERIES} series")
    own = df.select(col(x).alias("x"), value.alias("y"), (col(series).cast("string") if series else F.lit(None).cast("string")).alias("series"))
    order = [F.col("x")] if kind in ("line", "scatter") else [F.col("x").cast("string")]
    if total:
        own = own.join(F.broadcast(own.agg(F.count(F.lit(1)).alias("n_points"))))
    return own.orderBy(*order, "series", "y").limit(POINTS)


def forecast_chart(observed: DataFrame, forecast: DataFrame) -> DataFrame:
    """month, observed, forecast on one axis; each side is null where only the other has a value."""
    a, b = observed.select("month", F.col("total").alias("observed")), forecast.select("month", "forecast")
    return a.join(b, "month", "full").select("month", "observed", "forecast")


def evidence_findings(df: DataFrame, dimensions: list[str], metrics: list[str], group_rows: str = "group_rows", total: bool = False) -> DataFrame:
    """One finding per group and metric, the first FINDINGS by scope (total: with n_findings, how many there are): scope, metric, value, n, missing_value, few_rows, finding_id (a digest of what it says)."""
    scope = canonical_json({d: col(d).cast("string") for d in dimensions}) if dimensions else F.lit("{}")
    rows = df.select(scope.alias("scope"), col(group_rows).alias("n"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), finite(df, m).cast("double").alias("value")) for m in metrics])).alias("m"))
    out = rows.select("scope", "m.metric", "m.value", "n", F.col("m.value").isNull().alias("missing_value"), (F.col("n") < FEW).alias("few_rows"))
    if total:
        out = out.join(F.broadcast(out.agg(F.count(F.lit(1)).alias("n_findings"))))
    return out.withColumn("finding_id", F.substring(F.sha2(F.concat_ws("|", "metric", "scope"), 256), 1, 32)).orderBy("scope", "metric").limit(FINDINGS)


def verified_claims(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """key, verdict (supported, contradicted or unverifiable) and difference of claims against evidence.

    ``claims`` has key, value_type, value (double) and precision (decimal places
    of financial claims), ``evidence`` key and expected. Exact types must be
    equal; close ones within 1e-12 or 1e-9 of the expected value; financial
    ones within half a unit of their last place; others are not verifiable.
    """
    both = claims.join(evidence.select(col(key), F.col("expected").cast("double")), key, "left")
    d = F.abs(F.col("value") - F.col("expected"))
    close = d <= F.greatest(F.lit(ABSOLUTE), F.lit(RELATIVE) * F.abs("expected"))
    money = F.col("precision").between(0, 9) & (d <= F.pow(F.lit(10.0), -F.col("precision")) / 2)
    ok = F.when(F.col("value_type").isin(*EXACT_CLAIMS), d == 0).when(F.col("value_type").isin(*CLOSE_CLAIMS), close).when(F.col("value_type") == "financial", money)
    verdict = F.when(ok.isNull(), "unverifiable").when(ok, "supported").otherwise("contradicted")
    return both.select(col(key), "value_type", verdict.alias("verdict"), d.alias("difference"))


def promotion(candidate: float | None, baseline: float | None, direction: str, n: int, least: int) -> str:
    """eligible_for_human_review if the candidate is better on enough rows, else not_recommended; nothing is promoted by itself."""
    usable = all(isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < float("inf") for v in (candidate, baseline))
    if not usable or n < least:
        return "not_recommended"
    better = candidate < baseline if direction == "minimize" else candidate > baseline
    return "eligible_for_human_review" if better else "not_recommended"


def operation_id(record: dict) -> str:
    """The digest of a lineage record without its own id."""
    body = {k: v for k, v in record.items() if k != "operation_id"}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def lineage(operation: str, parents: list[dict], details: dict) -> dict:
    """A record of an operation on the results of others; its id is the digest of all it says, so an edit shows."""
    record = {"operation": operation, "parents": sorted(p["operation_id"] for p in parents), "details": details}
    return record | {"operation_id": operation_id(record)}


def lineage_faults(records: list[dict]) -> list[str]:
    """Ids of records that were edited, name a parent that is not there, or lead back to themselves."""
    known = {r["operation_id"]: r for r in records}
    bad = {i for i, r in known.items() if operation_id(r) != i or any(p not in known for p in r["parents"])}
    state: dict[str, int] = {}

    def visit(i: str) -> bool:
        if state.get(i) == 1:
            return False
        if i not in state and i in known:
            state[i] = 1
            if not all(visit(p) for p in known[i]["parents"]):
                bad.add(i)
            state[i] = 2
        return True

    for i in known:
        visit(i)
    return sorted(bad)


def plan_order(steps: dict[str, list[str]], most: int = 5, depth: int = 4) -> list[str]:
    """The steps of an analysis in an order in which each follows those it needs; at most ``most`` steps and ``depth`` levels."""
    if len(steps) > most:
        raise ValueError(f"a plan has at most {most} steps")
    level: dict[str, int] = {}
    while len(level) < len(steps):
        ready = {s: 1 + max((level[n] for n in needs), default=0) for s, needs in steps.items() if s not in level and all(n in level for n in needs)}
        if not ready:
            raise ValueError("steps need each other or one that is not there")
        level |= ready
    if max(level.values(), default=0) > depth:
        raise ValueError(f"a plan has at most {depth} levels")
    return sorted(level, key=lambda s: (level[s], s))


def pair_kind(df: DataFrame, a: str, b: str) -> str:
    """numeric_numeric, numeric_categorical, categorical_categorical or unsupported."""
    def kind(c: str) -> str:
        f = family(kind_of(df, c))
        return "numeric" if f == "number" else "categorical" if f in ("string", "boolean") else "other"

    kinds = sorted((kind(a), kind(b)), reverse=True)
    return "unsupported" if "other" in kinds else "_".join(kinds)


def chosen_pairs(df: DataFrame, columns: list[str] | None = None, most: int = 20) -> list[tuple[str, str, str]]:
    """The first ``most`` pairs of columns in lexical order that have a statistic, with their kind."""
    pairs = [(a, b, pair_kind(df, a, b)) for a, b in combinations(sorted(columns or df.columns), 2)]
    return [p for p in pairs if p[2] != "unsupported"][:most]


def pair_counts(df: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """a, b, kind, n_valid: in how many rows both columns of each chosen pair have a usable value, from one aggregate."""
    value = lambda c: finite(df, c)
    one = df.agg(*[F.count_if(value(a).isNotNull() & value(b).isNotNull()).alias(f"p{i}") for i, (a, b, _) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("kind"), F.col(f"p{i}").alias("n_valid")) for i, (a, b, k) in enumerate(pairs)])))


def linked_profile(profile: DataFrame, stored: DataFrame, findings: DataFrame) -> DataFrame:
    """column_name, reused (the stored profile has the same row, null and empty counts), n_findings on the same column."""
    same = ["column_name", "n_rows", "n_null", "n_empty"]
    known = stored.select(*same).withColumn("reused", F.lit(True))
    found = findings.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_findings"))
    out = profile.select(*same).join(known, same, "left").join(found, "column_name", "left")
    return out.select("column_name", F.coalesce("reused", F.lit(False)).alias("reused"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def guarded_ratio(a: Column, b: Column, digits: int = 2) -> Column:
    """100 * a / b rounded, null where b is 0."""
    return F.round(F.try_divide(100.0 * a, b.cast("double")), digits)


def growth(df: DataFrame, order: str, value: str) -> DataFrame:
    """order, value, change (percent against the row before) over a short ordered series."""
    w = Window.orderBy(order)
    last = F.lag(value).over(w)
    return df.select(order, value, (100.0 * F.try_divide(F.col(value) - last, F.abs(last))).alias("change"))


def compound_growth(first: Column, last: Column, periods: Column) -> Column:
    """(last / first) ** (1 / periods) - 1 of positive values, else null."""
    return F.when((first > 0) & (last > 0) & (periods > 0), F.pow(last / first, 1 / periods) - 1)


#: Measures by name: an aggregate over columns that the caller names, and what these stand for.
MEASURES = {
    "revenue": ("sum({price})", "sum of prices"),
    "net_revenue": ("sum({price} * (1 - {discount}))", "prices after discount"),
    "discount_rate": ("100 * try_divide(sum({price} * {discount}), sum({price}))", "discount as percent of prices"),
    "units": ("sum({quantity})", "sum of quantities"),
    "average_price": ("try_divide(sum({price}), sum({quantity}))", "price of a unit"),
    "lines": ("count(1)", "rows"),
    "return_rate": ("100 * try_divide(count_if({returned}), count(1))", "rows returned, in percent"),
    "returned_value": ("coalesce(sum(CASE WHEN {returned} THEN {price} END), 0)", "prices of what was returned"),
    "largest_line": ("max({price})", "largest price"),
    "price_spread": ("stddev_samp({price})", "sample deviation of prices"),
}


def measures(df: DataFrame, names: list[str], columns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """The named measures of each group; ``columns`` says which expression stands for price, discount, quantity and returned."""
    unknown = [n for n in names if n not in MEASURES]
    if unknown:
        raise ValueError(f"no measure {unknown}; there are {sorted(MEASURES)}")
    return df.groupBy(*(by or [])).agg(*[F.expr(MEASURES[n][0].format(**columns)).alias(n) for n in names])
