"""Monthly forecasts of many series at once, each tried from many origins.

The model is least squares on a level, a trend and one yearly cycle. A series'
normal equations up to each month are running sums, so every origin is solved
where its sums are, by a Cholesky decomposition in column expressions: no rows
are collected, and series are told apart by any key columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.guards import col

#: Months before the first origin, most origins, origins that an error envelope needs, its share, and months before the yearly baseline counts.
TRAIN, FOLDS, ENVELOPE, SHARE, YEARS = 12, 12, 8, 0.9, 24
#: Months of a series at the least and at the most, and the longest horizon.
LEAST, MOST, HORIZON = 15, 240, 24
#: How close two mean errors count as the same: a share of the baseline's, and an amount.
RELATIVE, ABSOLUTE = 0.01, 1e-9
#: Below this sum of absolute actuals there is no percentage error.
NEAR_ZERO = 1e-12
_FEATURES = 4


def cycle(index: Column) -> tuple[Column, Column]:
    """Sine and cosine of the place in a year of twelve months."""
    angle = F.lit(2 * math.pi) * F.pmod(index, F.lit(12)) / 12
    return F.sin(angle), F.cos(angle)


def _features(index: Column) -> list[Column]:
    return [F.lit(1.0), index.cast("double"), *cycle(index)]


def indexed(series: DataFrame, keys: list[str], month: str = "month") -> DataFrame:
    """The series with _i (a month's number from 0), _n (months) and _status: ok, too short, too long or months are missing."""
    w = Window.partitionBy(*[col(k) for k in keys])
    n, span = F.count(F.lit(1)).over(w), F.max(month).over(w) - F.min(month).over(w) + 1
    status = F.when(span != n, "months are missing").when(n < LEAST, "too short").when(n > MOST, "too long").otherwise("ok")
    return series.withColumns({"_i": (F.col(month) - F.min(month).over(w)).cast("long"), "_n": n, "_status": status})


def solved(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Indexed rows with _c0 to _c3: the coefficients that fit all months up to the row's own; null where they are not determined."""
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    x, y = _features(F.col("_i")), col(value).cast("double")
    sums = {f"_a{i}{j}": F.sum(x[i] * x[j]).over(w) for i in range(_FEATURES) for j in range(i + 1)}
    df = rows.withColumns(sums | {f"_b{i}": F.sum(x[i] * y).over(w) for i in range(_FEATURES)})
    for j in range(_FEATURES):  # the lower triangle, column by column
        rest = lambda i: F.col(f"_a{i}{j}") - sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))  # noqa: B023, E731
        df = df.withColumn(f"_l{j}{j}", F.when(rest(j) > 1e-12 * F.col(f"_a{j}{j}"), F.sqrt(rest(j))))
        df = df.withColumns({f"_l{i}{j}": rest(i) / F.col(f"_l{j}{j}") for i in range(j + 1, _FEATURES)} or {"_l": F.lit(0)})
    for i in range(_FEATURES):
        df = df.withColumn(f"_z{i}", (F.col(f"_b{i}") - sum((F.col(f"_l{i}{k}") * F.col(f"_z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"_l{i}{i}"))
    for i in reversed(range(_FEATURES)):
        df = df.withColumn(f"_c{i}", (F.col(f"_z{i}") - sum((F.col(f"_l{k}{i}") * F.col(f"_c{k}") for k in range(i + 1, _FEATURES)), F.lit(0.0))) / F.col(f"_l{i}{i}"))
    return df.select(*rows.columns, *[f"_c{i}" for i in range(_FEATURES)])


def _fit(index: Column) -> Column:
    return sum((F.col(f"_c{i}") * x for i, x in enumerate(_features(index))), F.lit(0.0))


def expanding_folds(series: DataFrame, keys: list[str], horizon: int = 1, month: str = "month", value: str = "total") -> DataFrame:
    """keys, train, lead, month, actual, predicted, last_observation, seasonal: up to FOLDS origins of each series, the latest, with every lead.

    train is how many months an origin has seen. seasonal is null for a series
    whose first origin has seen less than YEARS months. Series that are too
    short, too long or lack months have no rows; ``indexed`` says which.
    """
    if not 1 <= horizon <= HORIZON:
        raise ValueError(f"the horizon is 1 to {HORIZON}")
    by = [col(k) for k in keys]
    rows = indexed(series.select(*by, F.col(month).cast("long").alias("month"), col(value).cast("double").alias("value")), keys).where("_status = 'ok'")
    year = Window.partitionBy(*by).orderBy("_i").rowsBetween(-11, 0)
    origins = solved(rows.withColumn("_year", F.collect_list("value").over(year)), keys, "value").withColumn("train", F.col("_i") + 1)
    first = F.col("_n") - horizon - F.least(F.lit(FOLDS), F.col("_n") - horizon - TRAIN + 1) + 1
    origins = origins.where((F.col("_n") - horizon - TRAIN >= 0) & (F.col("train") >= first) & (F.col("train") <= F.col("_n") - horizon))
    leads = origins.select("*", first.alias("_first"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("lead"))
    at = F.col("_i") + F.col("lead")
    seasonal = F.when(F.col("_first") >= YEARS, F.try_element_at("_year", F.pmod(F.col("lead") - 1, F.lit(12)).cast("int") + 1))
    guesses = leads.select(*by, "train", F.col("lead").cast("long").alias("lead"), at.alias("_i"), _fit(at).alias("predicted"), F.col("value").alias("last_observation"), seasonal.alias("seasonal"))
    actual = rows.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_i").alias("_j"), F.col("month"), F.col("value").alias("actual"))
    same = F.col("_i") == F.col("_j")
    for i, k in enumerate(keys):
        same = same & col(k).eqNullSafe(F.col(f"_k{i}"))
    return guesses.join(actual, same).select(*by, "train", "lead", "month", "actual", "predicted", "last_observation", "seasonal")


def _errors(error: Column, actual: Column) -> list[Column]:
    size, total = F.abs(error), F.sum(F.abs(actual))
    return [F.count(error).alias("n"), F.avg(size).alias("mae"), F.avg(error * error).alias("mse"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("mean_error"), F.when(total > NEAR_ZERO, 100 * F.sum(size) / total).alias("wape")]


def fold_scores(folds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, model (candidate or a baseline), n, mae, mse, rmse, mean_error, wape; for baselines improvement (their mae less the candidate's) and outcome."""
    by = [col(k) for k in keys]
    models = {"candidate": "predicted", "last_observation": "last_observation", "seasonal_naive_12": "seasonal"}
    guesses = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in models.items()])).alias("g")
    scores = folds.select(*by, "actual", guesses).where("g.p is not null").groupBy(*by, F.col("g.model").alias("model")).agg(*_errors(F.col("g.p") - F.col("actual"), F.col("actual")))
    own = F.max(F.when(F.col("model") == "candidate", F.col("mae"))).over(Window.partitionBy(*by))  # three rows a series
    better, slack = F.col("mae") - own, F.greatest(F.lit(ABSOLUTE), F.abs("mae") * RELATIVE)
    outcome = F.when(better > slack, "beats_baseline").when(better >= -slack, "within_tolerance").otherwise("worse_than_baseline")
    other = F.col("model") != "candidate"
    return scores.withColumns({"improvement": F.when(other, better), "outcome": F.when(other, outcome)})


def error_envelope(folds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lead, n, bound: the absolute error that SHARE of the origins stay within, for series with ENVELOPE origins or more (at most FOLDS a lead)."""
    errors = F.sort_array(F.collect_list(F.abs(F.col("predicted") - F.col("actual"))))
    out = folds.groupBy(*[col(k) for k in keys], "lead").agg(F.count(F.lit(1)).alias("n"), errors.alias("e")).where(F.col("n") >= ENVELOPE)
    return out.select(*[col(k) for k in keys], "lead", "n", F.col("e")[F.ceil(F.col("n") * SHARE).cast("int") - 1].alias("bound"))


def forecasts(series: DataFrame, keys: list[str], horizon: int = 6, month: str = "month", value: str = "total") -> DataFrame:
    """keys, lead, month, predicted: each series goes on for horizon months from all that it has."""
    by = [col(k) for k in keys]
    rows = indexed(series.select(*by, F.col(month).cast("long").alias("month"), col(value).cast("double").alias("value")), keys).where("_status = 'ok'")
    last = solved(rows, keys, "value").where("_i = _n - 1").select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("lead"))
    return last.select(*by, F.col("lead").cast("long").alias("lead"), (F.col("month") + F.col("lead")).alias("month"), _fit(F.col("_i") + F.col("lead")).alias("predicted"))


def fold_warnings(series: DataFrame, keys: list[str], horizon: int = 1, month: str = "month") -> DataFrame:
    """keys, n_months, status, n_origins, and warnings: what limits a series' evaluation."""
    by = [col(k) for k in keys]
    one = indexed(series, keys, month).groupBy(*by).agg(F.max("_n").alias("n_months"), F.max("_status").alias("status"))
    origins = F.when(F.col("status") == "ok", F.greatest(F.lit(0), F.least(F.lit(FOLDS), F.col("n_months") - horizon - TRAIN + 1))).otherwise(0).cast("long")
    warnings = {"no origin has enough months": F.col("n_origins") == 0, "too few origins for an envelope": F.col("n_origins").between(1, ENVELOPE - 1), "fewer than 24 months": F.col("n_months") < YEARS}
    return one.withColumn("n_origins", origins).withColumn("warnings", F.array_compact(F.array(*[F.when(on, w) for w, on in warnings.items()])))
