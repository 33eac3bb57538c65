"""Monthly series: sums, gaps, baselines, hold-out and backtest errors, and a seasonal least-squares forecast.

Everything that grows with the input happens in one aggregation by month; what
follows has one row per month.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.guards import col, finite
from cairn.functions.text import month_label, month_ordinal

#: Months that a forecast needs, at the least and at the most, and its longest horizon.
LEAST, MOST, HORIZON = 15, 240, 24


def monthly(df: DataFrame, time: str, value: str) -> DataFrame:
    """month (year * 12 + month - 1), label, total, n_rows."""
    x = finite(df, value).cast("double")
    sums = df.where(col(time).isNotNull()).groupBy(month_ordinal(col(time)).alias("month")).agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n_rows"))
    return sums.withColumn("label", month_label(F.col("month")))


def gaps(series: DataFrame) -> DataFrame:
    """after, before, missing: neighbouring months with others missing in between."""
    w = Window.orderBy("month")  # one row a month
    step = series.select("month", F.lag("month").over(w).alias("after"))
    return step.where("month - after > 1").select("after", F.col("month").alias("before"), (F.col("month") - F.col("after") - 1).alias("missing"))


def seasonal_naive(series: DataFrame, season: int = 12) -> DataFrame:
    """month, total, naive (last month), seasonal (the same month a season ago)."""
    w = Window.orderBy("month")
    return series.select("month", "total", F.lag("total").over(w).alias("naive"), F.lag("total", season).over(w).alias("seasonal"))


def errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, mae, mse, rmse, bias, wape (percent; null for all-zero actuals)."""
    a, e = col(actual).cast("double"), col(predicted).cast("double") - col(actual).cast("double")
    both = df.where(col(actual).isNotNull() & col(predicted).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (100 * F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(a)))).alias("wape"))


def holdout(series: DataFrame, share: float = 0.2, least: int = 3) -> DataFrame:
    """The series with ``test``: its last months, a share of them and at least three."""
    w = Window.orderBy(F.desc("month"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return series.withColumn("test", F.row_number().over(w) <= F.greatest(F.lit(least), F.ceil(n * share)))


def backtest(series: DataFrame, origins: int = 12) -> DataFrame:
    """origin, month, total and naive for the last origins: each forecasts the next month from what it has seen."""
    w = Window.orderBy("month")
    seen = series.select(F.lag("month").over(w).alias("origin"), "month", "total", F.lag("total").over(w).alias("naive"), F.row_number().over(Window.orderBy(F.desc("month"))).alias("nth"))
    return seen.where((F.col("nth") <= origins) & F.col("origin").isNotNull()).drop("nth")


def backtest_trend(series: DataFrame, origins: int = 12) -> DataFrame:
    """origin, month, total, predicted and error for the last origins: each month from the straight line through all months before it."""
    w = Window.orderBy("month")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    slope, level = F.regr_slope("total", "month").over(past), F.regr_intercept("total", "month").over(past)
    seen = series.select(F.lag("month").over(w).alias("origin"), "month", "total", (level + slope * F.col("month")).alias("predicted"), F.row_number().over(Window.orderBy(F.desc("month"))).alias("nth"))
    return seen.where((F.col("nth") <= origins) & F.col("predicted").isNotNull()).drop("nth").withColumn("error", F.col("predicted") - F.col("total"))


def encode_model(model: dict) -> bytes:
    """A model's values as packed JSON behind the SHA-256 of that JSON."""
    body = json.dumps(model, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()
    return hashlib.sha256(body).digest() + zlib.compress(body)


def decode_model(data: bytes) -> dict:
    """The values of an encoded model; one whose digest does not fit is an error."""
    body = zlib.decompress(data[32:])
    if hashlib.sha256(body).digest() != data[:32]:
        raise ValueError("the model's digest does not fit")
    return json.loads(body)


@dataclass(frozen=True)
class Forecast:
    months: list[int]
    values: list[float]
    holdout_mae: float
    baseline_mae: float
    verdict: str
    envelope: float | None
    warnings: list[str]


def _features(months: np.ndarray, first: int) -> np.ndarray:
    angle = 2 * math.pi * (months % 12) / 12
    return np.column_stack((np.ones(len(months)), months - first, np.sin(angle), np.cos(angle)))


def forecast(series: DataFrame, horizon: int = 6) -> Forecast:
    """Least squares on trend and yearly sine and cosine, held against the better of two baselines on the last fifth."""
    if not 1 <= horizon <= HORIZON:
        raise ValueError(f"the horizon is 1 to {HORIZON}")
    rows = series.select("month", "total").orderBy("month").limit(MOST + 1).collect()
    if not LEAST <= len(rows) <= MOST:
        raise ValueError(f"{LEAST} to {MOST} months are needed")
    months, y = np.array([r.month for r in rows]), np.array([r.total for r in rows], float)
    if (np.diff(months) != 1).any():
        raise ValueError("months are missing")
    first, n = months[0], max(3, math.ceil(len(y) / 5))

    def predict(train: int, at: np.ndarray) -> np.ndarray:
        beta = np.linalg.lstsq(_features(months[:train], first), y[:train], rcond=None)[0]
        return _features(at, first) @ beta

    cut = len(y) - n
    mae = float(np.abs(predict(cut, months[cut:]) - y[cut:]).mean())
    naive = float(np.abs(y[cut - 1] - y[cut:]).mean())
    season = float(np.abs(np.array([y[cut - 12 + i % 12] for i in range(n)]) - y[cut:]).mean()) if cut >= 12 else math.inf
    best = min(naive, season)
    slack = max(1e-9, 0.01 * best)
    verdict = "beats" if mae < best - slack else "within" if mae <= best + slack else "worse"
    steps = [abs(float(predict(t, months[t : t + 1])[0]) - y[t]) for t in range(max(LEAST - n, len(y) - 12), len(y))]
    warnings = [w for w, on in (("fewer than 24 months", len(y) < 24), ("the horizon is longer than the hold-out", horizon > n), ("the series hardly varies", float(y.std()) < 1e-9 * max(1.0, abs(float(y.mean()))))) if on]
    ahead = months[-1] + 1 + np.arange(horizon)
    return Forecast(ahead.tolist(), predict(len(y), ahead).tolist(), mae, best, verdict, float(np.quantile(steps, 0.9)) if len(steps) >= 8 else None, warnings)
