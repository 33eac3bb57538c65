"""Expanding-window forecasts against numpy's least squares, many series at once."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import backtests as bt


def matrix(at):
    angle = 2 * np.pi * (at % 12) / 12
    return np.column_stack((np.ones(len(at)), at, np.sin(angle), np.cos(angle)))


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    sizes = {"a": 15, "b": 20, "c": 40, "d": 100, "short": 14, None: 30, "long": 241}
    rows = [(k, 24000 + i, 1e6 + 500 * i + 3e4 * math.sin(i / 2) + rng.gauss(0, 1e4)) for k, n in sizes.items() for i in range(n)]
    rows += [("gap", 24000 + i, 1.0) for i in range(40) if i != 7]
    return spark.createDataFrame(rows, "k string, month long, total double").repartition(5), rows


@pytest.mark.parametrize("horizon", [1, 3, 13])
def test_folds(series, horizon):
    df, rows = series
    got = {(r.k, r.train, r.lead): r for r in bt.expanding_folds(df, ["k"], horizon).collect()}
    want = 0
    for k, n in {"a": 15, "b": 20, "c": 40, "d": 100, None: 30}.items():
        y = np.array([v for x, _, v in rows if x == k])
        folds = min(12, max(0, n - horizon - 12 + 1))
        first = n - horizon - folds + 1
        for origin in range(first, first + folds):
            beta = np.linalg.lstsq(matrix(np.arange(origin)), y[:origin], rcond=None)[0]
            for lead in range(horizon):
                r = got[k, origin, lead + 1]
                assert (r.actual, r.month, r.last_observation) == (y[origin + lead], 24000 + origin + lead, y[origin - 1])
                assert r.predicted == pytest.approx((matrix(np.array([origin + lead])) @ beta)[0], rel=1e-8)
                assert r.seasonal == (y[origin - 12 + lead % 12] if first >= 24 else None)
                want += 1
    assert len(got) == want


def test_scores_envelope_and_warnings(series):
    df, _ = series
    folds = bt.expanding_folds(df, ["k"], 2).collect()
    scores = {(r.k, r.model): r for r in bt.fold_scores(bt.expanding_folds(df, ["k"], 2), ["k"]).collect()}
    for k in ("b", "d"):
        mine = [r for r in folds if r.k == k]
        e = np.array([r.predicted - r.actual for r in mine])
        s = scores[k, "candidate"]
        assert s.mae == pytest.approx(np.abs(e).mean()) and s.rmse == pytest.approx(np.sqrt((e * e).mean())) and s.mean_error == pytest.approx(e.mean())
        assert s.wape == pytest.approx(100 * np.abs(e).sum() / sum(abs(r.actual) for r in mine)) and s.outcome is None
        last = scores[k, "last_observation"]
        assert last.improvement == pytest.approx(last.mae - s.mae) and last.outcome in ("beats_baseline", "within_tolerance", "worse_than_baseline")
        assert ((k, "seasonal_naive_12") in scores) == (k == "d")
    bounds = {(r.k, r.lead): r.bound for r in bt.error_envelope(bt.expanding_folds(df, ["k"], 2), ["k"]).collect()}
    mine = sorted(abs(r.predicted - r.actual) for r in folds if r.k == "d" and r.lead == 2)
    assert bounds["d", 2] == mine[math.ceil(0.9 * len(mine)) - 1] and ("b", 1) not in bounds
    known = {r.k: (r.status, r.n_origins, r.warnings) for r in bt.fold_warnings(df, ["k"], 2).collect()}
    assert known["gap"][0] == "months are missing" and known["short"][0] == "too short" and known["long"][0] == "too long" and known["d"] == ("ok", 12, [])
    assert known["a"][1:] == (2, ["too few origins for an envelope", "fewer than 24 months"])


def test_forecasts(series):
    df, rows = series
    y = np.array([v for x, _, v in rows if x == "c"])
    beta = np.linalg.lstsq(matrix(np.arange(40)), y, rcond=None)[0]
    got = bt.forecasts(df, ["k"], 4).where("k = 'c'").orderBy("lead").collect()
    assert [r.month for r in got] == [24040, 24041, 24042, 24043]
    assert np.allclose([r.predicted for r in got], matrix(np.arange(40, 44)) @ beta)
    assert bt.expanding_folds(df.where(F.lit(False)), ["k"]).isEmpty()
