"""Exact percentiles, ranks, ranking scores and correlations against numpy; similar texts against every pair."""

import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import corpus, explore, intake, ranks, scoring


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, float("nan"), float("inf"), round(rng.gauss(1e6, 3), 1)]) if i % 5 == 0 else round(rng.gauss(1e6, 3), 1), rng.randrange(4) * 1.0, rng.choice("ab")) for i in range(3000)]
    return spark.createDataFrame(rows, "i long, x double, y double, c string").repartition(7).cache(), rows


def test_percentiles(table):
    df, rows = table
    x = [r[1] for r in rows if r[1] is not None and np.isfinite(r[1])]
    got = ranks.percentiles(df, {"x": F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x")), "y": F.col("y"), "none": F.lit(None).cast("double")}, [0.0, 0.05, 0.5, 0.77, 1.0]).first()
    assert np.allclose(got.x, np.percentile(x, [0, 5, 50, 77, 100])) and np.allclose(got.y, np.percentile([r[2] for r in rows], [0, 5, 50, 77, 100]))
    assert got.none is None and ranks.percentiles(df.limit(0), {"x": F.col("x")}, [0.5]).first().x is None
    by = {r.c: r.q[0] for r in ranks.percentiles_by(df.select("c", "y"), ["c"], "y", [0.5]).collect()}
    assert by == {k: np.median([r[2] for r in rows if r[3] == k]) for k in "ab"}


def test_average_ranks(table):
    df, rows = table
    got = {r.y: r["rank"] for r in ranks.average_ranks(df.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "y").collect()}
    values = np.array([r[2] for r in rows])
    assert got == {v: (values < v).sum() + ((values == v).sum() + 1) / 2 for v in set(values.tolist())}


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_many_parts_need_no_reused_exchange(spark, table, monkeypatch, reuse):
    df, rows = table
    monkeypatch.setattr(ranks, "PART", 7)
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        x = [r[1] for r in rows if r[1] is not None and np.isfinite(r[1])]
        for parts in (3, 11):
            some = df.repartition(parts)
            assert np.allclose([explore.numeric_summary(some, "x").first()[f"p{p}"] for p in (5, 50, 95)], np.percentile(x, [5, 50, 95]))
            by = {r.category: r.median for r in explore.group_summary(some, "c", "x").collect()}
            assert by == pytest.approx({k: np.median([r[1] for r in rows if r[3] == k and r[1] is not None and np.isfinite(r[1])]) for k in "ab"})
            ranked = {r.x: r["rank"] for r in ranks.average_ranks(some.where("not isnan(x) and abs(x) < 1e300").groupBy("x").agg(F.count(F.lit(1)).alias("n")), "x").collect()}
            values = np.array(x)
            assert all(ranked[v] == (values < v).sum() + ((values == v).sum() + 1) / 2 for v in set(x[:200]))
            m = np.median(values)
            mad = 1.4826 * np.median(np.abs(values - m))
            got = {(r.key, round(r.score, 6)) for r in explore.anomalies(some, "i", "x", 2.5).collect()}
            assert got == {(r[0], round(abs(r[1] - m) / mad, 6)) for r in rows if r[1] is not None and np.isfinite(r[1]) and abs(r[1] - m) / mad > 2.5}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_correlation_matrix(table):
    df, rows = table
    got = {(r.x, r.y): (r.pearson, r.n) for r in explore.correlation_matrix(df.withColumn("z", F.lit(3.0)), ["x", "y", "z"]).collect()}
    both = np.array([(r[1], r[2]) for r in rows if r[1] is not None and np.isfinite(r[1])])
    assert got["x", "y"][1] == len(both) and abs(got["x", "y"][0] - np.corrcoef(both.T)[0, 1]) < 1e-9
    assert abs(got["x", "x"][0] - 1) < 1e-9 and got["z", "z"][0] is None and got["x", "z"][0] is None and len(got) == 6


def test_ranking_scores(spark):
    rng = random.Random(6)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(400)]
    got = scoring.ranking_scores(spark.createDataFrame([*rows, (None, 0.5), (1, None)], "y int, p double"), "y", "p").first()
    pos, neg = ([p for y, p in rows if y == k] for k in (1, 0))
    area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    steps = sum(sum(p == t for p in pos) / len(pos) * sum(p >= t for p in pos) / sum(p >= t for _, p in rows) for t in {p for _, p in rows})
    assert abs(got.roc_auc - area) < 1e-9 and abs(got.average_precision - steps) < 1e-9 and abs(got.brier - np.mean([(p - y) ** 2 for y, p in rows])) < 1e-9
    one = scoring.ranking_scores(spark.createDataFrame([(1, 0.5)], "y int, p double"), "y", "p").first()
    assert one.roc_auc is None and one.average_precision is None


def test_similar_texts_lose_no_pair(spark):
    rng = random.Random(9)
    words = "show sum of sales by region month year customer top ten average".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 9))) + rng.choice("?!. ") for _ in range(60)] + ["", None, "Ä ö"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, prompt string")
    clean = [re.sub(r"\W+", " ", (t or "").lower()).strip() for t in texts]
    want = {(i, k, round(r, 3)) for i in range(12) for k in range(len(texts)) if i != k and clean[i] and clean[k] and (r := difflib.SequenceMatcher(None, clean[i], clean[k]).ratio()) >= 0.55}
    got = {tuple(r) for r in corpus.similar_texts(df.where("id < 12"), df, "id", "prompt").collect()}
    assert got == want and len(want) > 20


def test_intake_of_odd_columns(spark):
    rows = spark.createDataFrame([(" na ", "2024-01-01", "true"), ("1", "2024-01-02 10:00:00", "false"), (None, "2024-01-03", "true")], "code string, made_date string, flag string")
    got = {r.column_name: r for r in intake.intake_profile(rows).collect()}
    assert (got["code"].n_missing, got["code"].inferred_type, got["code"].constant) == (2, "integer", True)
    assert (got["made_date"].inferred_type, got["made_date"].n_invalid_dates) == ("datetime", 0) and got["flag"].inferred_type == "boolean"
