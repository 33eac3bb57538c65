"""Model codec, advice on table models, evaluation of candidates, and reports that say what they leave out."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import corpus, reports, rules, schema, scoring, series, supervised


def test_model_codec():
    model = {"weights": [0.1, -2.5e-300], "first": 24000, "name": "É"}
    data = series.encode_model(model)
    assert series.decode_model(data) == model and series.encode_model(dict(reversed(model.items()))) == data
    with pytest.raises(ValueError, match="digest"):
        series.decode_model(bytes([data[0] ^ 1]) + data[1:])
    with pytest.raises(ValueError):
        series.encode_model({"x": float("nan")})


def test_model_advice(spark):
    day = spark.createDataFrame([(i, i // 30) for i in range(90)], "day long, month long")
    month = spark.createDataFrame([(i, f"m{i}") for i in range(3)], "month long, label string")
    shop = spark.createDataFrame([(i, f"s{i}") for i in range(9)], "shop long, name string")
    sales = spark.createDataFrame([(i, i % 90, i % 9, i / 3) for i in range(400)], "sale long, day long, shop long, amount double")
    tables = {"day": day, "month": month, "shop": shop, "sales": sales}
    link = lambda s, t, status="inferred": {"source": s, "target": t, "status": status}
    star = [link("sales.day", "day.day"), link("sales.shop", "shop.shop")]
    assert schema.model_advice(tables, star) == "star"
    assert schema.model_advice(tables, [*star, link("day.month", "month.month")]) == "snowflake"
    assert schema.model_advice(tables | {"more": sales}, [*star, link("more.day", "day.day"), link("more.shop", "shop.shop")]) == "hybrid"
    assert schema.model_advice(tables, [star[0], link("sales.shop", "shop.shop", "ambiguous")]) == "normalized"


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_evaluate_beats_a_constant(spark, task):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        x, c = rng.gauss(0, 1), rng.choice("ab")
        y = 3 * x + (2 if c == "a" else -2) + rng.gauss(0, 0.5)
        rows.append((i, x if i % 20 else None, c, y if task == "regression" else float(y > 0)))
    df = scoring.hash_split(spark.createDataFrame(rows, "id long, x double, c string, y double"), "id")
    r = supervised.evaluate(df, "y", ["x", "c"], task)
    if task == "regression":
        assert r.test["mae"] < 0.5 * r.baseline["mae"] and r.test["r2"] > 0.7
        assert reports.promotion(r.test["mae"], r.baseline["mae"], "minimize", r.test["n"], 30) == "eligible_for_human_review"
    else:
        assert r.test["accuracy"] > r.baseline["accuracy"] + 0.2 and r.test["roc_auc"] > 0.9
    assert r.chosen in r.validation
    with pytest.raises(ValueError, match="copy the target"):
        supervised.evaluate(df.withColumn("z", F.col("y")), "y", ["x", "z"], task)


def test_promotion_needs_rows_and_finite_scores():
    assert reports.promotion(1.0, 2.0, "minimize", 10, 30) == reports.promotion(float("inf"), 2.0, "maximize", 50, 30) == reports.promotion(None, 2.0, "minimize", 50, 30) == "not_recommended"
    assert reports.promotion(3.0, 2.0, "maximize", 50, 30) == "eligible_for_human_review"


def test_leakage_of_odd_features(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 7), None, f"k{i}") for i in range(60)], "i long, y double, same double, none double, name string")
    got = {r.feature: (r.verdict, r.distinct_share) for r in scoring.leakage(df, "y", ["same", "none", "name"]).collect()}
    assert got == {"same": ("copy", 7 / 60), "none": ("fine", None), "name": ("identifier", 1.0)}


def test_reports_say_how_many_there_are(spark):
    df = spark.range(500).select(F.col("id").alias("x"), (F.col("id") * 2.0).alias("y"), F.lit(5).alias("group_rows"))
    assert {r.n_points for r in reports.chart(df, "line", "x", "y", total=True).collect()} == {500}
    found = reports.evidence_findings(df.union(df.withColumn("x", F.col("x") + 500)), ["x"], ["y"], total=True)
    assert {r.n_findings for r in found.collect()} == {1000} and found.count() == reports.FINDINGS
    assert "n_points" not in reports.chart(df, "line", "x", "y").columns


def test_plan_for_a_table(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "i long, t string")
    got = {r.rule_id: (r.status, r.n_columns, r.n_values) for r in rules.planned(df, {"business_key": {"key": ["i"]}}).collect()}
    assert got["non_finite"] == ("not_applicable", 0, 0) and got["missing_values"] == ("ready", 2, 3) and got["outliers"] == ("ready", 1, 1) and got["business_key"][0] == "ready"


def test_charts_for_profiles(spark):
    rows = [(1, "trend", 3, 1, True, True), (2, "trend", 3, 1, False, True), (3, "ranking", 5, 2, False, True), (4, "ranking", 25, 2, False, True), (5, "composition", None, 1, False, True), (6, "what", 1, 1, True, True), (7, "kpi", 1, 1, True, False), (8, None, 1, 1, True, True), (9, "distribution", 1, 1, False, True)]
    df = spark.createDataFrame(rows, "k int, objective string, n_categories int, n_series int, has_time boolean, enough boolean")
    got = {r.k: r.chart for r in corpus.charts_for(df, "k").collect()}
    assert got == {1: "line_chart", 2: "table", 3: "grouped_bar", 4: "ranked_bar", 5: "stacked_bar", 6: "table", 7: "table", 8: "table", 9: "histogram"}


def test_too_many_query_bytes(spark, monkeypatch):
    monkeypatch.setattr(corpus, "QUERY_BYTES", 10)
    df = spark.createDataFrame([(1, "a long text of words")], "id long, t string")
    with pytest.raises(ValueError, match="bytes"):
        corpus.similar_texts(df, df, "id", "t")


def test_roles_of_columns(spark):
    df = spark.createDataFrame([(i, i % 3, f"n{i}", "ab"[i % 2], i / 2, bool(i % 2)) for i in range(40)], "sale_id long, shop_key long, name string, kind string, amount double, done boolean").withColumn("day", F.lit("2024-01-01").cast("date"))
    got = {r.column_name: r.roles for r in schema.column_roles(df, {"shop_key"}).collect()}
    assert got == {"sale_id": "identifier,degenerate_dimension", "shop_key": "identifier", "name": "identifier", "kind": "descriptive", "amount": "identifier,measure", "done": "descriptive", "day": "temporal"}
    assert {r.roles for r in schema.column_roles(df.limit(0).select("kind")).collect()} == {"descriptive"}
