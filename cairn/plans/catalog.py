"""Queries over the standard tables and the SQL that gives the same rows.

Floats that depend on the order of additions are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.functions.predicates import Predicate, rule_filter, rule_review
from cairn.operators import analytics, corpus, explore, prep, quality, schema, scoring, series
from cairn.operators.analytics import Join, Metric
from cairn.streaming.events import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


# joins and grouped analytics

SEGMENT = [Join("customer", "c_custkey", "orders", "o_custkey"), Join("orders", "o_orderkey", "lineitem", "l_orderkey")]


@query("join_inner_segment_revenue", """SELECT c_mktsegment AS customer_c_mktsegment, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders,
round(avg(l_extendedprice), 4) AS mean_price, min(l_extendedprice) AS low, max(l_extendedprice) AS high
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def segment_revenue(t: Tables) -> DataFrame:
    out = analytics.analyze({"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem}, SEGMENT, ["customer.c_mktsegment"], [
        Metric("sum", "lineitem.l_extendedprice", "revenue"), Metric("count", None, "n_lines"), Metric("distinct_count", "orders.o_orderkey", "n_orders"),
        Metric("average", "lineitem.l_extendedprice", "mean_price"), Metric("minimum", "lineitem.l_extendedprice", "low"), Metric("maximum", "lineitem.l_extendedprice", "high"),
    ], guard=False)
    return renamed(out).withColumns({"revenue": F.round("revenue", 2), "mean_price": F.round("mean_price", 4)})


@query("join_left_unmatched", "SELECT c_mktsegment AS customer_c_mktsegment, count(*) AS n_rows, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_unmatched(t: Tables) -> DataFrame:
    return renamed(analytics.analyze({"customer": t.customer, "orders": t.orders}, [Join("customer", "c_custkey", "orders", "o_custkey", "left")], ["customer.c_mktsegment"], [Metric("count", None, "n_rows"), Metric("count", "orders.o_orderkey", "n_orders")]))


@query("join_four_tables", """SELECT r_name AS region_r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def four_tables(t: Tables) -> DataFrame:
    joins = [Join("region", "r_regionkey", "nation", "n_regionkey"), Join("nation", "n_nationkey", "customer", "c_nationkey"), Join("customer", "c_custkey", "orders", "o_custkey")]
    out = analytics.analyze({"region": t.region, "nation": t.nation, "customer": t.customer, "orders": t.orders}, joins, ["region.r_name"], [Metric("count", None, "n"), Metric("sum", "customer.c_acctbal", "balance")], guard=False)
    return renamed(out).withColumn("balance", F.round("balance", 2))


_EVIDENCE = """WITH a AS (SELECT {lk} AS k, count(*) AS l FROM {left} GROUP BY 1), b AS (SELECT {rk} AS k, count(*) AS r FROM {right} GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM a FULL JOIN b ON a.k = b.k)
SELECT CAST(sum(l) AS BIGINT) AS left_rows, CAST(sum(r) AS BIGINT) AS right_rows, CAST(coalesce(sum(l) FILTER (k IS NULL), 0) AS BIGINT) AS left_null_keys,
CAST(coalesce(sum(r) FILTER (k IS NULL), 0) AS BIGINT) AS right_null_keys, CAST(coalesce(sum(l) FILTER (k IS NULL OR r = 0), 0) AS BIGINT) AS unmatched_left_rows,
CAST(coalesce(sum(l * r) FILTER (k IS NOT NULL), 0){more} AS BIGINT) AS output_rows,
CASE WHEN max(l) FILTER (k IS NOT NULL) > 1 AND max(r) FILTER (k IS NOT NULL) > 1 THEN 'many_to_many' WHEN max(l) FILTER (k IS NOT NULL) > 1 THEN 'many_to_one' WHEN max(r) FILTER (k IS NOT NULL) > 1 THEN 'one_to_many' ELSE 'one_to_one' END AS cardinality FROM j"""


@query("join_evidence_orders_lineitem", _EVIDENCE.format(lk="o_orderkey", left="orders", rk="l_orderkey", right="lineitem", more=""))
def evidence(t: Tables) -> DataFrame:
    return analytics.join_evidence(t.orders, "o_orderkey", t.lineitem, "l_orderkey")


@query("join_evidence_null_keys", _EVIDENCE.format(lk="nullif(o_custkey % 50, 0)", left="orders", rk="nullif(c_custkey % 70, 0)", right="customer", more=" + coalesce(sum(l) FILTER (k IS NULL OR r = 0), 0)"))
def evidence_nulls(t: Tables) -> DataFrame:
    left, right = t.orders.select(F.expr("nullif(o_custkey % 50, 0)").alias("k")), t.customer.select(F.expr("nullif(c_custkey % 70, 0)").alias("k"))
    return analytics.join_evidence(left, "k", right, "k", "left")


@query("join_anti_customers_without_orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def without_orders(t: Tables) -> DataFrame:
    return analytics.unmatched(t.customer, "c_custkey", t.orders.where("o_totalprice > 300000"), "o_custkey").select("c_custkey", "c_name")


@query("group_global", "SELECT count(*) AS n, sum(CAST(l_linenumber AS HUGEINT))::DECIMAL(38,0) AS lines, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first_ship, round(CAST(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS VARCHAR) AS DOUBLE) / count(*), 6) AS discount FROM lineitem")
def group_global(t: Tables) -> DataFrame:
    out = analytics.aggregate(t.lineitem, [], [Metric("count", None, "n"), Metric("sum", "l_linenumber", "lines"), Metric("distinct_count", "l_suppkey", "suppliers"), Metric("minimum", "l_shipdate", "first_ship"), Metric("average", "l_discount", "discount")])
    return out.withColumns({"discount": F.round("discount", 6), "lines": F.col("lines").cast("decimal(38,0)")})


@query("group_evidence", """SELECT l_returnflag, l_linestatus, round(sum(q), 2) AS quantity, count(q) AS quantity_valid, count(*) - count(q) AS quantity_missing, count(*) AS group_rows FROM (SELECT *, CASE WHEN l_quantity > 10 THEN l_quantity END AS q FROM lineitem) GROUP BY 1, 2""")
def group_evidence(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("q", F.expr("CASE WHEN l_quantity > 10 THEN l_quantity WHEN l_quantity > 5 THEN double('NaN') END"))
    return rounded(analytics.aggregate(rows, ["l_returnflag", "l_linestatus"], [Metric("sum", "q", "quantity")], evidence=True), 2)


_OVERLAP = """WITH a AS (SELECT DISTINCT {lk} AS k FROM {left} WHERE {lk} IS NOT NULL), b AS (SELECT DISTINCT {rk} AS k FROM {right} WHERE {rk} IS NOT NULL),
n AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y, (SELECT count(*) FROM a JOIN b USING (k)) AS z)
SELECT x AS left_distinct, y AS right_distinct, z AS common, z / least(x, y) AS overlap, z / x AS left_coverage, z / y AS right_coverage FROM n"""


@query("key_overlap", _OVERLAP.format(lk="o_custkey", left="orders", rk="c_custkey", right="customer"))
def key_overlap(t: Tables) -> DataFrame:
    return analytics.overlap(t.orders, "o_custkey", t.customer, "c_custkey")


#: Columns of four tables by type family, with the normal form of their names.
_KEYS = {"customer": {"number": ["c_custkey", "c_nationkey", "c_acctbal"], "string": ["c_name", "c_mktsegment"]}, "nation": {"number": ["n_nationkey", "n_regionkey"], "string": ["n_name"]}, "orders": {"number": ["o_orderkey", "o_custkey", "o_totalprice"], "string": ["o_orderstatus", "o_orderpriority"]}, "region": {"number": ["r_regionkey"], "string": ["r_name"]}}
_KEY_PAIRS = [(s, a, t, b) for s in _KEYS for t in _KEYS if s < t for kind in _KEYS[s] for a in _KEYS[s][kind] for b in _KEYS[t][kind]]
_RECOMMEND = " UNION ALL ".join(f"SELECT '{s}.{a}' AS left_column, '{t}.{b}' AS right_column, (SELECT count(DISTINCT {a}) FROM {s}) AS da, (SELECT count(DISTINCT {b}) FROM {t}) AS db, (SELECT count(*) FROM {s}) AS na, (SELECT count(*) FROM {t}) AS nb, (SELECT count(DISTINCT {a}) FROM {s} WHERE {a} IN (SELECT {b} FROM {t})) AS overlap" for s, a, t, b in _KEY_PAIRS)


@query("join_recommend", f"""SELECT left_column, right_column, round(0.25 + 0.2 * least(da / na, db / nb) + 0.1 + 0.15 * overlap / least(da, db), 6) AS score, overlap, CASE WHEN da = na THEN CASE WHEN db = nb THEN 'one_to_one' ELSE 'one_to_many' END ELSE CASE WHEN db = nb THEN 'many_to_one' ELSE 'many_to_many' END END AS cardinality FROM ({_RECOMMEND}) WHERE overlap > 0 ORDER BY score DESC, 1, 2 LIMIT 50""")
def recommend(t: Tables) -> DataFrame:
    rows = analytics.recommend_joins({"nation": t.nation, "region": t.region, "customer": t.customer, "orders": t.orders})
    return t.spark.createDataFrame([(r["left"], r["right"], round(float(r["score"]), 6), int(r["overlap"]), r["cardinality"]) for r in rows], "left_column string, right_column string, score double, overlap long, cardinality string")


# predicates

_P = [Predicate("o_orderstatus", "eq", "F"), Predicate("o_totalprice", "gt", 150000.0)]
_MAYBE = "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS v FROM orders"


@query("filter_all", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def filter_all(t: Tables) -> DataFrame:
    return rule_filter(t.orders, _P).select("o_orderkey", "o_totalprice")


@query("filter_any", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 150000")
def filter_any(t: Tables) -> DataFrame:
    return rule_filter(t.orders, _P, "any").select("o_orderkey", "o_totalprice")


@query("filter_membership", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('O')")
def filter_membership(t: Tables) -> DataFrame:
    return rule_filter(t.orders, [Predicate("o_orderpriority", "in", ["1-URGENT", "2-HIGH"]), Predicate("o_orderstatus", "not_in", ["O"])]).select("o_orderkey")


@query("filter_null_policy_include", f"SELECT o_orderkey FROM ({_MAYBE}) WHERE coalesce(s = 'F' AND v > 150000, true)")
def filter_include(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS s", "CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS v")
    return rule_filter(rows, [Predicate("s", "eq", "F"), Predicate("v", "gt", 150000.0)], null_policy="include").select("o_orderkey")


@query("filter_review_count", f"SELECT count(*) AS n_rows, count(*) FILTER (m) AS satisfied, count(*) FILTER (NOT m) AS failed, count(*) FILTER (m IS NULL) AS review FROM (SELECT s = 'F' OR v >= 150000 AS m FROM ({_MAYBE}))")
def filter_review(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS s", "CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS v")
    return rule_review(rows, [Predicate("s", "eq", "F"), Predicate("v", "gte", 150000.0)], "any")


# preparation

@query("prep_string", "SELECT n_nationkey, nullif(lower(trim(CASE WHEN n_nationkey % 5 = 0 THEN '  ' ELSE ' ' || n_name || ' ' END)), '') AS name FROM nation")
def prep_string(t: Tables) -> DataFrame:
    rows = t.nation.selectExpr("n_nationkey", "CASE WHEN n_nationkey % 5 = 0 THEN '  ' ELSE concat(' ', n_name, ' ') END AS name")
    return prep.fit(rows, "string_normalization", columns=["name"], case="lower", empty_to_null=True).transform(rows)


_HOLES = "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer"


def _holes(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS balance", "CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment")


for _strategy, _stat in (("mean", "avg(balance)"), ("median", "quantile_cont(balance, 0.5)")):
    query(f"prep_fill_{_strategy}", f"WITH h AS ({_HOLES}) SELECT c_custkey, round(coalesce(balance, (SELECT {_stat} FROM h)), 4) AS balance, segment FROM h")(
        lambda t, s=_strategy: rounded(prep.fit(h := _holes(t), "missing_values", columns=["balance"], strategy=s).transform(h))
    )


@query("prep_fill_mode", f"WITH h AS ({_HOLES}), m AS (SELECT segment FROM h WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1) SELECT c_custkey, balance, coalesce(segment, (SELECT segment FROM m)) AS segment FROM h")
def prep_mode(t: Tables) -> DataFrame:
    return prep.fit(h := _holes(t), "missing_values", columns=["segment"], strategy="most_frequent").transform(h)


@query("prep_drop_rows", f"SELECT * FROM ({_HOLES}) WHERE balance IS NOT NULL AND segment IS NOT NULL")
def prep_drop(t: Tables) -> DataFrame:
    return prep.fit(h := _holes(t), "missing_values", columns=["balance", "segment"], strategy="drop_rows").transform(h)


@query("prep_clip_bounds", "SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 950.0 WHEN p_retailprice > 1500 THEN 1500.0 ELSE p_retailprice END AS p_retailprice FROM part")
def prep_clip(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", "p_retailprice")
    return prep.fit(rows, "outliers", columns=["p_retailprice"], strategy="clip_bounds", lower=950.0, upper=1500.0).transform(rows)


@query("prep_clip_iqr", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(a - 0.2 * (b - a), least(b + 0.2 * (b - a), l_extendedprice)), 4) AS l_extendedprice FROM lineitem, q""")
def prep_iqr(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(prep.fit(rows, "outliers", columns=["l_extendedprice"], strategy="iqr_clip", multiplier=0.2).transform(rows))


@query("prep_scale_standard", f"WITH h AS ({_HOLES}) SELECT c_custkey, round((balance - (SELECT avg(balance) FROM h)) / (SELECT stddev_pop(balance) FROM h), 6) AS balance, segment FROM h")
def prep_standard(t: Tables) -> DataFrame:
    return rounded(prep.fit(h := _holes(t), "scaling", columns=["balance"], strategy="standard").transform(h), 6)


@query("prep_scale_min_max", f"WITH h AS ({_HOLES}) SELECT c_custkey, round(-1 + 2 * (balance - (SELECT min(balance) FROM h)) / (SELECT max(balance) - min(balance) FROM h), 6) AS balance, segment FROM h")
def prep_min_max(t: Tables) -> DataFrame:
    return rounded(prep.fit(h := _holes(t), "scaling", columns=["balance"], strategy="min_max", target=(-1.0, 1.0)).transform(h), 6)


@query("prep_category_mapping", f"SELECT c_custkey, balance, CASE segment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE CASE WHEN segment IS NULL THEN 'none' ELSE segment END END AS segment FROM ({_HOLES})")
def prep_mapping(t: Tables) -> DataFrame:
    return prep.fit(h := _holes(t), "category_mapping", columns=["segment"], mapping={"BUILDING": "b", "MACHINERY": "m"}, null="constant", null_value="none").transform(h)


@query("prep_derived_metric", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS per_discount FROM lineitem")
def prep_derived(t: Tables) -> DataFrame:
    out = prep.fit(t.lineitem, "derived_metric", name="per_discount", left="l_extendedprice", right="l_discount", operation="divide").transform(t.lineitem)
    return rounded(out.select("l_orderkey", "l_linenumber", "per_discount"))


@query("prep_validate", f"""WITH h AS ({_HOLES}) SELECT CAST(0 AS BIGINT) AS rule, 'required' AS kind, count(*) FILTER (segment IS NULL) AS affected, CAST(0 AS BIGINT) AS review FROM h
UNION ALL SELECT 1, 'allowed', count(*) FILTER (segment NOT IN ('BUILDING', 'MACHINERY')), count(*) FILTER (segment IS NULL) FROM h
UNION ALL SELECT 2, 'range', count(*) FILTER (NOT (balance >= 0 AND balance <= 5000)), count(*) FILTER (balance IS NULL) FROM h
UNION ALL SELECT 3, 'compare', count(*) FILTER (NOT balance > c_custkey), count(*) FILTER (balance IS NULL) FROM h""")
def prep_validate(t: Tables) -> DataFrame:
    return prep.validate(_holes(t), [{"kind": "required", "column": "segment"}, {"kind": "allowed", "column": "segment", "values": ["BUILDING", "MACHINERY"]}, {"kind": "range", "column": "balance", "lower": 0.0, "upper": 5000.0}, {"kind": "compare", "left": "balance", "operator": "gt", "right": "c_custkey"}])


# profile and quality

_PROFILED = ["l_quantity", "l_returnflag", "l_shipdate"]


@query("profile_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, CAST(0 AS BIGINT) AS n_empty, CAST(0 AS BIGINT) AS n_nonfinite, count(DISTINCT {c}) AS n_distinct, "
    + ("min({0}) AS minimum, max({0}) AS maximum, round(avg({0}), 4) AS mean, quantile_cont({0}, 0.5) AS median FROM lineitem".format(c) if c == "l_quantity" else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM lineitem")
    for c in _PROFILED))
def profile_columns(t: Tables) -> DataFrame:
    return rounded(quality.profile(t.lineitem, _PROFILED))


@query("profile_top_values", "WITH c AS (SELECT l_suppkey AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(v AS VARCHAR) AS value, n, round(100.0 * n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, CAST(v AS VARCHAR) LIMIT 10")
def top_values(t: Tables) -> DataFrame:
    return rounded(quality.top_values(t.lineitem, "l_suppkey"), 6)


@query("quality_missing", f"WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE segment END AS segment, balance FROM ({_HOLES})) SELECT 'segment' AS column_name, count(*) FILTER (segment = '') AS n_empty, count(*) FILTER (segment IS NULL) AS n_null, count(*) FILTER (segment IS NULL OR segment = '') AS affected FROM h UNION ALL SELECT 'balance', 0, count(*) FILTER (balance IS NULL), count(*) FILTER (balance IS NULL) FROM h")
def quality_missing(t: Tables) -> DataFrame:
    return quality.missing(_holes(t).withColumn("segment", F.expr("CASE WHEN c_custkey % 7 = 0 THEN '' ELSE segment END")), ["segment", "balance"])


@query("quality_constant", "SELECT 'o_orderstatus' AS column_name, count(*) AS n_values, count(DISTINCT o_orderstatus) = 1 AS constant FROM orders UNION ALL SELECT 'one', count(*), true FROM orders")
def quality_constant(t: Tables) -> DataFrame:
    return quality.constant_columns(t.orders.withColumn("one", F.lit("x")), ["o_orderstatus", "one"])


@query("quality_whitespace", r"SELECT 'text' AS column_name, count(*) FILTER (regexp_matches(text, '^[\s]|[\s]$')) AS n_edge, count(*) FILTER (regexp_matches(text, '\S\s{2,}\S')) AS n_repeated, count(*) FILTER (regexp_matches(text, '^[\s]|[\s]$') OR regexp_matches(text, '\S\s{2,}\S')) AS affected FROM documents")
def quality_whitespace(t: Tables) -> DataFrame:
    return quality.whitespace(t.documents, ["text"])


@query("quality_nonfinite", "SELECT 'value' AS column_name, count(v) AS n_values, count(*) FILTER (isnan(v)) AS affected FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events)")
def quality_nonfinite(t: Tables) -> DataFrame:
    return quality.nonfinite(t.events.withColumn("value", F.expr("CASE WHEN event_id % 9 = 0 THEN double('NaN') ELSE value END")), ["value"])


@query("quality_outlier_iqr", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def outlier_iqr(t: Tables) -> DataFrame:
    return quality.outliers(t.events, "value").select("event_id", "value")


@query("quality_outlier_zscore", "WITH q AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, value FROM events, q WHERE value < m - 2 * s OR value > m + 2 * s")
def outlier_z(t: Tables) -> DataFrame:
    return quality.outliers(t.events, "value", "zscore", 2.0).select("event_id", "value")


@query("quality_duplicate_rows", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders) GROUP BY o_custkey, o_orderstatus, o_orderpriority)")
def duplicate_rows(t: Tables) -> DataFrame:
    return quality.duplicate_rows(t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query("quality_business_key", "WITH k AS (SELECT nullif(l_orderkey, 1) AS k, l_linenumber AS l, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT CAST(sum(n) FILTER (k IS NOT NULL) AS BIGINT) AS n_keyed, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT) AS n_null_key, CAST(sum(n - 1) FILTER (k IS NOT NULL) AS BIGINT) AS n_duplicates FROM k")
def business_key(t: Tables) -> DataFrame:
    return quality.business_key_duplicates(t.lineitem.withColumn("l_orderkey", F.expr("nullif(l_orderkey, 1)")), ["l_orderkey", "l_linenumber"])


@query("quality_examples", "SELECT event_type, event_id, nth FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events) WHERE nth <= 5")
def quality_examples(t: Tables) -> DataFrame:
    return quality.examples(t.events.select("event_type", "event_id"), "event_type", "event_id").withColumn("nth", F.col("nth").cast("long"))


# exploration

@query("eda_numeric", """SELECT count(*) AS n_rows, count(l_extendedprice) AS n_valid, CAST(0 AS BIGINT) AS n_null, round(avg(l_extendedprice), 2) AS mean, round(var_samp(l_extendedprice), 2) AS variance, round(stddev_samp(l_extendedprice), 2) AS stddev, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum,
round(max(l_extendedprice) - min(l_extendedprice), 2) AS value_range, round(quantile_cont(l_extendedprice, 0.05), 2) AS p5, round(quantile_cont(l_extendedprice, 0.25), 2) AS p25, round(quantile_cont(l_extendedprice, 0.5), 2) AS p50, round(quantile_cont(l_extendedprice, 0.75), 2) AS p75, round(quantile_cont(l_extendedprice, 0.95), 2) AS p95 FROM lineitem""")
def eda_numeric(t: Tables) -> DataFrame:
    return rounded(explore.numeric_summary(t.lineitem, "l_extendedprice"), 2)


@query("eda_histogram", """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT least(9, floor((o_totalprice - lo) / (hi - lo) * 10))::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT b.bin AS bin, round(lo + (hi - lo) * b.bin / 10, 2) AS lower, round(lo + (hi - lo) * (b.bin + 1) / 10, 2) AS upper, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""")
def eda_histogram(t: Tables) -> DataFrame:
    return rounded(explore.histogram(t.orders, "o_totalprice"), 2)


@query("eda_box_plot", """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events), b AS (SELECT *, q3 - q1 AS iqr FROM q)
SELECT round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(iqr, 4) AS iqr, round(min(value) FILTER (value >= q1 - 1.5 * iqr), 4) AS low_whisker, round(max(value) FILTER (value <= q3 + 1.5 * iqr), 4) AS high_whisker, count(*) AS n, count(*) FILTER (value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr) AS n_outside FROM events, b GROUP BY q1, median, q3, iqr""")
def eda_box(t: Tables) -> DataFrame:
    return rounded(explore.box_plot(t.events, "value"))


@query("eda_temporal", "SELECT count(o_orderdate) AS n_valid, min(o_orderdate) AS first, max(o_orderdate) AS last, datediff('day', min(o_orderdate), max(o_orderdate)) AS coverage_days, epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS coverage_seconds FROM orders")
def eda_temporal(t: Tables) -> DataFrame:
    return explore.temporal_summary(t.orders, "o_orderdate")


@query("eda_pearson", "SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(covar_samp(l_quantity, l_extendedprice), 2) AS covariance FROM lineitem")
def eda_pearson(t: Tables) -> DataFrame:
    return explore.pair_statistics(t.lineitem, "l_quantity", "l_extendedprice").withColumns({"pearson": F.round("pearson", 6), "covariance": F.round("covariance", 2)})


@query("eda_spearman", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS y FROM lineitem) SELECT count(*) AS n, round(corr(x, y), 6) AS spearman FROM r""")
def eda_spearman(t: Tables) -> DataFrame:
    return rounded(explore.spearman(t.lineitem, "l_quantity", "l_discount"), 6)


@query("eda_group_summary", "SELECT o_orderpriority AS category, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(quantile_cont(o_totalprice, 0.5), 2) AS median, min(o_totalprice) AS minimum, max(o_totalprice) AS maximum, round(var_samp(o_totalprice), 0) AS variance, round(stddev_samp(o_totalprice), 2) AS stddev FROM orders GROUP BY 1")
def eda_groups(t: Tables) -> DataFrame:
    return rounded(explore.group_summary(t.orders, "o_orderpriority", "o_totalprice"), 2).withColumn("variance", F.round("variance", 0))


@query("eda_contingency", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2")
def eda_contingency(t: Tables) -> DataFrame:
    return explore.contingency(t.orders, "o_orderstatus", "o_orderpriority")


@query("eda_cramers_v", """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS k, sum(n) OVER () AS t FROM c),
s AS (SELECT sum(n * n / (r * k)) - 1 AS phi, max(t) AS t, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS d FROM m) SELECT round(t * phi, 4) AS chi_square, round(sqrt(greatest(0, phi / d)), 6) AS cramers_v, CAST(t AS BIGINT) AS n FROM s""")
def eda_cramers(t: Tables) -> DataFrame:
    return explore.cramers_v(t.orders, "o_orderstatus", "o_orderpriority").withColumns({"chi_square": F.round("chi_square", 4), "cramers_v": F.round("cramers_v", 6)})


_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("eda_correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS pearson, count(*) AS n FROM lineitem" for i, a in enumerate(_MATRIX) for b in _MATRIX[i:]))
def eda_matrix(t: Tables) -> DataFrame:
    return explore.correlation_matrix(t.lineitem, _MATRIX).withColumn("pearson", F.round("pearson", 6) + 0.0)


@query("anomaly_mad", """WITH m AS (SELECT quantile_cont(value, 0.5) AS m FROM events), d AS (SELECT event_id, value, abs(value - m) AS d FROM events, m), s AS (SELECT 1.4826 * quantile_cont(d, 0.5) AS s FROM d) SELECT event_id AS key, value, round(d / s, 6) AS score FROM d, s WHERE d / s > 3.5""")
def anomaly(t: Tables) -> DataFrame:
    return explore.anomalies(t.events, "event_id", "value").withColumn("score", F.round("score", 6))


# schema

@query("schema_keys", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, count({c}) - count(DISTINCT {c}) AS n_duplicates, round(count(DISTINCT {c}) / count({c}), 6) AS unique_ratio, count(*) = count(DISTINCT {c}) AS candidate_key FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus")))
def schema_keys(t: Tables) -> DataFrame:
    return rounded(schema.key_statistics(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus"]), 6)


@query("schema_orphans", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def schema_orphans(t: Tables) -> DataFrame:
    return schema.orphans(t.lineitem.select("l_orderkey", "l_partkey"), "l_partkey", t.part.where("p_size < 40"), "p_partkey")


_REFERENCES = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
_NAMES = ("SELECT 'nation.n_name' AS source, 'region.r_name' AS target, 'one_to_one' AS cardinality, (SELECT avg((n_name IN (SELECT r_name FROM region))::INT) FROM nation) AS coverage, 'rejected' AS status, 0.8 AS score UNION ALL SELECT 'customer.c_name', 'nation.n_name', 'one_to_one', 0.0, 'rejected', 0.8 UNION ALL SELECT 'customer.c_name', 'region.r_name', 'one_to_one', 0.0, 'rejected', 0.8")


@query("schema_relationships", " UNION ALL ".join([_NAMES, *(f"SELECT '{s}.{a}', '{t}.{b}', 'many_to_one', c, CASE WHEN c >= 0.9 THEN 'inferred' WHEN c > 0 THEN 'ambiguous' ELSE 'rejected' END, round(0.3 + 0.4 + 0.15 * c + 0.05 * (c > 0)::INT + 0.1, 4) FROM (SELECT avg(({a} IN (SELECT {b} FROM {t}))::INT) AS c FROM (SELECT DISTINCT {a} FROM {s}))" for s, a, t, b in _REFERENCES)]))
def schema_relationships(t: Tables) -> DataFrame:
    found = schema.relationships({"customer": t.customer, "nation": t.nation, "region": t.region, "orders": t.orders})
    return t.spark.createDataFrame([(r["source"], r["target"], r["cardinality"], float(r["coverage"]), r["status"], float(r["score"])) for r in found], "source string, target string, cardinality string, coverage double, status string, score double")


# series

_MONTHLY = "SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS month, round(sum(o_totalprice), 2) AS total, count(*) AS n_rows, strftime(min(o_orderdate), '%Y-%m') AS label FROM orders GROUP BY 1"


def _monthly(t: Tables) -> DataFrame:
    return series.monthly(t.orders, "o_orderdate", "o_totalprice")


@query("ts_monthly", _MONTHLY)
def ts_monthly(t: Tables) -> DataFrame:
    return rounded(_monthly(t), 2)


@query("ts_gaps", f"SELECT * FROM (SELECT lag(month) OVER (ORDER BY month) AS after, month AS before, month - lag(month) OVER (ORDER BY month) - 1 AS missing FROM ({_MONTHLY}) WHERE month % 5 > 1) WHERE missing > 0")
def ts_gaps(t: Tables) -> DataFrame:
    return series.gaps(_monthly(t).where("month % 5 > 1"))


@query("ts_seasonal_naive", f"SELECT month, total, lag(total) OVER (ORDER BY month) AS naive, lag(total, 12) OVER (ORDER BY month) AS seasonal FROM ({_MONTHLY})")
def ts_naive(t: Tables) -> DataFrame:
    return rounded(series.seasonal_naive(_monthly(t)), 2)


@query("ts_holdout_error", f"""WITH s AS (SELECT month, total, lag(total, 12) OVER (ORDER BY month) AS p, row_number() OVER (ORDER BY month DESC) AS nth, count(*) OVER () AS n FROM ({_MONTHLY})), e AS (SELECT * FROM s WHERE nth <= greatest(3, ceil(n * 0.2)))
SELECT count(*) AS n, round(avg(abs(p - total)), 2) AS mae, round(avg((p - total) ** 2), 0) AS mse, round(sqrt(avg((p - total) ** 2)), 2) AS rmse, round(avg(p - total), 2) AS bias, round(100 * sum(abs(p - total)) / sum(abs(total)), 4) AS wape FROM e""")
def ts_holdout(t: Tables) -> DataFrame:
    both = series.holdout(_monthly(t)).where("test").join(series.seasonal_naive(rounded(_monthly(t), 2)).select("month", "seasonal", F.col("total").alias("y")), "month")
    e = series.errors(both, "y", "seasonal")
    return e.select("n", *[F.round(c, d).alias(c) for c, d in (("mae", 2), ("mse", 0), ("rmse", 2), ("bias", 2), ("wape", 4))])


@query("ts_backtest_naive", f"SELECT origin, month, total, naive FROM (SELECT lag(month) OVER (ORDER BY month) AS origin, month, total, lag(total) OVER (ORDER BY month) AS naive, row_number() OVER (ORDER BY month DESC) AS nth FROM ({_MONTHLY})) WHERE nth <= 12")
def ts_backtest(t: Tables) -> DataFrame:
    return rounded(series.backtest(_monthly(t)), 2)


@query("ts_forecast")
def ts_forecast(t: Tables) -> DataFrame:
    f = series.forecast(_monthly(t))
    return t.spark.createDataFrame([(int(m), float(v), f.verdict) for m, v in zip(f.months, f.values, strict=True)], "month long, forecast double, verdict string")


# scores

_GUESS = "SELECT quality AS label, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS guess FROM labels JOIN documents USING (doc_id)"


def _guess(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").selectExpr("quality AS label", "CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS guess")


@query("cls_confusion", f"SELECT label, guess AS predicted, count(*) AS n FROM ({_GUESS}) GROUP BY 1, 2")
def cls_confusion(t: Tables) -> DataFrame:
    return scoring.confusion(_guess(t), "label", "guess")


@query("cls_scores", f"""WITH g AS ({_GUESS}), l AS (SELECT label, count(*) AS support, count(*) FILTER (guess = label) AS hit FROM g GROUP BY 1), p AS (SELECT guess AS label, count(*) AS guessed FROM g GROUP BY 1),
s AS (SELECT label, support, coalesce(hit / guessed, 0) AS p, hit / support AS r FROM l LEFT JOIN p USING (label)) SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s""")
def cls_scores(t: Tables) -> DataFrame:
    return rounded(scoring.class_scores(_guess(t), "label", "guess"), 6)


@query("reg_scores", "SELECT count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(100 * avg(abs(y - p) / abs(y)) FILTER (y <> 0), 4) AS mape, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem)")
def reg_scores(t: Tables) -> DataFrame:
    s = scoring.regression_scores(t.lineitem.selectExpr("l_extendedprice AS y", "l_quantity * 1000 AS p"), "y", "p")
    return s.select("n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mape")], F.round("r2", 6).alias("r2"))


@query("ml_leakage", """SELECT 'l_quantity' AS feature, round(avg(CASE WHEN l_quantity = l_extendedprice THEN 1 ELSE 0 END), 6) AS equal_share, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(count(DISTINCT l_quantity) / count(*), 6) AS distinct_share, 'fine' AS verdict FROM lineitem
UNION ALL SELECT 'copy', 1.0, 1.0, round(count(DISTINCT l_extendedprice) / count(*), 6), 'copy' FROM lineitem""")
def ml_leakage(t: Tables) -> DataFrame:
    return rounded(scoring.leakage(t.lineitem.withColumn("copy", F.col("l_extendedprice")), "l_extendedprice", ["l_quantity", "copy"]), 6)


@query("ml_chronological_split", """WITH c AS (SELECT o_orderdate AS t, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT t, sum(n) OVER (ORDER BY t) AS upto FROM c), b AS (SELECT min(t) AS b FROM s WHERE upto > ceil((SELECT count(*) FROM orders) * 0.8)) SELECT CASE WHEN o_orderdate >= b THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM orders, b GROUP BY 1""")
def ml_chronological(t: Tables) -> DataFrame:
    return scoring.chronological_split(t.orders, "o_orderdate").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("ml_split_leakage", "SELECT l_partkey AS group_value, count(DISTINCT l_orderkey % 3) AS n_splits, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey % 3) > 1")
def ml_split(t: Tables) -> DataFrame:
    return corpus.group_leakage(t.lineitem.withColumn("split", F.expr("l_orderkey % 3")), "l_partkey", "split")


# corpora

@query("gov_exact_duplicates", "SELECT sha256(text) AS content_sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def gov_duplicates(t: Tables) -> DataFrame:
    return corpus.content_duplicates(t.documents, "doc_id", "text")


@query("gov_overlap", r"WITH c AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM conversations) SELECT conv_id, turn FROM c WHERE k <> '' AND k IN (SELECT k FROM c WHERE turn = 0)")
def gov_overlap(t: Tables) -> DataFrame:
    return corpus.overlap(t.conversations, "text", t.conversations.where("turn = 0"), "text").select("conv_id", "turn")


@query("gov_leakage", "SELECT source AS group_value, count(DISTINCT lang) AS n_splits, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def gov_leakage(t: Tables) -> DataFrame:
    return corpus.group_leakage(t.documents, "source", "lang")


@query("gov_split_counts", "SELECT lang AS split, source AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY 1, 2")
def gov_counts(t: Tables) -> DataFrame:
    return rounded(corpus.split_counts(t.documents, "lang", "source"), 6)


@query("gov_personal_data", rf"SELECT count(*) AS n_rows, count(*) FILTER (regexp_matches(text, '{text.EMAIL}')) AS n_email, count(*) FILTER (regexp_matches(text, '{text.CARD}')) AS n_card, count(*) FILTER (regexp_matches(text, '{text.PHONE}')) AS n_phone FROM documents")
def gov_personal(t: Tables) -> DataFrame:
    return corpus.personal_data(t.documents, "text")


@query("gov_conversations", """WITH r AS (SELECT *, lag(turn) OVER w AS lt, lag(role) OVER w AS lr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, count(*) AS n_turns, count(*) FILTER (turn <> lt + 1) AS n_gaps, count(*) FILTER (length(trim(coalesce(text, ''))) = 0) AS n_empty, count(*) FILTER (role = lr) AS n_repeated_roles, count(*) FILTER (role = 'user') > 0 AS has_user FROM r GROUP BY 1""")
def gov_conversations(t: Tables) -> DataFrame:
    return corpus.conversation_faults(t.conversations)


@query("gov_reconcile", "SELECT (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS n_repeated, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)) AS n_unknown, (SELECT count(*) FROM supplier WHERE s_nationkey < 20 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)) AS n_unused")
def gov_reconcile(t: Tables) -> DataFrame:
    return corpus.reconcile(t.lineitem, "l_suppkey", t.supplier.where("s_nationkey < 20"), "s_suppkey")


@query("gov_same_rows", "SELECT (SELECT count(*) FROM (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 > 0 EXCEPT ALL SELECT c_nationkey FROM customer)) AS only_left, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT n_nationkey FROM nation WHERE n_nationkey % 3 > 0)) AS only_right")
def gov_same(t: Tables) -> DataFrame:
    return corpus.same_rows(t.nation.where("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")))


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_counts(t: Tables) -> DataFrame:
    return rounded(windowed_counts(t.events))


from cairn.plans import further, more  # noqa: E402, F401  (they add their queries to QUERIES and ORACLE_SQL)
