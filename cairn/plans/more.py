"""Further queries: text forms, intake, rankings, charts, claims, rules and supervised evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import analytics, corpus, explore, intake, quality, reports, rules, scoring, series, supervised
from cairn.operators.analytics import Metric
from cairn.operators.backtests import cycle
from cairn.plans.catalog import Tables, query, rounded

# text forms

_CASES = "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'write to ' || lower(c_mktsegment) || '@example.com' WHEN 1 THEN '4111 1111 1111 1111' WHEN 2 THEN '+44 20 7946 0000' WHEN 3 THEN '' WHEN 4 THEN c_name END AS v FROM customer"
_CASES_SPARK = "CASE c_custkey % 6 WHEN 0 THEN concat('write to ', lower(c_mktsegment), '@example.com') WHEN 1 THEN '4111 1111 1111 1111' WHEN 2 THEN '+44 20 7946 0000' WHEN 3 THEN '' WHEN 4 THEN c_name END AS v"


@query("text_masked", rf"SELECT c_custkey, CASE WHEN v IS NULL OR v = '' THEN v WHEN regexp_matches(v, '{text.EMAIL}') THEN '[REDACTED_EMAIL]' WHEN regexp_matches(v, '{text.CARD}') THEN '[REDACTED_CARD_NUMBER]' WHEN regexp_matches(v, '{text.PHONE}') THEN '[REDACTED_PHONE]' ELSE '[REDACTED]' END AS masked FROM ({_CASES})")
def text_masked(t: Tables) -> DataFrame:
    return t.customer.selectExpr("c_custkey", _CASES_SPARK).select("c_custkey", text.masked(F.col("v")).alias("masked"))


_DATES = "CASE o_orderkey % 5 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} WHEN 3 THEN {d} ELSE 'soon' END AS v"
_DUCK_DATES = _DATES.format(**{k: f"strftime(o_orderdate, '{f}')" for k, f in zip("abcd", ("%Y-%m-%d", "%Y/%m/%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S"), strict=True)})
_SPARK_DATES = _DATES.format(**{k: f'date_format(o_orderdate, "{f}")' for k, f in zip("abcd", text.DATE_FORMATS, strict=True)})


@query("text_parsed_dates", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CASE WHEN o_orderkey % 5 < 2 THEN date_trunc('day', o_orderdate) ELSE date_trunc('second', o_orderdate) END END AS parsed FROM (SELECT *, {_DUCK_DATES} FROM orders)")
def text_dates(t: Tables) -> DataFrame:
    return t.orders.selectExpr("o_orderkey", _SPARK_DATES).select("o_orderkey", text.parsed_date(F.col("v")).alias("parsed"))


@query("text_category_keys", "SELECT doc_id, CASE WHEN length(text) > 256 THEN 'sha256:' || sha256(text) ELSE text END AS category, substring(text, 1, 256) AS label FROM documents")
def text_keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.category_key(F.col("text")).alias("category"), text.short_label(F.col("text")).alias("label"))


@query("text_whole_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity / 4 - round(l_quantity / 4)) <= 1e-12 THEN CAST(round(l_quantity / 4) AS BIGINT) END AS whole FROM lineitem")
def text_whole(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", text.whole_number(F.col("l_quantity") / 4).alias("whole"))


@query("text_canonical_digest", """SELECT n_nationkey, sha256('{"a":' || n_regionkey || ',"b":"' || n_name || '","c":' || CASE WHEN n_nationkey % 3 = 0 THEN 'null' ELSE n_nationkey::VARCHAR END || '}') AS digest FROM nation""")
def text_digest(t: Tables) -> DataFrame:
    c = {"b": F.col("n_name"), "c": F.expr("CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END"), "a": F.col("n_regionkey")}
    return t.nation.select("n_nationkey", F.sha2(text.canonical_json(c), 256).alias("digest"))


@query("text_typed_fingerprints", "SELECT count(DISTINCT k) AS n_kinds FROM (SELECT n_regionkey || ':' || tag AS k FROM nation, (SELECT unnest(['int', 'double', 'string']) AS tag))")
def text_fingerprints(t: Tables) -> DataFrame:
    prints = [text.typed_fingerprint({"v": (kind, F.col("n_regionkey"))}) for kind in ("int", "double", "string")]
    return t.nation.select(F.explode(F.array(*prints)).alias("f")).agg(F.count_distinct("f").alias("n_kinds"))


# intake

_RAW = "SELECT CASE WHEN o_orderkey % 7 = 0 THEN ' N/A ' ELSE o_custkey::VARCHAR END AS customer, CASE WHEN o_orderkey % 11 = 0 THEN 'never' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date, CASE WHEN o_orderkey % 2 = 0 THEN '1.5' ELSE '3' END AS rate, o_orderstatus AS status, 'x' AS one FROM orders"


def _raw(t: Tables) -> DataFrame:
    return t.orders.selectExpr("CASE WHEN o_orderkey % 7 = 0 THEN ' N/A ' ELSE string(o_custkey) END AS customer", "CASE WHEN o_orderkey % 11 = 0 THEN 'never' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS order_date", "CASE WHEN o_orderkey % 2 = 0 THEN '1.5' ELSE '3' END AS rate", "o_orderstatus AS status", "'x' AS one")


_MISSING = "(v IS NULL OR lower(trim(v)) IN ('', 'na', 'n/a', 'null', 'none', 'nan'))"


@query("intake_profile", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({_MISSING}) AS n_missing, count(DISTINCT v) FILTER (NOT {_MISSING}) AS n_distinct, {bad} AS n_invalid_dates, '{kind}' AS inferred_type, {constant} AS constant, {mixed} AS mixed FROM (SELECT {c} AS v FROM ({_RAW}))" for c, bad, kind, constant, mixed in (
    ("customer", "0", "integer", "false", "false"), ("order_date", "count(*) FILTER (v = 'never')", "category", "false", "true"), ("rate", "0", "number", "false", "true"), ("status", "0", "category", "false", "false"), ("one", "0", "category", "true", "false"))))
def intake_profile(t: Tables) -> DataFrame:
    return intake.intake_profile(_raw(t)).select("column_name", "n_rows", "n_missing", "n_distinct", "n_invalid_dates", "inferred_type", "constant", "mixed")


@query("intake_roll_up", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, CAST({k} AS BIGINT) AS n_columns, count(*) * {k} AS n_cells, {nulls} AS n_null, round(coalesce({nulls} / nullif(count(*) * {k}, 0), 0), 6) AS null_share FROM {source}" for n, k, nulls, source in (
    ("nation", 3, "CAST(0 AS BIGINT)", "nation"), ("holes", 2, "count(*) FILTER (c_custkey % 4 = 0)", "customer"))))
def intake_roll_up(t: Tables) -> DataFrame:
    return rounded(intake.roll_up({"nation": t.nation, "holes": t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS v")}), 6)


@query("intake_chart_suggestions", "SELECT * FROM (VALUES ('bar', 'status', 'customer'), ('bar', 'status', 'rate'), ('bar', 'order_date', 'customer'), ('bar', 'order_date', 'rate'), ('histogram', 'customer', NULL), ('histogram', 'rate', NULL)) AS s(chart, x, y)")
def intake_charts(t: Tables) -> DataFrame:
    return intake.chart_suggestions(intake.intake_profile(_raw(t)), [])


@query("gov_privacy_inspection", rf"SELECT 'c_custkey' AS column_name, CAST(0 AS BIGINT) AS by_name, CAST(0 AS BIGINT) AS n_email, CAST(0 AS BIGINT) AS n_phone, CAST(0 AS BIGINT) AS n_card, false AS suspicious UNION ALL SELECT 'customer_name', 1, 0, count(*) FILTER (regexp_matches(c_name, '{text.PHONE}')), count(*) FILTER (regexp_matches(c_name, '{text.CARD}')), true FROM customer UNION ALL SELECT 'note', 0, count(*) FILTER (regexp_matches(v, '{text.EMAIL}')), count(*) FILTER (regexp_matches(v, '{text.PHONE}')), count(*) FILTER (regexp_matches(v, '{text.CARD}')), true FROM ({_CASES})")
def gov_privacy(t: Tables) -> DataFrame:
    return corpus.privacy_inspection(t.customer.selectExpr("c_custkey", "c_name AS customer_name", _CASES_SPARK.removesuffix(" AS v") + " AS note"))


@query("gov_duplicate_files", """WITH f AS (SELECT '/in/' || (doc_id % 3) || '/doc' || (doc_id // 3) || '.txt' AS path, 'doc' || (doc_id // 3) || '.txt' AS name, sha256(text) AS h FROM documents)
SELECT 'same_content' AS kind, h AS value, count(*) AS n, min(path) AS first_path FROM f GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'same_name', name, count(DISTINCT h), min(path) FROM f GROUP BY 2 HAVING count(DISTINCT h) > 1""")
def gov_files(t: Tables) -> DataFrame:
    return corpus.duplicate_files(t.documents.selectExpr("concat('/in/', doc_id % 3, '/doc', doc_id div 3, '.txt') AS path", "text AS content"))


@query("gov_paired_names", """WITH l AS (SELECT n_name AS left_name, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS k FROM nation), r AS (SELECT regexp_replace(lower(v), '[^a-z0-9]', '', 'g') AS k, count(*) AS n, min(v) AS v FROM (SELECT lower(n_name) || '-' AS v FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT upper(n_name) FROM nation WHERE n_nationkey % 6 = 0) GROUP BY 1)
SELECT left_name, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 THEN v END AS right_name, CASE WHEN n = 1 THEN 'high' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS confidence FROM l LEFT JOIN r USING (k)""")
def gov_paired(t: Tables) -> DataFrame:
    right = t.nation.where("n_nationkey % 3 = 0").selectExpr("concat(lower(n_name), '-') AS v").unionByName(t.nation.where("n_nationkey % 6 = 0").selectExpr("upper(n_name) AS v"))
    return corpus.paired(t.nation, "n_name", right, "v")


# orders and limits

@query("order_groups_by_text", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY CAST(c_nationkey AS VARCHAR) LIMIT 7")
def order_groups(t: Tables) -> DataFrame:
    return reports.text_ordered(analytics.aggregate(t.customer, ["c_nationkey"], [Metric("count", None, "n")]), ["c_nationkey"], 7)


@query("anomaly_top", """WITH m AS (SELECT quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem), d AS (SELECT l_orderkey * 100 + l_linenumber AS key, l_extendedprice AS value, abs(l_extendedprice - m) AS d FROM lineitem, m), s AS (SELECT 1.4826 * quantile_cont(d, 0.5) AS s FROM d)
SELECT value, round(d / s, 6) AS score FROM d, s WHERE d / s > 1.2 ORDER BY d / s DESC, key LIMIT 100""")
def anomaly_top(t: Tables) -> DataFrame:
    found = explore.anomalies(t.lineitem.selectExpr("l_orderkey * 100 + l_linenumber AS key", "l_extendedprice"), "key", "l_extendedprice", threshold=1.2)
    return found.orderBy(F.desc("score"), "key").limit(100).select("value", F.round("score", 6).alias("score"))


@query("chart_line", "SELECT date_trunc('month', o_orderdate) AS x, count(*)::DOUBLE AS y, CAST(NULL AS VARCHAR) AS series FROM orders GROUP BY 1 ORDER BY 1 LIMIT 200")
def chart_line(t: Tables) -> DataFrame:
    return reports.chart(t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n")), "line", "month", "n")


@query("chart_bar_series", "SELECT o_orderpriority AS x, round(sum(o_totalprice), 2) AS y, o_orderstatus AS series FROM orders GROUP BY 1, 3")
def chart_bar(t: Tables) -> DataFrame:
    grouped = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("total"))
    return rounded(reports.chart(grouped, "bar", "o_orderpriority", "total", "o_orderstatus"), 2)


@query("chart_forecast", "WITH m AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) SELECT coalesce(a.month, b.month) AS month, a.total AS observed, b.forecast FROM m a FULL JOIN (SELECT month + 12 AS month, total AS forecast FROM m) b ON a.month = b.month")
def chart_forecast(t: Tables) -> DataFrame:
    observed = rounded(series.monthly(t.orders, "o_orderdate", "o_totalprice"), 2)
    return reports.forecast_chart(observed, observed.select((F.col("month") + 12).alias("month"), F.col("total").alias("forecast")))


@query("report_evidence", """WITH g AS (SELECT c_mktsegment, count(*) AS n, round(avg(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END), 4) AS mean FROM customer GROUP BY 1), f AS (SELECT '{"segment":"' || c_mktsegment || '"}' AS scope, n, mean FROM g)
SELECT scope, 'mean' AS metric, mean AS value, n, mean IS NULL AS missing_value, n < 30 AS few_rows, substring(sha256('mean|' || scope), 1, 32) AS finding_id FROM f""")
def report_evidence(t: Tables) -> DataFrame:
    rows = t.customer.selectExpr("c_mktsegment AS segment", "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS v").groupBy("segment").agg(F.count(F.lit(1)).alias("group_rows"), F.avg("v").alias("mean"))
    return rounded(reports.evidence_findings(rows, ["segment"], ["mean"]))


_CLAIMS = "SELECT n_nationkey AS key, n_nationkey * 1.0 + {off} AS value, CASE n_nationkey % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'floating_point' WHEN 2 THEN 'financial' ELSE 'forecast' END AS value_type, 2 AS precision FROM nation"
_OFF = "CASE WHEN n_nationkey % 3 = 0 THEN 0.0 WHEN n_nationkey % 3 = 1 THEN 0.004 ELSE 0.5 END"


@query("report_claims", f"""WITH c AS ({_CLAIMS.format(off=_OFF)}), b AS (SELECT c.*, abs(value - expected) AS d, expected FROM c LEFT JOIN (SELECT n_nationkey AS key, n_nationkey * 1.0 AS expected FROM nation WHERE n_nationkey < 20) e USING (key)),
o AS (SELECT *, CASE value_type WHEN 'count' THEN d = 0 WHEN 'floating_point' THEN d <= greatest(1e-12, 1e-9 * abs(expected)) WHEN 'financial' THEN d <= 0.005 END AS ok FROM b)
SELECT key, value_type, CASE WHEN ok IS NULL THEN 'unverifiable' WHEN ok THEN 'supported' ELSE 'contradicted' END AS verdict, round(d, 6)::DOUBLE AS difference FROM o""")
def report_claims(t: Tables) -> DataFrame:
    claims = t.nation.selectExpr("n_nationkey AS key", f"double(n_nationkey) + {_OFF} AS value", "CASE n_nationkey % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'floating_point' WHEN 2 THEN 'financial' ELSE 'forecast' END AS value_type", "2 AS precision")
    return rounded(reports.verified_claims(claims, t.nation.where("n_nationkey < 20").selectExpr("n_nationkey AS key", "double(n_nationkey) AS expected"), "key"), 6)


@query("report_linked_profile", "SELECT 'l_quantity' AS column_name, true AS reused, CAST(1 AS BIGINT) AS n_findings UNION ALL SELECT 'l_tax', false, 0")
def report_linked(t: Tables) -> DataFrame:
    now = quality.missing(t.lineitem, ["l_quantity", "l_tax"]).join(F.broadcast(t.lineitem.agg(F.count(F.lit(1)).alias("n_rows"))))
    then = now.withColumn("n_rows", F.when(F.col("column_name") == "l_tax", F.col("n_rows") + 1).otherwise(F.col("n_rows")))
    return reports.linked_profile(now, then, now.where("column_name = 'l_quantity'").select("column_name"))


@query("report_pairs", """WITH h AS (SELECT CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS balance, c_nationkey AS nation, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer)
SELECT 'balance' AS a, 'nation' AS b, 'numeric_numeric' AS kind, count(*) FILTER (balance IS NOT NULL) AS n_valid FROM h UNION ALL SELECT 'balance', 'segment', 'numeric_categorical', count(*) FILTER (balance IS NOT NULL AND segment IS NOT NULL) FROM h UNION ALL SELECT 'nation', 'segment', 'numeric_categorical', count(segment) FROM h""")
def report_pairs(t: Tables) -> DataFrame:
    rows = t.customer.selectExpr("CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS balance", "c_nationkey AS nation", "CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment")
    return reports.pair_counts(rows, reports.chosen_pairs(rows))


@query("kpi_returns", """SELECT l_shipdate::DATE AS ship_day, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END), 2) AS net_revenue, round(100 * sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / nullif(sum(l_extendedprice), 0), 2) AS return_rate,
round(100.0 * count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.05) / nullif(count(*) FILTER (l_discount > 0.05), 0), 2) AS precision FROM lineitem GROUP BY 1""")
def kpi_returns(t: Tables) -> DataFrame:
    returned, flagged = F.col("l_returnflag") == "R", F.col("l_discount") > 0.05
    money = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    return t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("ship_day")).agg(
        F.round(money(~returned, F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net_revenue"),
        reports.guarded_ratio(money(returned, F.col("l_extendedprice")), F.sum("l_extendedprice")).alias("return_rate"),
        reports.guarded_ratio(F.count_if(returned & flagged), F.count_if(flagged)).alias("precision"),
    )


@query("kpi_growth", "WITH m AS (SELECT year(o_orderdate)::BIGINT AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) SELECT year, total, round(100 * (total - lag(total) OVER (ORDER BY year)) / abs(lag(total) OVER (ORDER BY year)), 4) AS change FROM m")
def kpi_growth(t: Tables) -> DataFrame:
    years = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rounded(reports.growth(years, "year", "total"))


@query("kpi_weighted_mean", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted, round((max(l_extendedprice) / min(l_extendedprice)) ** (1.0 / 5) - 1, 6) AS compound FROM lineitem GROUP BY 1")
def kpi_weighted(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy("l_returnflag").agg((F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity")).alias("weighted"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return c.select("l_returnflag", F.round("weighted", 4).alias("weighted"), F.round(reports.compound_growth(F.col("lo"), F.col("hi"), F.lit(5.0)), 6).alias("compound"))


# rules

@query("rules_findings", """WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' ' || c_mktsegment END AS segment, 'x' AS one, c_custkey % 100 AS k FROM customer), n AS (SELECT count(*) AS n FROM h),
f AS (SELECT 'missing_values' AS rule_id, 'balance' AS column_name, count(*) FILTER (balance IS NULL) AS affected, count(*) AS total FROM h UNION ALL SELECT 'missing_values', 'segment', count(*) FILTER (segment = ''), count(*) FROM h
UNION ALL SELECT 'whitespace', 'segment', count(*) FILTER (segment <> ''), count(*) FROM h UNION ALL SELECT 'constant_column', 'one', count(*), count(*) FROM h UNION ALL SELECT 'business_key', 'k', count(*) - count(DISTINCT k), count(*) FROM h)
SELECT substring(sha256('customer|' || rule_id || '|' || column_name), 1, 32) AS finding_id, rule_id, column_name, affected, total, CASE WHEN affected / total < 0.01 THEN 'low' WHEN affected / total < 0.1 THEN 'medium' ELSE 'high' END AS severity FROM f WHERE affected > 0""")
def rules_findings(t: Tables) -> DataFrame:
    rows = t.customer.selectExpr("c_custkey", "CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS balance", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(' ', c_mktsegment) END AS segment", "'x' AS one", "c_custkey % 100 AS k")
    return rules.findings(rows, {"business_key": {"key": ["k"]}, "outliers": {"columns": ["c_custkey"], "threshold": 9.0}}, "customer")


_KINDS = {"missing_values": "ready", "constant_column": "ready", "duplicate_rows": "ready", "business_key": "needs_context"}
_EVERY = " + ".join(f"count({c})" for c in ("doc_id", "text", "lang", "source", "n_chars"))


@query("rules_plan", " UNION ALL ".join([f"SELECT '{r}' AS rule_id, '{s}' AS status, CAST(5 AS BIGINT) AS n_columns, {_EVERY} AS n_values FROM documents" for r, s in _KINDS.items()]) + """
UNION ALL SELECT 'non_finite', 'not_applicable', 0, 0 UNION ALL SELECT 'outliers', 'invalid', 2, count(doc_id) + count(n_chars) FROM documents UNION ALL SELECT 'whitespace', 'ready', 3, count(text) + count(lang) + count(source) FROM documents""")
def rules_plan(t: Tables) -> DataFrame:
    return rules.planned(t.documents.select("doc_id", "text", "lang", "source", "n_chars"), {"outliers": {"method": 3}})


@query("quality_coerced_numbers", "SELECT count(*) FILTER (v <> '') AS n_values, count(*) FILTER (v <> '' AND TRY_CAST(v AS DOUBLE) IS NOT NULL) AS n_numeric, false AS all_numeric FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN '1.5e3' ELSE p_brand END AS v FROM part)")
def coerced(t: Tables) -> DataFrame:
    return quality.coerced_numbers(t.part.selectExpr("CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN concat(' ', string(p_size)) WHEN 2 THEN '1.5e3' ELSE p_brand END AS v"), "v")


@query("quality_type_families", "SELECT 'v' AS column_name, count(*) FILTER (p_partkey % 4 < 2) AS number, count(*) FILTER (p_partkey % 4 = 2) AS boolean, CAST(0 AS BIGINT) AS date, count(*) FILTER (p_partkey % 4 = 3) AS text, false AS consistent FROM part")
def families(t: Tables) -> DataFrame:
    return quality.type_families(t.part.selectExpr("CASE p_partkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '1.5' WHEN 2 THEN 'TRUE' ELSE p_name END AS v"), ["v"])


# rankings and supervised evaluation

_RANKED = "SELECT quality AS y, round(least(1.0, greatest(0.0, n_chars / 2000.0)), 2) AS p FROM labels JOIN documents USING (doc_id)"


@query("cls_ranking", f"""WITH r AS ({_RANKED}), s AS (SELECT p, count(*) AS n, sum(y) AS h FROM r GROUP BY 1), u AS (SELECT *, sum(n) OVER (ORDER BY p) - n AS b, sum(h) OVER (ORDER BY p) - h AS hb, sum(n) OVER () AS t, sum(h) OVER () AS pos FROM s)
SELECT CAST(max(t) AS BIGINT) AS n, CAST(max(pos) AS BIGINT) AS n_positive, round(sum(h * (b - hb + (n - h) / 2)) / max(pos * (t - pos)), 6) AS roc_auc, round(sum(h * (pos - hb) / (t - b)) / max(pos), 6) AS average_precision, (SELECT round(avg((p - y) ** 2), 6) FROM r) AS brier FROM u""")
def cls_ranking(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").selectExpr("quality AS y", "double(round(least(1.0, greatest(0.0, n_chars / 2000.0)), 2)) AS p")
    return rounded(scoring.ranking_scores(rows, "y", "p"), 6)


@query("cls_summary", "WITH g AS (SELECT quality AS l, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)), s AS (SELECT k.l, count(*) FILTER (g.l = k.l) AS n, count(*) FILTER (g.l = k.l AND g.p = k.l) AS hit, count(*) FILTER (g.p = k.l) AS guess FROM g, (SELECT DISTINCT l FROM g) k GROUP BY 1), f AS (SELECT *, coalesce(2.0 * hit / nullif(n + guess, 0), 0) AS f1 FROM s) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(hit) / sum(n), 6) AS accuracy, round(avg(hit / n), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(sum(n * f1) / sum(n), 6) AS weighted_f1 FROM f")
def cls_summary(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").selectExpr("quality AS y", "CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS p")
    return rounded(scoring.classification_scores(rows, "y", "p"), 6)


@query("ml_regression")
def ml_regression(t: Tables) -> DataFrame:
    rows = scoring.hash_split(t.lineitem.select("l_orderkey", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate", "l_returnflag"), "l_orderkey")
    r = supervised.evaluate(rows, "l_extendedprice", ["l_quantity", "l_discount", "l_returnflag"], "regression")
    verdict = reports.promotion(r.test["mae"], r.baseline["mae"], "minimize", r.test["n"], 30)
    return t.spark.createDataFrame([(r.chosen, r.test["n"], r.test["mae"], r.test["r2"], r.baseline["mae"], verdict)], "chosen string, n long, mae double, r2 double, baseline_mae double, verdict string")


@query("ml_classification")
def ml_classification(t: Tables) -> DataFrame:
    rows = scoring.hash_split(t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id"), "doc_id")
    r = supervised.evaluate(rows, "quality", ["n_chars", "lang", "source"], "classification")
    return t.spark.createDataFrame([(r.chosen, int(r.test["n"]), r.test["accuracy"], r.test["roc_auc"], r.baseline["accuracy"])], "chosen string, n long, accuracy double, roc_auc double, baseline_accuracy double")


@query("ml_suitability", """WITH c AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS classes, count(DISTINCT o_totalprice) AS prices, count(o_orderdate) AS dates FROM orders)
SELECT 'anomaly_detection' AS task, prices >= 2 AND n >= 8 AS suitable FROM c UNION ALL SELECT 'classification', (classes BETWEEN 2 AND 32 OR prices BETWEEN 2 AND 32) AND n >= 30 FROM c UNION ALL SELECT 'descriptive', n > 0 FROM c UNION ALL SELECT 'forecasting', dates > 0 AND prices >= 2 AND n >= 15 FROM c UNION ALL SELECT 'regression', false FROM c""")
def ml_suitability(t: Tables) -> DataFrame:
    kinds = {"o_orderdate": "timestamp", "o_totalprice": "number", "o_orderstatus": "string"}
    n = t.orders.count()
    found = supervised.task_suitability(quality.profile(t.orders, list(kinds)), kinds, n)
    return t.spark.createDataFrame([(r["task"], r["suitable"]) for r in found], "task string, suitable boolean")


@query("ts_calendar", "SELECT month, round(sin(2 * pi() * (month % 12) / 12), 6) + 0.0 AS s, round(cos(2 * pi() * (month % 12) / 12), 6) + 0.0 AS c FROM (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS month FROM orders)")
def ts_calendar(t: Tables) -> DataFrame:
    sine, cosine = cycle(F.col("month"))
    return series.monthly(t.orders, "o_orderdate", "o_totalprice").select("month", (F.round(sine, 6) + 0.0).alias("s"), (F.round(cosine, 6) + 0.0).alias("c"))


# corpora and charts

@query("gov_similar_prompts")
def gov_similar(t: Tables) -> DataFrame:
    prompts = t.conversations.where("turn = 0")
    return corpus.similar_texts(prompts.where("conv_id % 100 = 0"), prompts, "conv_id", "text", 0.3)


@query("chart_objectives", """WITH o AS (SELECT n_nationkey, ['trend', 'ranking', 'composition', 'distribution', 'flow', 'unknown'][n_nationkey % 6 + 1] AS objective, n_nationkey % 9 AS cats, n_nationkey % 2 + 1 AS series FROM nation)
SELECT n_nationkey, CASE WHEN n_nationkey = 24 THEN 'table' WHEN objective = 'trend' THEN CASE WHEN n_nationkey % 4 = 0 THEN 'table' ELSE 'line_chart' END WHEN objective = 'ranking' THEN CASE WHEN series > 1 THEN 'grouped_bar' ELSE 'ranked_bar' END WHEN objective = 'composition' THEN CASE WHEN cats BETWEEN 2 AND 6 THEN 'donut_chart' ELSE 'stacked_bar' END WHEN objective = 'distribution' THEN CASE WHEN cats > 1 THEN 'box_plot' ELSE 'histogram' END WHEN objective = 'flow' THEN 'sankey' ELSE 'table' END AS chart FROM o""")
def chart_objectives(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    objective = F.element_at(F.array(*[F.lit(x) for x in ("trend", "ranking", "composition", "distribution", "flow", "unknown")]), (k % 6 + 1).cast("int"))
    profiles = t.nation.select("n_nationkey", objective.alias("objective"), (k % 9).alias("n_categories"), (k % 2 + 1).alias("n_series"), (k % 4 != 0).alias("has_time"), (k != 24).alias("enough"))
    return corpus.charts_for(profiles, "n_nationkey")


@query("gov_bundle_faults", "SELECT n_nationkey::BIGINT AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'changed' WHEN n_nationkey % 5 = 1 THEN 'lost' ELSE 'added' END AS fault FROM nation WHERE n_nationkey % 5 < 3")
def gov_bundle(t: Tables) -> DataFrame:
    rows = t.nation.withColumn("n_nationkey", F.col("n_nationkey").cast("long"))
    then = corpus.record_digests(rows.where("n_nationkey % 5 <> 2"), "n_nationkey")
    now = rows.where("n_nationkey % 5 <> 1").withColumn("n_name", F.expr("CASE WHEN n_nationkey % 5 = 0 THEN upper(concat(n_name, '!')) ELSE n_name END"))
    return corpus.bundle_faults(then, corpus.record_digests(now, "n_nationkey"))


@query("eda_contingency_labels", "WITH a AS (SELECT DISTINCT o_orderstatus AS a FROM orders ORDER BY 1 LIMIT 2), b AS (SELECT DISTINCT o_orderpriority AS b FROM orders WHERE o_orderstatus IN (SELECT a FROM a) ORDER BY 1 LIMIT 2) SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders WHERE o_orderstatus IN (SELECT a FROM a) AND o_orderpriority IN (SELECT b FROM b) GROUP BY 1, 2")
def eda_labels(t: Tables) -> DataFrame:
    return explore.contingency(t.orders, "o_orderstatus", "o_orderpriority", 2)


@query("eda_report", """WITH f AS (SELECT 'o_orderstatus' AS column_name, 'frequency' AS section, o_orderstatus AS item, count(*)::DOUBLE AS value FROM orders GROUP BY 3), e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
h AS (SELECT least(9, floor((o_totalprice - lo) / (hi - lo) * 10))::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1),
s AS (SELECT unnest([('n_rows', count(*)::DOUBLE), ('n_valid', count(o_totalprice)::DOUBLE), ('n_null', 0.0), ('mean', avg(o_totalprice)), ('variance', var_samp(o_totalprice)), ('stddev', stddev_samp(o_totalprice)), ('minimum', min(o_totalprice)), ('maximum', max(o_totalprice)), ('value_range', max(o_totalprice) - min(o_totalprice)),
('p5', quantile_cont(o_totalprice, 0.05)), ('p25', quantile_cont(o_totalprice, 0.25)), ('p50', quantile_cont(o_totalprice, 0.5)), ('p75', quantile_cont(o_totalprice, 0.75)), ('p95', quantile_cont(o_totalprice, 0.95))]) AS p FROM orders)
SELECT column_name, section, item, value FROM f UNION ALL SELECT 'o_totalprice', 'summary', p[1], round(p[2], 0) FROM s UNION ALL SELECT 'o_totalprice', 'histogram', b.bin::VARCHAR, coalesce(n, 0)::DOUBLE FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN h ON b.bin = h.bin""")
def eda_report(t: Tables) -> DataFrame:
    return rounded(explore.eda_report(t.orders, ["o_orderstatus", "o_totalprice"]), 0)


@query("ts_backtest_trend", """WITH m AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
b AS (SELECT lag(month) OVER (ORDER BY month) AS origin, month, total, regr_intercept(total, month) OVER w + regr_slope(total, month) OVER w * month AS predicted, row_number() OVER (ORDER BY month DESC) AS nth FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT origin, month, total, round(predicted, 0) AS predicted, round(predicted - total, 0) AS error FROM b WHERE nth <= 12 AND predicted IS NOT NULL""")
def ts_backtest_trend(t: Tables) -> DataFrame:
    found = series.backtest_trend(rounded(series.monthly(t.orders, "o_orderdate", "o_totalprice"), 2))
    return found.withColumns({"predicted": F.round("predicted", 0), "error": F.round("error", 0)})


@query("text_tagged_json", "SELECT count(*) AS n, count(*) AS same, CAST(0 AS BIGINT) AS wrong_type FROM embeddings")
def text_tagged(t: Tables) -> DataFrame:
    tagged = t.embeddings.select("embedding", text.tagged_json("array<float>", F.col("embedding")).alias("j"))
    back, other = text.untagged("array<float>", F.col("j")), text.untagged("array<string>", F.col("j"))
    return tagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(back == F.col("embedding")).alias("same"), F.count_if(other.isNotNull()).alias("wrong_type"))


@query("kpi_measures", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_revenue, round(100 * sum(l_extendedprice * l_discount) / sum(l_extendedprice), 4) AS discount_rate, sum(l_quantity) AS units, round(sum(l_extendedprice) / sum(l_quantity), 4) AS average_price, count(*) AS lines, round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 4) AS return_rate, max(l_extendedprice) AS largest_line FROM lineitem GROUP BY 1")
def kpi_measures(t: Tables) -> DataFrame:
    names = ["revenue", "net_revenue", "discount_rate", "units", "average_price", "lines", "return_rate", "largest_line"]
    out = reports.measures(t.lineitem, names, {"price": "l_extendedprice", "discount": "l_discount", "quantity": "l_quantity", "returned": "l_linestatus = 'F'"}, ["l_returnflag"])
    return out.withColumns({n: F.round(n, 2 if "revenue" in n else 4) for n in ("revenue", "net_revenue", "discount_rate", "average_price", "return_rate")})
