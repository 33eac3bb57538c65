"""Queries of exact sums, forecasts by series, typed and sealed tables, splits, tolerant row sets and bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import output_text
from cairn.operators import analytics, backtests, bundles, corpus, rowsets, schema, splits
from cairn.operators.analytics import Metric
from cairn.plans.catalog import Tables, query, rounded
from cairn.sources import sealed, typed
from cairn.sources.shared import shared_folder


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/query-{uuid.uuid4().hex}"


# exact sums: nothing is rounded on either side

_MIXED = "CASE o_orderkey % 4 WHEN 0 THEN 1e16 WHEN 1 THEN 0.001 WHEN 2 THEN -1e16 ELSE o_totalprice END"
_TEXT = "CAST(CAST(sum(CAST({} AS DECIMAL(38, 3))) AS VARCHAR) AS DOUBLE)"


@query("sum_exact_mixed", f"SELECT o_orderpriority, {_TEXT.format(_MIXED)} AS total, count(*) AS n, {_TEXT.format('o_totalprice')} AS price, {_TEXT.format('o_totalprice')} / count(*) AS mean_price FROM orders GROUP BY 1")
def sum_exact(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("*", f"double({_MIXED}) AS x")
    return analytics.aggregate(rows, ["o_orderpriority"], [Metric("sum", "x", "total"), Metric("count", None, "n"), Metric("sum", "o_totalprice", "price"), Metric("average", "o_totalprice", "mean_price")])


# forecasts of many series from many origins

_SERIES = "SELECT o_orderpriority AS k, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / 1000 AS total FROM orders GROUP BY 1, 2"
_X = ["1.0", "CAST(i AS DOUBLE)", "sin(2 * pi() * (i % 12) / 12)", "cos(2 * pi() * (i % 12) / 12)"]


def _solved_sql(horizon: int) -> str:
    """Normal equations by running sums and Gaussian elimination, one step a subquery, ending in folds."""
    steps = [f"s AS ({_SERIES}), r AS (SELECT *, month - min(month) OVER (PARTITION BY k) AS i, count(*) OVER (PARTITION BY k) AS n, max(month) OVER (PARTITION BY k) - min(month) OVER (PARTITION BY k) + 1 AS span FROM s)"]
    sums = ", ".join([f"sum(({_X[i]}) * ({_X[j]})) OVER w AS a{i}{j}" for i in range(4) for j in range(4)] + [f"sum(({_X[i]}) * total) OVER w AS a{i}4" for i in range(4)])
    steps.append(f"e0 AS (SELECT *, {sums} FROM r WHERE n = span AND n BETWEEN 15 AND 240 WINDOW w AS (PARTITION BY k ORDER BY i))")
    for p in range(4):
        cells = ", ".join(f"a{i}{j} - a{i}{p} * a{p}{j} / a{p}{p} AS a{i}{j}" for i in range(4) if i != p for j in range(p, 5))
        steps.append(f"e{p + 1} AS (SELECT * REPLACE ({cells}) FROM e{p})")
    steps.append(f"o AS (SELECT *, i + 1 AS train, n - {horizon} - least(12, n - {horizon} - 12 + 1) + 1 AS first FROM e4 WHERE n - {horizon} >= 12)")
    fit = " + ".join(f"a{i}4 / a{i}{i} * ({_X[i].replace('i', '(o.i + lead)').replace('s(o.i + lead)n', 'sin').replace('p(o.i + lead)()', 'pi()')})" for i in range(4))
    steps.append(f"""f AS (SELECT o.k, o.train, CAST(lead AS BIGINT) AS lead, r.month, r.total AS actual, {fit} AS predicted, o.total AS last_observation,
(SELECT y.total FROM r y WHERE o.first >= 24 AND y.k = o.k AND y.i = o.train - 12 + (lead - 1) % 12) AS seasonal
FROM o, (SELECT unnest(range(1, {horizon + 1})) AS lead), r WHERE o.train BETWEEN o.first AND o.n - {horizon} AND r.k = o.k AND r.i = o.i + lead)""")
    return "WITH " + ",\n".join(steps)


def _series(t: Tables) -> DataFrame:
    exact = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1000
    return t.orders.groupBy(F.col("o_orderpriority").alias("k"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("long").alias("month")).agg(exact.alias("total"))


@query("ts_expanding_folds", _solved_sql(3) + "\nSELECT k, train, lead, month, round(actual, 2) AS actual, round(predicted, 2) AS predicted, round(last_observation, 2) AS last_observation, round(seasonal, 2) AS seasonal FROM f")
def ts_folds(t: Tables) -> DataFrame:
    return rounded(backtests.expanding_folds(_series(t), ["k"], 3), 2)


@query("ts_fold_scores", _solved_sql(3) + """,
g AS (SELECT k, 'candidate' AS model, predicted - actual AS e, actual FROM f UNION ALL SELECT k, 'last_observation', last_observation - actual, actual FROM f UNION ALL SELECT k, 'seasonal_naive_12', seasonal - actual, actual FROM f WHERE seasonal IS NOT NULL),
m AS (SELECT k, model, count(*) AS n, avg(abs(e)) AS mae, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(e) AS mean_error, 100 * sum(abs(e)) / sum(abs(actual)) AS wape FROM g GROUP BY 1, 2),
c AS (SELECT m.*, m.mae - o.mae AS better, greatest(1e-9, abs(m.mae) * 0.01) AS slack FROM m JOIN m o ON o.k = m.k AND o.model = 'candidate')
SELECT k, model, n, round(mae, 2) AS mae, round(mse, 0) AS mse, round(rmse, 2) AS rmse, round(mean_error, 2) AS mean_error, round(wape, 4) AS wape, CASE WHEN model <> 'candidate' THEN round(better, 2) END AS improvement,
CASE WHEN model = 'candidate' THEN NULL WHEN better > slack THEN 'beats_baseline' WHEN better >= -slack THEN 'within_tolerance' ELSE 'worse_than_baseline' END AS outcome FROM c""")
def ts_scores(t: Tables) -> DataFrame:
    out = backtests.fold_scores(backtests.expanding_folds(_series(t), ["k"], 3), ["k"])
    digits = {"mse": 0, "wape": 4}
    return out.withColumns({c: F.round(c, digits.get(c, 2)) for c in ("mae", "mse", "rmse", "mean_error", "wape", "improvement")})


@query("ts_error_envelope", _solved_sql(3) + "\nSELECT k, lead, count(*) AS n, round(list_sort(list(abs(predicted - actual)))[CAST(ceil(count(*) * 0.9) AS BIGINT)], 2) AS bound FROM f GROUP BY 1, 2 HAVING count(*) >= 8")
def ts_envelope(t: Tables) -> DataFrame:
    return rounded(backtests.error_envelope(backtests.expanding_folds(_series(t), ["k"], 3), ["k"]), 2)


_AHEAD = " + ".join(f"a{i}4 / a{i}{i} * ({x})" for i, x in enumerate(["1.0", "(i + lead)", "sin(2 * pi() * ((i + lead) % 12) / 12)", "cos(2 * pi() * ((i + lead) % 12) / 12)"]))


@query("ts_forecasts", _solved_sql(3) + f"\nSELECT k, CAST(lead AS BIGINT) AS lead, month + lead AS month, round({_AHEAD}, 2) AS predicted FROM e4, (SELECT unnest(range(1, 7)) AS lead) WHERE i = n - 1")
def ts_forecasts(t: Tables) -> DataFrame:
    return rounded(backtests.forecasts(_series(t), ["k"], 6), 2)


@query("ts_fold_warnings", f"""WITH s AS ({_SERIES}), c AS (SELECT k, count(*) AS n, max(month) - min(month) + 1 AS span FROM s GROUP BY 1), o AS (SELECT *, CASE WHEN n <> span OR n < 15 OR n > 240 THEN 0 ELSE greatest(0, least(12, n - 14)) END AS origins FROM c)
SELECT k, n AS n_months, CASE WHEN n <> span THEN 'months are missing' WHEN n < 15 THEN 'too short' WHEN n > 240 THEN 'too long' ELSE 'ok' END AS status, CAST(origins AS BIGINT) AS n_origins,
concat_ws('; ', CASE WHEN origins = 0 THEN 'no origin has enough months' END, CASE WHEN origins BETWEEN 1 AND 7 THEN 'too few origins for an envelope' END, CASE WHEN n < 24 THEN 'fewer than 24 months' END) AS warnings FROM o""")
def ts_warnings(t: Tables) -> DataFrame:
    return backtests.fold_warnings(_series(t), ["k"], 3).withColumn("warnings", F.concat_ws("; ", "warnings"))


# typed tables from texts

_AT = "CASE WHEN o_orderkey % 3 = 0 THEN {day} ELSE {second} END"


def _texts(t: Tables) -> DataFrame:
    at = _AT.format(day="date_format(o_orderdate, 'yyyy-MM-dd')", second="date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')")
    code = "CASE WHEN o_orderkey % 7 = 0 THEN concat('0', o_custkey) ELSE string(o_custkey) END"
    return t.orders.selectExpr("string(o_orderkey) AS o_orderkey", f"{code} AS code", "string(cast(o_totalprice AS decimal(18,2))) AS price", f"{at} AS at", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "CASE WHEN o_orderkey % 5 > 0 THEN string(o_orderstatus = 'F') ELSE '' END AS done")


@query("ingest_types", """SELECT 'o_orderkey' AS column_name, 'integer' AS kind, 'bigint' AS type, count(*) AS n_values FROM orders UNION ALL SELECT 'code', CASE WHEN count(*) FILTER (o_orderkey % 7 = 0) > 0 THEN 'text' ELSE 'integer' END, CASE WHEN count(*) FILTER (o_orderkey % 7 = 0) > 0 THEN 'string' ELSE 'bigint' END, count(*) FROM orders
UNION ALL SELECT 'price', 'number', 'decimal(' || (max(length(CAST(CAST(floor(abs(o_totalprice)) AS BIGINT) AS VARCHAR))) + 2) || ',2)', count(*) FROM orders UNION ALL SELECT 'at', CASE WHEN count(*) FILTER (o_orderkey % 3 > 0) > 0 THEN 'timestamp' ELSE 'date' END, CASE WHEN count(*) FILTER (o_orderkey % 3 > 0) > 0 THEN 'timestamp_ntz' ELSE 'date' END, count(*) FROM orders
UNION ALL SELECT 'day', 'date', 'date', count(o_orderdate) FROM orders UNION ALL SELECT 'done', 'boolean', 'boolean', count(*) FILTER (o_orderkey % 5 > 0) FROM orders""")
def ingest_types(t: Tables) -> DataFrame:
    found = typed.infer(_texts(t))  # one row a column
    return t.spark.createDataFrame([(f.column, f.kind, f.type, f.n_values) for f in found], "column_name string, kind string, type string, n_values long")


@query("ingest_typed_orders", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE '' END || o_custkey AS code, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS price, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('day', o_orderdate)::TIMESTAMP ELSE date_trunc('second', o_orderdate)::TIMESTAMP END AS at, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus = 'F' END AS done FROM orders""")
def ingest_orders(t: Tables) -> DataFrame:
    return typed.typed(_texts(t)).withColumns({"price": F.col("price").cast("double"), "at": F.col("at").cast("timestamp")})


@query("ingest_rejected", "SELECT o_orderkey AS row, 'code' AS column_name, o_orderpriority AS value, 'bigint' AS type FROM orders WHERE o_orderkey % 11 = 0")
def ingest_rejected(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority WHEN o_orderkey % 4 = 0 THEN '' ELSE string(o_custkey) END AS code")
    return typed.rejected(rows, {"code": "bigint"}, "o_orderkey")


@query("output_form", """SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CASE WHEN l_discount = floor(l_discount) THEN CAST(CAST(l_discount AS BIGINT) AS VARCHAR) ELSE CAST(l_discount AS VARCHAR) END AS discount, lower(hex(l_returnflag)) AS flag FROM lineitem""")
def output_form(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_returnflag").cast("binary").alias("flag"))
    return rows.select("l_orderkey", "l_linenumber", *[output_text(rows.schema[c].dataType, F.col(c)).alias(c) for c in ("quantity", "discount", "flag")])


# sealed tables

@query("store_sealed_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def store_scan(t: Tables) -> DataFrame:
    root = _folder(t)
    path, _ = sealed.write_sealed(t.orders, root)
    sealed.write_sealed(t.orders.repartition(3), root)  # the same rows: verified, not written again
    return sealed.read_sealed(t.spark, path, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("store_manifest", "SELECT count(*) AS rows FROM lineitem")
def store_manifest(t: Tables) -> DataFrame:
    path, _ = sealed.write_sealed(t.lineitem, _folder(t))
    return t.spark.createDataFrame([(sealed.verify(t.spark, path)["rows"],)], "rows long")


_ROW = " || ".join(f"'v' || length({c}) || ':' || {c}" for c in ("CAST(c_custkey AS VARCHAR)", "c_name", "c_mktsegment"))


@query("store_ordered_digest", f"""WITH r AS (SELECT sha256({_ROW}) AS h, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer), a AS (SELECT place // 16384 AS chunk, sha256(unhex(string_agg(h, '' ORDER BY place))) AS h FROM r GROUP BY 1)
SELECT CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(unhex(string_agg(h, '' ORDER BY chunk))) END AS digest FROM a""")
def store_digest(t: Tables) -> DataFrame:
    path = _folder(t)
    t.customer.select("c_custkey", "c_name", "c_mktsegment").repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey").write.parquet(path)
    return t.spark.createDataFrame([(sealed.ordered_digest(t.spark, path),)], "digest string")


# splits

@query("split_stratified", """WITH c AS (SELECT lang, count(*) AS n, round(count(*) * 0.6::DOUBLE) AS a, round(count(*) * 0.8::DOUBLE) AS b FROM documents GROUP BY 1)
SELECT * FROM (SELECT lang, 'train' AS split, CAST(a AS BIGINT) AS n FROM c UNION ALL SELECT lang, 'validation', CAST(b - a AS BIGINT) FROM c UNION ALL SELECT lang, 'test', CAST(n - b AS BIGINT) FROM c) WHERE n > 0""")
def split_stratified(t: Tables) -> DataFrame:
    return splits.stratified_split(t.documents.select("doc_id", "lang"), "lang", "doc_id").groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query("split_groups", "SELECT o_custkey, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_splits FROM orders GROUP BY 1")
def split_groups(t: Tables) -> DataFrame:
    out = splits.group_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey")
    return out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("split").alias("n_splits"))


@query("split_group_shares", "SELECT 'train' AS split, true AS within FROM orders GROUP BY 1 UNION ALL SELECT 'validation', count(*) > 0 FROM orders UNION ALL SELECT 'test', count(*) > 0 FROM orders")
def split_shares(t: Tables) -> DataFrame:
    out = splits.group_split(t.orders.select("o_orderkey", "o_custkey"), "o_custkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    want = F.when(F.col("split") == "train", 0.6).otherwise(0.2)
    # to 2 per cent of all rows, beside the largest customer
    edges = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m").alias("all"), F.max("m").alias("most"))
    return out.join(F.broadcast(edges)).select("split", (F.abs(F.col("n") - want * F.col("all")) <= F.greatest(0.02 * F.col("all"), F.col("most"))).alias("within"))


_LINKED = "SELECT o_orderkey AS id, 'a=' || (o_orderkey // 6) AS a, CASE WHEN o_orderkey % 5 < 2 THEN 'b=' || ((o_orderkey + 3) // 6) END AS b FROM orders"


@query("split_connected", f"""WITH RECURSIVE l AS ({_LINKED}), e AS (SELECT DISTINCT a AS x, b AS y FROM l WHERE b IS NOT NULL), u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT a AS v, a AS w FROM l UNION SELECT r.v, u.y FROM r JOIN u ON u.x = r.w) SELECT l.id AS row, m.component FROM l JOIN (SELECT v, min(w) AS component FROM r GROUP BY 1) m ON m.v = l.a""")
def split_connected(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey AS id", "floor(o_orderkey / 6) AS a", "CASE WHEN o_orderkey % 5 < 2 THEN floor((o_orderkey + 3) / 6) END AS b")
    return splits.connected(rows, "id", ["a", "b"])


@query("split_connected_faults", "SELECT fault, value, n FROM (SELECT 'no b' AS fault, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM orders WHERE o_orderkey % 5 >= 2) WHERE n > 0")
def split_connected_faults(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey AS id", "floor(o_orderkey / 6) AS a", "CASE WHEN o_orderkey % 5 < 2 THEN floor((o_orderkey + 3) / 6) END AS b")
    dealt = splits.connected_split(rows, "id", ["a", "b"]).select(F.col("row").alias("id"), "split")
    return splits.split_faults(rows.join(dealt, "id"), "id", ["a", "b"])


# row sets and bundles

_NEAR = "SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 17 <> 3"
_THEN = "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) + (o_orderkey % 5 - 2) * 0.01 AS DOUBLE) AS v FROM orders WHERE o_orderkey % 13 <> 5"


@query("rows_within_tolerance", f"""WITH e AS ({_NEAR}), a AS ({_THEN}), j AS (SELECT coalesce(e.o_orderkey, a.o_orderkey) AS o_orderkey, e.v AS e, a.v AS a, abs(CAST(e.v AS DECIMAL(18, 2)) - CAST(a.v AS DECIMAL(18, 2))) <= 0.01 AS near FROM e FULL JOIN a USING (o_orderkey))
SELECT o_orderkey, e AS expected, a AS actual, 'matched' AS status, CAST(1 AS BIGINT) AS n FROM j WHERE near UNION ALL SELECT o_orderkey, e, NULL, 'missing', 1 FROM j WHERE e IS NOT NULL AND near IS NOT TRUE UNION ALL SELECT o_orderkey, NULL, a, 'surplus', 1 FROM j WHERE a IS NOT NULL AND near IS NOT TRUE""")
def rows_tolerance(t: Tables) -> DataFrame:
    expected = t.orders.where("o_orderkey % 17 <> 3").selectExpr("o_orderkey", "o_totalprice AS v")
    actual = t.orders.where("o_orderkey % 13 <> 5").selectExpr("o_orderkey", "double(cast(o_totalprice AS decimal(18,2)) + (o_orderkey % 5 - 2) * 0.01BD) AS v")
    return rowsets.match_rows(expected, actual, ["o_orderkey"], "v", "0.01")


@query("rows_within_tolerance_report", f"""WITH e AS ({_NEAR}), a AS ({_THEN}), j AS (SELECT e.v AS e, a.v AS a, coalesce(abs(CAST(e.v AS DECIMAL(18, 2)) - CAST(a.v AS DECIMAL(18, 2))) <= 0.01, false) AS near FROM e FULL JOIN a USING (o_orderkey))
SELECT count(e) AS n_expected, count(a) AS n_actual, count(*) FILTER (near) AS n_matched, count(e) FILTER (NOT near) AS n_missing, count(a) FILTER (NOT near) AS n_surplus, count(*) FILTER (NOT near) = 0 AS equal FROM j""")
def rows_report(t: Tables) -> DataFrame:
    return rowsets.match_report(rows_tolerance(t))


_LINE = """'{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}'"""


@query("bundle_shards", f"""WITH l AS (SELECT c_mktsegment, {_LINE} || chr(10) AS line FROM customer), p AS (SELECT *, sum(strlen(line)) OVER w - strlen(line) AS start, row_number() OVER w AS nth FROM l WINDOW w AS (ORDER BY c_mktsegment, sha256(substring(line, 1, length(line) - 1)) ROWS UNBOUNDED PRECEDING))
SELECT CAST(start // 5000 AS BIGINT) AS shard, count(*) AS n_records, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes, sha256(string_agg(line, '' ORDER BY nth)) AS sha256 FROM p GROUP BY 1""")
def bundle_shards(t: Tables) -> DataFrame:
    path = _folder(t)
    manifest = bundles.write_bundle(t.customer.select("c_custkey", "c_name", "c_mktsegment"), path, ["c_mktsegment"], 5000)
    if bundles.bundle_faults(t.spark, path):
        raise ValueError("the bundle has changed")
    return t.spark.createDataFrame([(s["shard"], s["n_records"], s["n_bytes"], s["sha256"]) for s in manifest["shards"]], "shard long, n_records long, n_bytes long, sha256 string")


# roles of columns, and corpora under review

_ROLES = [("o_orderkey", "key"), ("o_custkey", "key"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "time"), ("o_orderpriority", "text")]
_ROLE_SQL = {
    "key": "concat_ws(',', 'identifier', CASE WHEN NOT refers THEN 'degenerate_dimension' END)",
    "text": "concat_ws(',', CASE WHEN u >= 0.8 THEN 'identifier' END, CASE WHEN d <= 20 OR u < 0.8 THEN 'descriptive' END)",
    "number": "concat_ws(',', CASE WHEN u >= 0.8 THEN 'identifier' END, 'measure')",
    "time": "concat_ws(',', CASE WHEN u >= 0.8 THEN 'identifier' END, 'temporal')",
}


@query("schema_column_roles", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_ROLE_SQL[k]} AS roles FROM (SELECT count(DISTINCT {c}) AS d, count(DISTINCT {c}) / count({c}) AS u, {'true' if c == 'o_custkey' else 'false'} AS refers FROM orders)" for c, k in _ROLES))
def schema_roles(t: Tables) -> DataFrame:
    return schema.column_roles(t.orders.select(*[c for c, _ in _ROLES]), {"o_custkey"})


_STATE = "CASE o_custkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'pending' WHEN 2 THEN 'approved' ELSE 'rejected' END"
_NEXT = "CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'draft' END"
_SPLIT = "CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END"


@query("gov_approved_export", f"SELECT o_orderkey, {_SPLIT} AS split FROM orders WHERE {_STATE} = 'approved'")
def gov_approved(t: Tables) -> DataFrame:
    return corpus.approved(t.orders.selectExpr("o_orderkey", f"{_STATE} AS state", f"{_SPLIT} AS split"), "state", "split").select("o_orderkey", "split")


@query("gov_invalid_moves", f"SELECT o_orderkey FROM (SELECT o_orderkey, {_STATE} AS a, {_NEXT} AS b FROM orders) WHERE a <> b AND a || '>' || b NOT IN ('draft>pending', 'pending>approved', 'pending>rejected', 'rejected>draft')")
def gov_moves(t: Tables) -> DataFrame:
    return corpus.invalid_moves(t.orders.selectExpr("o_orderkey", f"{_STATE} AS a", f"{_NEXT} AS b"), "a", "b").select("o_orderkey")


@query("gov_corpus_report", f"SELECT {_SPLIT} AS split, o_orderpriority AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY {_SPLIT}), 6) AS share FROM orders GROUP BY 1, 2")
def gov_report(t: Tables) -> DataFrame:
    return rounded(corpus.split_counts(t.orders.selectExpr(f"{_SPLIT} AS split", "o_orderpriority"), "split", "o_orderpriority"), 6)
