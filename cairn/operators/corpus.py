"""Checks of text corpora and of their splits."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.functions.guards import col
from cairn.functions.matching import Asked

# Moves between review states.
STATES = {("draft", "pending"), ("pending", "approved"), ("pending", "rejected"), ("rejected", "draft")}


def content_duplicates(df: DataFrame, key: str, column: str) -> DataFrame:
    """content_sha256, n, first_id of texts that occur more than once."""
    groups = df.groupBy(F.sha2(col(column), 256).alias("content_sha256")).agg(F.count(F.lit(1)).alias("n"), F.min(col(key)).alias("first_id"))
    return groups.where("n > 1")


def group_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one split."""
    return df.groupBy(col(group).alias("group_value")).agg(F.count_distinct(col(split)).alias("n_splits"), F.count(F.lit(1)).alias("n_rows")).where("n_splits > 1")


def split_counts(df: DataFrame, split: str, category: str) -> DataFrame:
    counts = df.groupBy(col(split).alias("split"), col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def approved(df: DataFrame, state: str, split: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Approved rows; a split without any is an error (one small aggregate runs)."""
    rows = df.where(col(state) == "approved")
    empty = set(splits) - {r[0] for r in rows.groupBy(col(split)).count().select(split).limit(1000).collect()}
    if empty:
        raise ValueError(f"no approved rows in {sorted(empty)}")
    return rows


def invalid_moves(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rows whose review state moved in a way that is not allowed."""
    ok = [(col(before) == a) & (col(after) == b) for a, b in sorted(STATES)]
    allowed = ok[0]
    for o in ok[1:]:
        allowed = allowed | o
    return df.where(~(allowed | (col(before) == col(after))))


def personal_data(df: DataFrame, column: str) -> DataFrame:
    """One row: texts with an e-mail address, a card-like or a phone-like number, over all rows."""
    c = col(column)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c.rlike(text.EMAIL)).alias("n_email"), F.count_if(c.rlike(text.CARD)).alias("n_card"), F.count_if(c.rlike(text.PHONE)).alias("n_phone"))


# Patterns of column names that may hold personal data, tried without regard to case.
PERSONAL_NAMES = (
    r"(?:^|[_-])(name|full_name|first_name|last_name)(?:$|[_-])",
    r"(email|e_mail|mail_address)",
    r"(phone|mobile|telephone|contact_number)",
    r"(address|street|postal_code|zip_code)",
    r"(ssn|social_security|national_id|passport|tax_id)",
    r"(account_id|bank_account|credit_card|card_number|patient_id|customer_id)",
)


def privacy_inspection(df: DataFrame) -> DataFrame:
    """One row per column: column_name, by_name (patterns that the name has), n_email, n_phone, n_card over all rows, suspicious."""
    values = {c: col(c).cast("string") for c in df.columns}
    found = {c: F.struct(*[F.count_if(v.rlike(p)).alias(n) for n, p in (("n_email", text.EMAIL), ("n_phone", text.PHONE), ("n_card", text.CARD))]) for c, v in values.items()}
    one = df.agg(*[x.alias(f"c{i}") for i, x in enumerate(found.values())])
    by_name = {c: sum(bool(re.search(p, c, re.I)) for p in PERSONAL_NAMES) for c in df.columns}
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(by_name[c]).cast("long").alias("by_name"), F.col(f"c{i}.n_email").alias("n_email"), F.col(f"c{i}.n_phone").alias("n_phone"), F.col(f"c{i}.n_card").alias("n_card")) for i, c in enumerate(df.columns)]
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("suspicious", (F.col("by_name") > 0) | (F.col("n_email") + F.col("n_phone") + F.col("n_card") > 0))


def duplicate_files(files: DataFrame) -> DataFrame:
    """content_sha256, n, names of files (path, content) with the same content, and of those whose name occurs with other content: kind tells which."""
    named = files.select(F.col("path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))
    same = named.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1").select(F.lit("same_content").alias("kind"), F.col("content_sha256").alias("value"), "n", "first_path")
    apart = named.groupBy("name").agg(F.count_distinct("content_sha256").alias("n"), F.min("path").alias("first_path")).where("n > 1").select(F.lit("same_name").alias("kind"), F.col("name").alias("value"), "n", "first_path")
    return same.unionByName(apart)


def paired(left: DataFrame, left_name: str, right: DataFrame, right_name: str) -> DataFrame:
    """left_name, n_matches, right_name, confidence: high where exactly one name on the right is the same without case and punctuation."""
    normal = lambda c: F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")
    r = right.groupBy(normal(right_name).alias("k")).agg(F.count(F.lit(1)).alias("n_matches"), F.min(col(right_name)).alias("right_name"))
    out = left.select(col(left_name).alias("left_name"), normal(left_name).alias("k")).join(r, "k", "left")
    n = F.coalesce("n_matches", F.lit(0))
    return out.select("left_name", n.alias("n_matches"), F.when(n == 1, F.col("right_name")).alias("right_name"), F.when(n == 1, "high").when(n > 1, "ambiguous").otherwise("none").alias("confidence"))


def overlap(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose normalised text occurs in the other table."""
    left = df.withColumn("_k", text.normal_question(col(column)))
    keys = other.select(text.normal_question(col(other_column)).alias("_k")).where("_k <> ''").distinct()
    return left.join(keys, "_k", "left_semi").drop("_k")


def conversation_faults(df: DataFrame) -> DataFrame:
    """conv_id, n_turns and faults of conversations: turns not numbered on, no user turn, empty turns, the same role twice running.

    A conversation is small; its turns are looked at with a window over conv_id.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = df.select("conv_id", "turn", "role", F.length(F.trim(F.coalesce("text", F.lit("")))).alias("n"), F.lag("turn").over(w).alias("last"), F.lag("role").over(w).alias("last_role"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("last").isNotNull() & (F.col("turn") != F.col("last") + 1)).alias("n_gaps"), F.count_if(F.col("n") == 0).alias("n_empty"), F.count_if(F.col("role") == F.col("last_role")).alias("n_repeated_roles"), (F.count_if(F.col("role") == "user") > 0).alias("has_user"))


def reconcile(df: DataFrame, key: str, registry: DataFrame, registry_key: str) -> DataFrame:
    """One row: keys that repeat, keys that the registry does not know, registry keys that are not used."""
    a = df.groupBy(col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = registry.select(col(registry_key).alias("k")).distinct().withColumn("known", F.lit(1))
    both = a.join(b, "k", "full")
    return both.agg(F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("n").isNotNull() & F.col("known").isNull()).alias("n_unknown"), F.count_if(F.col("n").isNull()).alias("n_unused"))


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows (with repetitions) that only one side has."""
    a = left.exceptAll(right).agg(F.count(F.lit(1)).alias("only_left"))
    b = right.exceptAll(left).agg(F.count(F.lit(1)).alias("only_right"))
    return a.join(F.broadcast(b))  # one row each


#: Texts that others are compared with at most, and their bytes: they go to every executor.
QUERIES, QUERY_BYTES = 20_000, 64 << 20
#: Pairs of a task.
PAIRS = 1_000_000
#: Letters of the texts that are compared with at once.
ASKED = 1 << 20
#: Rows with the same text that one task looks at together, about.
COPIES = 1_000
#: Results that are handed on at once.
FOUND = 100_000


def _asked(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of the texts, in groups of at most ASKED letters or of one text."""
    group, letters = [], 0
    for i, t in enumerate(texts):
        if group and letters + len(t) > ASKED:
            yield group
            group, letters = [], 0
        group.append(i)
        letters += len(t)
    if group:
        yield group


def similar_texts(queries: DataFrame, rows: DataFrame, key: str, column: str, least: float = 0.55) -> DataFrame:
    """query_key, key, similarity of every row whose normalised text has a matching ratio of ``least`` or more with one of the queries.

    A stated set of at most QUERIES texts is held against all rows, which are
    dealt to tasks by the number of pairs. Bounds by letters, by common
    stretches and by what is left to match leave few pairs to align to the end,
    and lose none. A text that occurs more than once is aligned once for about
    COPIES of its rows. A row is not compared with the query of its own key.
    """
    import pyarrow as pa

    clean = lambda df: df.select(col(key).cast("long").alias("k"), F.trim(F.regexp_replace(F.lower(col(column)), r"(?U)\W+", " ")).alias("t")).where("t <> ''")
    size = clean(queries).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
    if size.n > QUERIES or size.bytes > QUERY_BYTES:
        raise ValueError(f"{size.n} queries of {size.bytes} bytes are more than {QUERIES} or than {QUERY_BYTES} bytes")
    asked: dict[str, list[int | None]] = {}
    for r in clean(queries).collect():
        asked.setdefault(r.t, []).append(r.k)
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        texts, keys = list(sent.value), list(sent.value.values())
        groups = list(_asked(texts))
        held = None
        for batch in batches:
            for group in groups:
                if held is None or len(groups) > 1:
                    held = Asked([texts[i] for i in group])
                found, last, near = [], None, []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if t != last:
                        last, near = t, [(keys[group[i]], round(ratio, 3)) for i, ratio in held.ratios(t, least)]
                    found += [(q, k, ratio) for qs, ratio in near for q in qs if q != k]
                    if len(found) >= FOUND:
                        yield _similar(found)
                        found = []
                yield _similar(found)

    def _similar(found):
        columns = zip(*found, strict=True) if found else ((),) * 3
        return pa.record_batch([pa.array(x, y) for x, y in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_key", "key", "similarity"])

    # a text takes as long as it has pairs, so files say nothing about the work of a task
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * size.n // PAIRS))
    texts = clean(rows)
    # at most one text in COPIES rows
    often = texts.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COPIES)
    part = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / COPIES)))
    dealt = texts.join(F.broadcast(often), "t", "left").withColumn("part", part).repartition(tasks, "t", "part").sortWithinPartitions("t")
    return dealt.select("k", "t").mapInArrow(run, "query_key long, key long, similarity double")


# Which chart an objective gets, in the order in which its lines are tried: objective, chart, least series, least and most categories, whether a time is needed.
CHARTS = [
    ("comparison", "grouped_bar", 2, 0, 20, False),
    ("comparison", "ranked_bar", 0, 0, None, False),
    ("composition", "donut_chart", 0, 2, 6, False),
    ("composition", "stacked_bar", 0, 0, None, False),
    ("conversion", "funnel", 0, 0, None, False),
    ("correlation", "scatter_plot", 0, 0, None, False),
    ("cross_tab", "matrix_pivot", 0, 0, None, False),
    ("current_value", "kpi_scorecard", 0, 0, None, False),
    ("detail", "table", 0, 0, None, False),
    ("distribution", "box_plot", 0, 2, None, False),
    ("distribution", "histogram", 0, 0, None, False),
    ("flow", "sankey", 0, 0, None, False),
    ("geography", "map_symbol", 0, 0, None, False),
    ("geospatial", "map_symbol", 0, 0, None, False),
    ("hierarchy", "treemap", 0, 0, None, False),
    ("kpi", "kpi_scorecard", 0, 0, None, False),
    ("process", "funnel", 0, 0, None, False),
    ("ranking", "grouped_bar", 2, 0, 20, False),
    ("ranking", "ranked_bar", 0, 0, None, False),
    ("relationship", "scatter_plot", 0, 0, None, False),
    ("time_series", "line_chart", 0, 0, None, True),
    ("trend", "line_chart", 0, 0, None, True),
    ("two_dimensional_intensity", "heatmap", 0, 0, None, False),
]


def charts_for(profiles: DataFrame, key: str) -> DataFrame:
    """key, chart of each profile (key, objective, n_categories, n_series, has_time, enough): the first line of CHARTS that fits it, a table if none does or data are too few."""
    lines = profiles.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(CHARTS)], "nth int, objective string, chart string, series int, low int, high int, timed boolean")
    p, c = profiles.alias("p"), F.broadcast(lines.alias("c"))  # as many lines as CHARTS has
    within = (F.col("p.n_categories") >= F.col("low")) & (F.col("high").isNull() | (F.col("p.n_categories") <= F.col("high"))) | (F.col("low") == 0) & F.col("high").isNull()
    fits = (F.col("p.objective") == F.col("c.objective")) & F.col("p.enough") & within & ((F.col("series") == 0) | (F.col("p.n_series") >= F.col("series"))) & (F.col("p.has_time") | ~F.col("timed"))
    first = p.join(c, fits, "left").groupBy(F.col(f"p.`{key}`").alias(key)).agg(F.min(F.struct("c.nth", "c.chart")).alias("best"))
    # a struct of nulls is the smallest only where nothing fits
    return first.select(key, F.coalesce("best.chart", F.lit("table")).alias("chart"))


def record_digests(df: DataFrame, key: str) -> DataFrame:
    """key and record_sha256: the digest of each row's canonical JSON (sorted names, values as text)."""
    body = text.canonical_json({c: col(c).cast("string") for c in df.columns})
    return df.select(col(key).alias("key"), F.sha2(body, 256).alias("record_sha256"))


def bundle_faults(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """key and fault (changed, lost or added) of records against a bundle's manifest (key, record_sha256)."""
    both = manifest.withColumnRenamed("record_sha256", "then").join(records.withColumnRenamed("record_sha256", "now"), "key", "full")
    fault = F.when(F.col("now").isNull(), "lost").when(F.col("then").isNull(), "added").when(F.col("now") != F.col("then"), "changed")
    return both.select("key", fault.alias("fault")).where("fault is not null")
