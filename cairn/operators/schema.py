"""Keys, relationships and model shape of a set of tables."""

from __future__ import annotations

from itertools import permutations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.guards import col, finite, is_float, is_numeric, kind_of, same_family
from cairn.functions.text import name_similarity, normal_name
from cairn.operators.analytics import pair_overlaps
from cairn.operators.ranks import distinct_counts


def key_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_rows, n_null, n_distinct, n_duplicates, unique_ratio, candidate_key; exact, values counted by column."""
    columns = columns or df.columns
    valid_rows = df.select(*[finite(df, c).alias(c) for c in columns])
    one = valid_rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(col(c).isNull()).alias(f"n_null:{c}") for c in columns]).join(F.broadcast(distinct_counts(valid_rows, columns)))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), F.col(f"`n_null:{c}`").alias("n_null"), F.col(f"`n_distinct:{c}`").alias("n_distinct")) for c in columns]
    one = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    valid = F.col("n_rows") - F.col("n_null")
    return one.withColumns({"n_duplicates": valid - F.col("n_distinct"), "unique_ratio": F.try_divide(F.col("n_distinct").cast("double"), valid)}).withColumn("candidate_key", (F.col("n_rows") > 0) & (F.col("n_null") == 0) & (F.col("n_duplicates") == 0))


def role(name: str, kind: T.DataType, unique_ratio: float) -> str:
    """identifier, temporal, measure or descriptive."""
    if normal_name(name).endswith(("id", "key", "code")):
        return "identifier"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if is_float(kind) or isinstance(kind, T.DecimalType) or is_numeric(kind) and unique_ratio < 1:
        return "measure"
    return "descriptive"


#: Share of different values from which a column counts as an identifier, and labels up to which it describes.
UNIQUE, LABELS = 0.8, 20


def column_roles(df: DataFrame, referring: set[str] = frozenset()) -> DataFrame:
    """column_name, roles (comma-joined, in this order): identifier, temporal, descriptive, measure, degenerate_dimension.

    A column may have several roles. It is an identifier by its name or by its
    different values; a key by its name that is in no reference (``referring``:
    the columns that are) is a degenerate dimension. One row a column, from
    exact counts over all rows.
    """
    facts = []
    for c in df.columns:
        kind = kind_of(df, c)
        facts.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(normal_name(c).endswith(("id", "key", "code"))).alias("key"), F.lit(isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))).alias("time"),
            F.lit(is_numeric(kind)).alias("number"), F.lit(isinstance(kind, T.StringType)).alias("text"), F.lit(isinstance(kind, T.BooleanType)).alias("flag"), F.lit(c in referring).alias("refers"),
        ))
    stats = key_statistics(df)
    named = stats.join(F.broadcast(df.sparkSession.range(1).select(F.inline(F.array(*facts)))), "column_name")  # one row a column
    identifier = F.col("key") | (F.coalesce("unique_ratio", F.lit(0.0)) >= UNIQUE)
    descriptive = ((F.col("text") | F.col("flag")) & (F.col("n_distinct") <= LABELS)) | (F.col("text") & ~identifier)
    roles = {"identifier": identifier, "temporal": F.col("time"), "descriptive": descriptive, "measure": F.col("number") & ~F.col("key"), "degenerate_dimension": F.col("key") & ~F.col("refers")}
    return named.select("column_name", F.concat_ws(",", *[F.when(on, r) for r, on in roles.items()]).alias("roles"))


# What a reference's score is made of, and the scores from which it counts as high or medium.
WEIGHTS = {"name": 0.3, "type": 0.2, "key": 0.2, "coverage": 0.15, "overlap": 0.05, "not_null": 0.1}
HIGH, MEDIUM, COVERED, SIMILAR = 0.85, 0.65, 0.9, 0.8


def relationships(tables: dict[str, DataFrame]) -> list[dict]:
    """Directed references source.column -> target.column with coverage, cardinality, status and score.

    Pairs are those of like names (without a table's prefix) and types. A
    target is a candidate key; inferred needs nine tenths of the source's keys
    in it. Runs one aggregate a table and one over the values of all.
    """
    stats = {t: {r.column_name: r for r in key_statistics(df).collect()} for t, df in tables.items()}
    common = {(r.left, r.right): r.common for r in pair_overlaps(tables).collect()}  # one row a pair of columns
    out = []
    for (s, a_df), (t, b_df) in permutations(tables.items(), 2):
        for a, b in product(a_df.columns, b_df.columns):
            source, target = stats[s][a], stats[t][b]
            similar = name_similarity(a.split("_", 1)[-1], b.split("_", 1)[-1])
            if similar < SIMILAR or not same_family(a_df.schema[a].dataType, b_df.schema[b].dataType) or not target.candidate_key or (source.candidate_key and s > t):
                continue
            shared = common.get((f"{s}.{a}", f"{t}.{b}"), common.get((f"{t}.{b}", f"{s}.{a}"), 0))
            coverage = shared / source.n_distinct if source.n_distinct else 0.0
            w = WEIGHTS
            score = w["name"] * similar + w["type"] + w["key"] + w["coverage"] * coverage + w["overlap"] * (shared > 0) + w["not_null"] * (1 - source.n_null / max(source.n_rows, 1))
            out.append({
                "source": f"{s}.{a}", "target": f"{t}.{b}", "cardinality": "one_to_one" if source.candidate_key else "many_to_one", "coverage": coverage,
                "status": "inferred" if coverage >= COVERED else "ambiguous" if shared else "rejected", "score": round(score, 4), "confidence": "high" if score >= HIGH else "medium" if score >= MEDIUM else "low",
            })
    return sorted(out, key=lambda r: (r["source"], r["target"]))


def model_advice(tables: dict[str, DataFrame], found: list[dict]) -> str:
    """star: a table with measures refers to two or more others; snowflake: those refer on; hybrid: several such; else normalized."""
    links: dict[str, set[str]] = {}
    for r in found:
        if r["status"] == "inferred":
            links.setdefault(r["source"].split(".")[0], set()).add(r["target"].split(".")[0])
    facts = [t for t, to in links.items() if len(to) >= 2 and any(is_float(f.dataType) or isinstance(f.dataType, T.DecimalType) for f in tables[t].schema)]
    if not facts:
        return "normalized"
    onward = any(links.get(d) for f in facts for d in links[f])
    return "hybrid" if len(facts) > 1 else "snowflake" if onward else "star"


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key is not null and not in the parent."""
    p = parent.select(col(parent_key).alias("_k")).distinct()
    return child.where(col(child_key).isNotNull()).join(p, col(child_key) == p["_k"], "left_anti")
