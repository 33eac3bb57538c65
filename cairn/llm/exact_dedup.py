"""Exact deduplication by a 128-bit content hash, with a byte comparison inside groups.

DataFrame functions only. The first pass keeps 80 bytes a row (id, length,
hash, digest). The second sends each text of a group of two or more to a
salted key, where only its smallest and largest byte string are kept: they are
the same exactly if no two different texts share a hash. Only groups that fail
that test, if there ever are any, are grouped again by their full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BLANK, ROW, cut, keyed, text_of

#: Parts of a group that compare their bytes apart from each other.
SALTS = 16


def normalised(text: str = "text") -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(text_of(text), BLANK, "")


def _hash128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def collided(docs: DataFrame, repeated: DataFrame, text: str = "text", hash128=_hash128) -> DataFrame:
    """The hashes (column h) of ``repeated`` that stand for two or more different texts."""
    salted = repeated.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = docs.select(normalised(text).alias("norm"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = rows.withColumn("h", hash128(F.col("norm")))
    inside = rows.join(salted.hint("shuffle_hash"), ["h", "salt"], "left_semi")
    ends = inside.groupBy("h", "salt").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    return ends.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h")


def _grouped(docs: DataFrame, text: str, hash128, ties: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Rows, their groups with the row that stays (best), those of two or more, and the columns that tell groups apart. ties: of rows with equal lengths and ids the smallest stays."""
    tie = [c.alias(name) for name, c in ties.items()]
    norm = docs.select("doc_id", *tie, text_of(text).alias("t"), normalised(text).alias("norm"))
    rows = cut(norm.select("doc_id", *ties, F.char_length("t").cast("long").alias("n"), hash128(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *ties)).alias("best")
    groups = rows.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), best)
    repeated = cut(groups.where("group_size > 1"))
    bad = cut(collided(docs, repeated, text, hash128))
    if bad.isEmpty():
        return rows, groups, repeated, ["h"]
    # different texts with one hash: these are told apart by their sha256 and bytes
    whole = docs.select("doc_id", *tie, text_of(text).alias("t"), normalised(text).alias("norm")).withColumn("h", hash128(F.col("norm")))
    odd = whole.join(bad, "h", "left_semi").select("doc_id", *ties, F.char_length("t").cast("long").alias("n"), "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("norm").alias("bytes"))
    rows = rows.join(bad, "h", "left_anti").withColumn("bytes", F.lit("")).unionByName(odd)
    groups = rows.groupBy("h", "bytes").agg(F.count(F.lit(1)).alias("group_size"), best)
    return rows, groups, groups.where("group_size > 1"), ["h", "bytes"]


def exact_groups(docs: DataFrame, text: str = "text", hash128=_hash128) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows whose texts are the same without white space, the one with the most
    code points stays, then the smallest doc_id. Null texts count as empty and
    are one group with empty ones. Rows with the same doc_id and text share a
    verdict; a null doc_id comes last. Other columns of ``docs`` are not read.
    """
    rows, _, repeated, keys = _grouped(docs, text, hash128, {})
    joined = rows.join(repeated.select(*keys, "group_size", F.col("best.id").alias("keep_id")), keys, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, hash128=_hash128) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: exactly one of each group.

    The choice is that of ``exact_groups``; of rows that share the doc_id, too,
    the one with the smallest MD5 of its text stays.
    """
    rows = keyed(docs)
    _, groups, _, _ = _grouped(rows, "text", hash128, {"tie": F.unhex(F.md5(text_of("text"))), "own": F.col(ROW)})
    return rows.join(groups.select(F.col("best.own").alias(ROW)), ROW, "left_semi").select(*docs.columns)


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
