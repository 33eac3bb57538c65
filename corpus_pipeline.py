"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import ROW, keyed, remove, shared_path, table, written
from cairn.llm.exact_dedup import exact_dedup
from cairn.llm.near_dedup import near_dedup
from cairn.llm.packing import pack
from cairn.llm.quality_rules import quality_filter
from cairn.llm.suffix_dedup import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others have a row number for the next two stages."""
    return quality_filter(keyed(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text without white space one stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return near_dedup(docs).drop(ROW)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur more than once go from the texts; every document stays."""
    return suffix_dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining texts with their places in the sequences."""
    return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("suffix dedup", repeats), ("packing", packing)]
#: Byte-level suffix matching and tokenizer ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What earlier stages wrote for themselves goes as soon as the next table is written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        before = written()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = shared_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            remove(spark, [x for x in written() if x not in before and x != path] + last)
            last = [path]
    return docs
