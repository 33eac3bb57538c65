"""Bundles of records: canonical JSON lines in one order, cut into shards of bounded bytes that are the same whatever the partitions."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.guards import col
from cairn.sources.sealed import SealError, read_json_file, write_json_file
from cairn.sources.shared import settled

_MANIFEST = "_bundle.json"


def canonical_lines(df: DataFrame) -> DataFrame:
    """line: each row as JSON with its names in order and its nulls named; order columns stay beside it."""
    return df.select("*", F.to_json(F.struct(*[col(c).alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("_line"))


def _placed(batches):
    """Ordered (line, bytes) of one range with its number and the bytes before each line."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        within = before + np.cumsum(sizes) - sizes
        before += int(sizes.sum())
        yield pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(within)], names=["line", "size", "part", "within"])


def sharded(df: DataFrame, order: list[str], max_bytes: int) -> DataFrame:
    """shard, start, line: all lines in the order of the columns (then of the lines), cut where max_bytes are full. A line stays whole, so a shard has at most one line more.

    The place of a line is the number of bytes before it, which neither
    partitions nor repeated runs change.
    """
    lines = canonical_lines(df)
    by = [col(c) for c in order] + [F.sha2("_line", 256)]
    size = (F.octet_length("_line") + 1).cast("long").alias("size")
    ranged = lines.repartitionByRange(*by).sortWithinPartitions(*by, "_line").select(F.col("_line").alias("line"), size)
    rows = settled(ranged.mapInArrow(_placed, "line string, size long, part long, within long"))
    # one row a range
    starts = rows.groupBy("part").agg(F.sum("size").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("begin"))
    start = F.col("begin") + F.col("within")
    return rows.join(F.broadcast(starts), "part").select(F.floor(start / max_bytes).alias("shard"), start.alias("start"), "line")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, n_bytes, sha256 of the shards in a folder, digested by the tasks that read them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "shard=([0-9]+)/", 1).cast("long").alias("shard"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def write_bundle(df: DataFrame, path: str, order: list[str], max_bytes: int = 64 << 20) -> dict:
    """Writes the shards and a manifest with their digests; the manifest. What is in the files is counted again before it is published."""
    if max_bytes < 1:
        raise ValueError("max_bytes is 1 at least")
    spark = df.sparkSession
    rows = settled(sharded(df, order, max_bytes))
    rows.repartition("shard").sortWithinPartitions("shard", "start").select("shard", "line").write.partitionBy("shard").text(path)
    want = {r.shard: (r.records, r.bytes) for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("line") + 1).alias("bytes")).collect()}  # one row a shard
    found = _shards(spark, path).orderBy("shard").collect()
    if {r.shard: r.n_bytes for r in found} != {s: b for s, (_, b) in want.items()} or len(found) != len(want):
        raise SealError(f"{path!r} does not hold the lines that were given")
    manifest = {"records": sum(n for n, _ in want.values()), "max_bytes": max_bytes, "order": order, "columns": sorted(df.columns), "shards": [r.asDict() | {"n_records": want[r.shard][0]} for r in found]}
    write_json_file(spark, f"{path}/{_MANIFEST}", manifest)
    return manifest


def bundle_faults(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(shard, fault) of shards that are missing, added or changed since the manifest was written; an unpublished bundle is an error."""
    manifest = read_json_file(spark, f"{path}/{_MANIFEST}")
    if manifest is None:
        raise SealError(f"{path!r} has no manifest")
    want = {s["shard"]: (s["n_bytes"], s["sha256"]) for s in manifest["shards"]}
    found: dict[int, list] = {}
    for r in _shards(spark, path).collect():  # one row a shard
        found.setdefault(r.shard, []).append((r.n_bytes, r.sha256))
    faults = [(s, "missing" if s not in found else "changed") for s, w in want.items() if found.get(s) != [w]]
    return sorted(faults + [(s, "not in the manifest") for s in found if s not in want])
