"""Tables that are stored under the digest of what they hold, and read only after they have been held against it.

A digest of rows is either free of order (sums of row hashes, for content) or
ordered: rows are numbered through all files, hashed by stretches of CHUNK rows
wherever those lie, and the stretches' digests are hashed in order. A sealed
table is written to a staging folder, read again, and published by a rename
under its content's digest, with a manifest of its files. Files are digested by
the tasks that read them.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.guards import col, is_float
from cairn.sources.shared import settled

#: Rows of a stretch, rows of a file (which bounds its bytes), and files whose digests are put together at once.
CHUNK, ROWS, TOGETHER = 1 << 14, 1 << 20, 1 << 12
_MANIFEST = "_manifest.json"


class SealError(ValueError):
    """What is stored is not what it should be."""


def _texts(df: DataFrame) -> list:
    """Every column as text that tells its value, and -0.0 as 0.0; null stays null."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if is_float(f.dataType):
            c = F.when(F.isnan(c), "NaN").otherwise((c + F.lit(0.0)).cast("string"))
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))
        else:
            c = c.cast("string")
        out.append(c)
    return out


def row_hash(df: DataFrame):
    """SHA-256 (hex) of a row's values and places, which tells null from empty; columns that are texts of values already give the same."""
    texts = [F.coalesce(F.concat(F.lit("v"), F.char_length(c).cast("string"), F.lit(":"), c), F.lit("n")) for c in _texts(df)]
    return F.sha2(F.concat(*texts) if texts else F.lit(""), 256)


def _hashed(df: DataFrame, **others) -> DataFrame:
    """The row hash as bytes h beside others. A value is made text once, though its length stands before it, and nothing is asked of h, as a filter would make it anew."""
    names = [f"_{i}" for i in range(len(df.columns))]
    texts = df.select(*[c.alias(n) for n, c in others.items()], *[c.alias(n) for n, c in zip(names, _texts(df), strict=True)])
    return texts.select(*others, F.unhex(row_hash(texts.select(*names))).alias("h"))


#: Of a row hash 15 hex digits at a time are summed as one number: the first of eight bytes that hold them, and bits of these that follow. Each is summed as two halves, which longs hold for 2^33 rows.
_PARTS, _HALF = ((0, 4), (7, 0), (15, 4), (22, 0)), 30
_SUMS = ["n", *(f"{half}{i}" for i in range(len(_PARTS)) for half in ("high", "low"))]


def _sums(hashes: np.ndarray) -> np.ndarray:
    """The number of hashes (rows of 32 bytes) and the two halves' sums of each part of them."""
    out = [len(hashes)]
    for at, behind in _PARTS:
        part = np.ascontiguousarray(hashes[:, at : at + 8]).view(">u8").ravel().astype(np.uint64) >> np.uint64(behind)
        out += [(part >> np.uint64(_HALF) & np.uint64((1 << _HALF) - 1)).sum(), (part & np.uint64((1 << _HALF) - 1)).sum()]
    return np.array(out, np.int64)


def _bytes_of(column: pa.Array) -> np.ndarray:
    """The hashes of a batch as rows of 32 bytes."""
    fixed = column.cast(pa.binary(32))
    return np.frombuffer(fixed.buffers()[1], np.uint8, 32 * len(fixed), 32 * fixed.offset).reshape(-1, 32) if len(fixed) else np.zeros((0, 32), np.uint8)


def _summed(batches):
    total = np.zeros(len(_SUMS), np.int64)
    for batch in batches:
        total += _sums(_bytes_of(batch.column(0)))
    yield pa.record_batch([pa.array([x]) for x in total], names=_SUMS)


def _digested(chunk: int):
    """at, h and sums of each stretch of rows that come in order, a stretch whole in one task."""

    def run(batches):
        now, digest, total = None, None, None

        def row():
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([digest.hexdigest()]), *(pa.array([x]) for x in total)], names=["at", "h", *_SUMS])

        for batch in batches:
            stretch, hashes = batch.column(0).to_numpy() // chunk, _bytes_of(batch.column(1))
            for some in np.split(np.arange(len(stretch)), np.flatnonzero(np.diff(stretch)) + 1):
                if not len(some):
                    continue
                if stretch[some[0]] != now:
                    if now is not None:
                        yield row()
                    now, digest, total = int(stretch[some[0]]), hashlib.sha256(), np.zeros(len(_SUMS), np.int64)
                digest.update(hashes[some[0] : some[-1] + 1])
                total += _sums(hashes[some[0] : some[-1] + 1])
        if now is not None:
            yield row()

    return run


_SUM_TYPES = ", ".join(f"{n} long" for n in _SUMS)


def _key(df: DataFrame, sums) -> str:
    parts = [str(((sums[f"high{i}"] or 0) << _HALF) + (sums[f"low{i}"] or 0)) for i in range(len(_PARTS))]
    names = json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields])
    return hashlib.sha256("\n".join([names, str(sums["n"] or 0), *parts]).encode()).hexdigest()


def _total(sums: DataFrame):
    return sums.agg(*[F.sum(c).alias(c) for c in _SUMS]).first()


def content_key(df: DataFrame) -> str:
    """SHA-256 of the schema, the number of rows and sums of parts of the row hashes: the same for any order and any files."""
    return _key(df, _total(_hashed(df).mapInArrow(_summed, _SUM_TYPES)))


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    """at, h, and the sums of content_key for every stretch of CHUNK rows of Parquet files, written once."""
    df = spark.read.parquet(path)
    file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    # one row a file
    starts = df.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start"))
    rows = _hashed(df, file=file, at=at).join(F.broadcast(starts), "file").select((F.col("start") + F.col("at")).alias("at"), "h")
    ordered = rows.repartition(F.floor(F.col("at") / CHUNK)).sortWithinPartitions("at")
    return settled(ordered.mapInArrow(_digested(CHUNK), f"at long, h string, {_SUM_TYPES}"))


def _together(h):
    """The digest of the hashes (hex) of a group in their order."""
    inside = F.array_sort(F.collect_list(F.struct(F.col("at"), h.alias("h"))))
    return F.sha2(F.unhex(F.array_join(inside["h"], "")), 256).alias("h")


def _ordered(level: DataFrame) -> str:
    """The digest over the digests of stretches."""
    if level.isEmpty():
        return hashlib.sha256(b"").hexdigest()
    level = level.select("at", "h")
    while True:
        found = level.limit(2).collect()
        if len(found) == 1:
            return found[0].h
        level = level.groupBy(F.floor(F.col("at") / TOGETHER).alias("at")).agg(_together(F.col("h")))


def ordered_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the rows of Parquet files in the order of files and of rows within them.

    It changes when two rows swap, and not with the number of tasks or with
    where one file ends and the next begins.
    """
    return _ordered(_stretches(spark, path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """name, length, sha256, n_rows, n_groups of the Parquet files of a folder, read where tasks run; a file without a footer has null rows."""

    def run(batches):
        import io

        import pyarrow.parquet as pq

        schema = pa.schema([("name", pa.string()), ("length", pa.int64()), ("sha256", pa.string()), ("n_rows", pa.int64()), ("n_groups", pa.int64())])
        for batch in batches:
            out = []
            for name, length, sha, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    footer = pq.read_metadata(io.BytesIO(tail))
                    out.append((name, length, sha, footer.num_rows, footer.num_row_groups))
                except (pa.ArrowInvalid, OSError):
                    out.append((name, length, sha, None, None))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [()] * 5, schema, strict=True)], schema=schema)

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    # of a file only its last bytes go to Python: the footer and its length
    size = F.conv(F.hex(F.reverse(F.substring("content", -8, 4))), 16, 10).cast("long")
    tail = F.substring(F.col("content"), -F.least(F.col("length"), size + 8).cast("int"), F.least(F.col("length"), size + 8).cast("int"))
    sized = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), tail.alias("tail"))
    return sized.mapInArrow(run, "name string, length long, sha256 string, n_rows long, n_groups long")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def read_json_file(spark: SparkSession, path: str) -> dict | None:
    """What a small JSON file holds; None if there is none."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json_file(spark: SparkSession, path: str, value: dict) -> None:
    fs, where = _at(spark, path)
    out = fs.create(where)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()


def verify(spark: SparkSession, path: str) -> dict:
    """The manifest of a sealed table whose files are all there, whole and unchanged; anything else is a SealError."""
    manifest = read_json_file(spark, f"{path}/{_MANIFEST}")
    if manifest is None:
        raise SealError(f"{path!r} has no manifest")
    want = spark.createDataFrame([(f["name"], f["length"], f["sha256"], f["n_rows"], f["n_groups"]) for f in manifest["files"]], "name string, length long, sha256 string, n_rows long, n_groups long")
    got = _files(spark, path)
    both = want.alias("w").join(got.alias("g"), "name", "full")
    fault = F.when(F.col("g.length").isNull(), "missing").when(F.col("w.length").isNull(), "not in the manifest").when(F.col("g.n_rows").isNull(), "no footer").when(F.col("w.length") != F.col("g.length"), "another length")
    fault = fault.when((F.col("w.n_rows") != F.col("g.n_rows")) | (F.col("w.n_groups") != F.col("g.n_groups")), "other rows").when(F.col("w.sha256") != F.col("g.sha256"), "changed")
    faults = both.select("name", fault.alias("fault")).where("fault is not null").orderBy("name").limit(5).collect()
    if faults:
        raise SealError(f"{path!r}: {[tuple(r) for r in faults]}")
    return manifest


def write_sealed(df: DataFrame, root: str) -> tuple[str, dict]:
    """Stores the rows under root by their content; (path, manifest).

    The same rows are not written twice: what is there is verified. What is
    read again from the staging folder must have the same content, otherwise
    the folder is removed and nothing is published.
    """
    spark = df.sparkSession
    key = content_key(df)
    final, staging = f"{root.rstrip('/')}/{key}", f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    fs, to = _at(spark, final)
    if fs.exists(to):
        return final, verify(spark, final)
    _, at = _at(spark, staging)
    try:
        df.write.option("maxRecordsPerFile", ROWS).option("compression", "snappy").parquet(staging)
        back = spark.read.parquet(staging)
        stretches = _stretches(spark, staging)  # read and hashed once for both digests
        if back.dtypes != df.dtypes or _key(back, _total(stretches)) != key:
            raise SealError(f"{staging!r} does not hold the rows that were given")
        found = _files(spark, staging).orderBy("name").collect()  # one row a file
        manifest = {"key": key, "columns": [[f.name, f.dataType.simpleString()] for f in df.schema.fields], "rows": sum(r.n_rows for r in found), "ordered": _ordered(stretches), "files": [r.asDict() for r in found]}
        write_json_file(spark, f"{staging}/{_MANIFEST}", manifest)
        if not fs.rename(at, to):
            if not fs.exists(to):
                raise SealError(f"{final!r} cannot be published")
            verify(spark, final)  # another writer was first
    finally:
        if fs.exists(at):
            fs.delete(at, True)
    return final, manifest


def read_sealed(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of a sealed table, or some of its columns, after all files have been verified."""
    manifest = verify(spark, path)
    df = spark.read.parquet(path)
    if [[f.name, f.dataType.simpleString()] for f in df.schema.fields] != manifest["columns"]:
        raise SealError(f"{path!r} has other columns than its manifest")
    return df.select(*[col(c) for c in columns or df.columns])
