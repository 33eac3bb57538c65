"""Sealed tables: digests, publishing once, and what is refused."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairn.sources import sealed


def table(spark, n=500):
    return spark.range(n).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id"))).alias("text"), F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("id") / 3).alias("x"), F.array("id").alias("a"), F.col("id").cast("string").cast("binary").alias("b"))


def test_content_key(spark):
    df = table(spark)
    assert sealed.content_key(df.repartition(7)) == sealed.content_key(df) == sealed.content_key(df.orderBy(F.desc("id")))
    assert sealed.content_key(df.withColumn("text", F.coalesce("text", F.lit("")))) != sealed.content_key(df)
    assert sealed.content_key(df.limit(499)) != sealed.content_key(df) and sealed.content_key(df.withColumnRenamed("x", "y")) != sealed.content_key(df)
    two = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string")
    assert sealed.content_key(two.limit(1)) != sealed.content_key(two.offset(1))


def test_ordered_digest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sealed, "CHUNK", 16)
    monkeypatch.setattr(sealed, "TOGETHER", 4)
    df = table(spark).coalesce(1)
    paths = [str(tmp_path / n) for n in "abcd"]
    df.sortWithinPartitions("id").write.parquet(paths[0])
    table(spark).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(paths[1])
    df.sortWithinPartitions(F.when(F.col("id") == 20, 21.5).otherwise(F.col("id"))).write.parquet(paths[2])
    df.where("id < 0").write.parquet(paths[3])
    a, b, c, d = (sealed.ordered_digest(spark, p) for p in paths)
    assert a == b != c and len({a, c, d}) == 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert sealed.ordered_digest(spark, paths[0]) == a
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_write_once_and_verify(spark, tmp_path):
    df, root = table(spark).repartition(3), str(tmp_path / "store")
    path, manifest = sealed.write_sealed(df, root)
    assert manifest["rows"] == 500 and len(manifest["files"]) == 3 and path.endswith(manifest["key"])
    before = {p.name: p.stat().st_mtime_ns for p in Path(path).iterdir()}
    assert sealed.write_sealed(df.repartition(5), root) == (path, manifest)
    assert {p.name: p.stat().st_mtime_ns for p in Path(path).iterdir()} == before
    assert not list(Path(root).glob("_staging*"))
    assert sealed.content_key(sealed.read_sealed(spark, path)) == manifest["key"]
    assert sealed.read_sealed(spark, path, ["id"]).columns == ["id"]


@pytest.mark.parametrize(("fault", "says"), [("byte", "changed"), ("cut", "no footer"), ("gone", "missing"), ("more", "not in the manifest"), ("swap", "length|rows|changed"), ("manifest", "no manifest")])
def test_refused(spark, tmp_path, fault, says):
    path, manifest = sealed.write_sealed(table(spark).repartition(2), str(tmp_path / "store"))
    first, second = (Path(path) / f["name"] for f in manifest["files"])
    for crc in Path(path).glob(".*.crc"):
        crc.unlink()
    data = bytearray(first.read_bytes())
    if fault == "byte":
        data[10] ^= 1
        first.write_bytes(data)
    elif fault == "cut":
        first.write_bytes(data[:-20])
    elif fault == "gone":
        first.unlink()
    elif fault == "more":
        shutil.copy(first, first.with_name("part-x.parquet"))
    elif fault == "swap":
        first.write_bytes(second.read_bytes())
        second.write_bytes(data)
    else:
        (Path(path) / "_manifest.json").unlink()
    with pytest.raises(sealed.SealError, match=says):
        sealed.read_sealed(spark, path)


def test_empty_table(spark, tmp_path):
    path, manifest = sealed.write_sealed(table(spark).where("id < 0"), str(tmp_path / "store"))
    assert manifest["rows"] == 0 and sealed.read_sealed(spark, path).count() == 0


def test_rows_are_hashed_once_a_copy(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(sealed, "CHUNK", 16)
    monkeypatch.setattr(sealed, "TOGETHER", 4)
    calls, row_hash = [], sealed.row_hash
    monkeypatch.setattr(sealed, "row_hash", lambda df: calls.append(df) or row_hash(df))
    df = table(spark).coalesce(1).sortWithinPartitions("id")
    path, manifest = sealed.write_sealed(df, str(tmp_path / "store"))
    assert len(calls) == 2  # what is given and what was stored; both digests of the latter come from one pass
    hashes = [r.h for r in df.select(row_hash(df).alias("h")).collect()]
    level, width = [bytes.fromhex(h) for h in hashes], 16
    while len(level) > 1:
        level, width = [hashlib.sha256(b"".join(level[i : i + width])).digest() for i in range(0, len(level), width)], 4
    assert manifest["ordered"] == level[0].hex() == sealed.ordered_digest(spark, path)
    sums = [sum(int(h[i : i + 15], 16) for h in hashes) for i in (0, 15, 30, 45)]
    names = sealed.json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields])
    assert manifest["key"] == hashlib.sha256("\n".join([names, "500", *map(str, sums)]).encode()).hexdigest()


def test_row_hash_is_made_once_a_row(spark):
    plan = sealed._hashed(spark.range(5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sha2(") == 1 and plan.count("cast(id#") == 1


def test_row_hash_of_odd_values(spark):
    import hashlib

    nested = "s struct<a: int, b: string>, l array<int>"
    rows = [(-0.0, "", b"\x00\xff", (1, None), [1, None], "ü€"), (float("nan"), None, None, None, None, None), (None, "n", b"", (None, None), [], "v1:n")]
    df = spark.createDataFrame(rows, f"x double, t string, b binary, {nested}, `_0` string").coalesce(1)
    texts = [["0.0", "", "00FF", '{"v":{"a":1}}', '{"v":[1,null]}', "ü€"], ["NaN", None, None, None, None, None], [None, "n", "", '{"v":{}}', '{"v":[]}', "v1:n"]]
    want = [hashlib.sha256("".join("n" if t is None else f"v{len(t)}:{t}" for t in row).encode()).digest() for row in texts]
    assert [bytes(r.h) for r in sealed._hashed(df).collect()] == want
    sums = [sum(int(h.hex()[i : i + 15], 16) for h in want) for i in (0, 15, 30, 45)]
    names = sealed.json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields])
    assert sealed.content_key(df) == hashlib.sha256("\n".join([names, "3", *map(str, sums)]).encode()).hexdigest()
