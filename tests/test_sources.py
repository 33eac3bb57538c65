"""Readers on small files with empty cells, quotes, nesting and faults."""

from decimal import Decimal

import pytest

from cairn.sources import files


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_delimited(spark, tmp_path):
    df = files.read(spark, put(tmp_path, "a.csv", 'id,name,note\n1,"a, ""b""",\n2,,"two\nlines"\n'))
    assert [tuple(r) for r in df.collect()] == [("1", 'a, "b"', ""), ("2", "", "two\nlines")]
    tabs = files.read(spark, put(tmp_path, "a.tsv", "x\ty\n1\t2,3\n"))
    assert [tuple(r) for r in tabs.collect()] == [("1", "2,3")]
    with pytest.raises(Exception):
        files.read(spark, put(tmp_path, "ragged.csv", "a,b\n1,2\n3\n")).collect()


def test_json(spark, tmp_path):
    assert [tuple(r) for r in files.read(spark, put(tmp_path, "a.json", '[{"a": 1, "b": "x"}, {"a": 2}]')).orderBy("a").collect()] == [(1, "x"), (2, None)]
    assert [tuple(r) for r in files.read(spark, put(tmp_path, "one.json", '{"a": 1.50, "b": "x"}')).collect()] == [(Decimal("1.50"), "x")]
    assert files.read(spark, put(tmp_path, "wrapped.json", '{"rows": [{"a": 1}, {"a": 2}]}')).count() == 2
    assert files.read(spark, put(tmp_path, "a.jsonl", '{"a": 1}\n\n{"a": 2}\n')).count() == 2
    with pytest.raises(Exception):
        files.read(spark, put(tmp_path, "bad.json", '[{"a": 1}, {"a":')).collect()


def test_xml(spark, tmp_path):
    text = '<list><item id="1"><name lang="en">One</name><size><w>2</w></size></item><item id="2"><name lang="de">Zwei</name></item></list>'
    rows = files.read(spark, put(tmp_path, "a.xml", text), "item").orderBy("@id").collect()
    assert [r.asDict() for r in rows] == [{"@id": 1, "name": "One", "name/@lang": "en", "size/w": 2}, {"@id": 2, "name": "Zwei", "name/@lang": "de", "size/w": None}]
    repeated = "<list><item><t>1</t><t>2</t></item></list>"
    with pytest.raises(ValueError, match="repeats"):
        files.read(spark, put(tmp_path, "b.xml", repeated), "item")
    assert files.read(spark, put(tmp_path, "c.xml", text)).count() == 2


def test_unknown_extension(spark):
    with pytest.raises(ValueError, match="no reader"):
        files.read(spark, "a.xls")


def test_summary_and_writer(spark, tmp_path):
    df = spark.createDataFrame([(1, "", 1.0), (2, None, float("nan")), (2, None, None)], "a long, b string, c double")
    out = files.write_parquet(df, str(tmp_path / "t.parquet"))
    assert (out["rows"], out["b__nulls"], out["b__empties"], out["c__nulls"]) == (3, 2, 1, 2)
    turned = files.content_summary(df.orderBy("a", ascending=False).repartition(3)).first()
    assert turned.digest == out["digest"]
    swapped = spark.createDataFrame([(1, None, 1.0), (2, "", float("nan")), (2, None, None)], df.schema)
    assert files.content_summary(swapped).first().digest != out["digest"]
    assert files.content_summary(df.limit(0)).first().rows == 0


def test_union(spark):
    a, b = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "b int, a int")
    assert [tuple(r) for r in files.union_all([a, b]).orderBy("a").collect()] == [(1, 2), (4, 3)]
    with pytest.raises(ValueError):
        files.union_all([a, b.drop("a")])
