"""Types of text tables, cells that do not fit, and loose readers."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cairn.functions.text import output_text
from cairn.sources import files, typed


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


CELLS = {
    "whole": ["1", "-20", "", "9" * 18],
    "big": ["1", "9" * 25, "", "0"],
    "huge": ["1", "9" * 39, "", "0"],
    "price": ["1.50", "2", "", "-0.125"],
    "wide": ["0." + "1" * 30, "1234567890", "", "1"],
    "size": ["1e3", "2.5", "7", ""],
    "code": ["007", "8", "", "9"],
    "flag": ["true", "FALSE", "", "True"],
    "day": ["2024-02-29", "2023-01-01", "", "2020-12-31"],
    "no_day": ["2023-02-29", "2023-01-01", "", "2020-12-31"],
    "mixed": ["2024-02-29", "2023-01-01 10:30", "2023-01-01T10:30:01.5", ""],
    "zoned": ["2024-02-29T01:00:00Z", "2024-02-29 01:00+02:00", "", "2024-02-29T01:00:00-05:00"],
    "none": ["", "", "", ""],
    "text": ["a", "1", "", "2024-01-01"],
    "flags": ["true", "1", "", ""],
}
WANT = {"whole": "bigint", "big": "decimal(25,0)", "huge": "string", "price": "decimal(4,3)", "wide": "string", "size": "double", "code": "string", "flag": "boolean", "day": "date", "no_day": "string", "mixed": "timestamp_ntz", "zoned": "timestamp", "none": "string", "text": "string", "flags": "string"}


def test_joined_kinds_and_casts(spark):
    df = spark.createDataFrame(list(zip(*CELLS.values(), strict=True)), ", ".join(f"{c} string" for c in CELLS))
    found = {f.column: f for f in typed.infer(df)}
    assert {c: f.type for c, f in found.items()} == WANT
    assert (found["whole"].n_values, found["none"].kind, found["no_day"].kind) == (3, "missing", "text")
    out = typed.typed(df)
    assert {c: t for c, t in out.dtypes if t == "string"}.keys() == {c for c, t in WANT.items() if t == "string"}
    rows = out.collect()
    assert [r.price for r in rows] == [Decimal("1.5"), Decimal(2), None, Decimal("-0.125")] and [r.flag for r in rows] == [True, False, None, True]
    assert [r.mixed for r in rows] == [dt.datetime(2024, 2, 29), dt.datetime(2023, 1, 1, 10, 30), dt.datetime(2023, 1, 1, 10, 30, 1, 500000), None]
    assert rows[0].code == "007" and rows[2].text == "" and rows[1].big == Decimal("9" * 25)
    assert typed.rejected(df, WANT).isEmpty()
    assert typed.infer(out.select("whole")) == [] and typed.typed(df.limit(0)).count() == 0


def test_rejected_cells(spark):
    df = spark.createDataFrame([(1, "5", "1.25"), (2, "x", "1.2"), (3, "", "1.200"), (4, None, "a")], "id long, n string, d string")
    got = {tuple(r) for r in typed.rejected(df, {"n": "bigint", "d": "decimal(5,1)"}, "id").collect()}
    assert got == {(2, "n", "x", "bigint"), (1, "d", "1.25", "decimal(5,1)"), (4, "d", "a", "decimal(5,1)")}
    assert [tuple(r) for r in typed.cast_table(df, {"n": "bigint", "d": "decimal(5,1)"}).collect()] == [(1, 5, None), (2, None, Decimal("1.2")), (3, None, Decimal("1.2")), (4, None, None)]
    assert typed.rejected(df, {}).isEmpty()


def test_typed_files(spark, tmp_path):
    csv = typed.read_typed(spark, put(tmp_path, "a.csv", "id,at,price\n1,2024-01-01,1.5\n2,2024-01-02 10:00:00,\n"))
    assert csv.dtypes == [("id", "bigint"), ("at", "timestamp_ntz"), ("price", "decimal(2,1)")]
    xml = typed.read_typed(spark, put(tmp_path, "a.xml", "<r><o><id>1</id><d>2024-01-01</d></o><o><id>2</id><d>2024-05-01</d></o></r>"))
    assert dict(xml.dtypes)["id"] == "bigint" and dict(xml.dtypes)["d"] in ("date", "timestamp_ntz")
    with pytest.raises(ValueError, match="other properties"):
        files.read(spark, put(tmp_path, "w.json", '{"rows": [{"a": 1}], "other": 3}'))


def test_loose_reader(spark, tmp_path):
    df = typed.read_loose(spark, put(tmp_path, "a.csv", "a,b,a\n1,2,3\n4,,6\n"))
    assert df.columns == ["a__duplicate_1", "b", "a__duplicate_3"] and [tuple(r) for r in df.collect()] == [("1", "2", "3"), ("4", "", "6")]
    with pytest.raises(ValueError, match="blank column names"):
        typed.read_loose(spark, put(tmp_path, "b.csv", "a,,c\n1,2,3\n"))
    with pytest.raises(Exception):
        typed.read_loose(spark, put(tmp_path, "c.csv", "a,b\n1\n")).collect()
    assert typed.read_loose(spark, put(tmp_path, "a.jsonl", '{"a": 1}\n\n{"a": 2}\n')).count() == 2


def test_output_form(spark):
    row = spark.sql("SELECT 3.0D AS a, 2.5D AS b, 1e300D AS c, cast(5.00 AS decimal(10,2)) AS d, cast(1.250 AS decimal(10,3)) AS e, cast(1200 AS decimal(10,0)) AS f, DATE'2024-01-02' AS g, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS h, X'0AFF' AS i, 7 AS j, double('NaN') AS k")
    got = row.select(*[output_text(f.dataType, F.col(f.name)).alias(f.name) for f in row.schema]).first()
    assert tuple(got) == ("3", "2.5", "1.0E300", "5", "1.25", "1200", "2024-01-02", "2024-01-02T03:04:05", "0aff", "7", "NaN")
