"""Worksheets, records found in XML, JSON guards, a stream with late rows, and helpers without a query."""

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import corpus, prep, reports, rules, schema
from cairn.sources import files, sheets
from cairn.streaming import events

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, tables, shared=("name", "shared text")):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(tables)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(tables))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for i, body in enumerate(tables.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


HEAD = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>day</t></is></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row>'


def test_worksheets(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    body = HEAD + '<row><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45292</v></c><c r="C2"><f>1+1</f><v>2</v></c></row><row><c r="B3" s="2"><v>45292.5</v></c><c r="C3" t="b"><v>1</v></c></row>'
    workbook(path, {"one": body, "two": '<row><c t="inlineStr"><is><t>a</t></is></c></row><row><c><v>1.5</v></c></row>'})
    got = sheets.read_sheets(spark, str(path))
    assert [tuple(r) for r in got["one"].collect()] == [("shared text", "2024-01-01", "=1+1"), (None, "2024-01-01 12:00:00", "true")]
    assert [tuple(r) for r in got["two"].collect()] == [("1.5",)]
    with pytest.raises(ValueError, match="read_sheets"):
        files.read(spark, str(path))
    wide = tmp_path / "wide.xlsx"
    workbook(wide, {"one": '<row><c t="inlineStr"><is><t>a</t></is></c></row><row><c r="A2"><v>1</v></c><c r="B2"><v>2</v></c></row>'})
    with pytest.raises(Exception, match="more than 1"):
        files.read(spark, str(wide)).collect()


def test_records_found_in_xml(spark, tmp_path):
    path = tmp_path / "a.xml"
    path.write_text('<list made="2024" xmlns="urn:x"><head><t>x</t></head><items kind="k"><item id="1"><n>One</n></item><item id="2"><n>Two</n></item></items></list>')
    row = files.read(spark, str(path)).orderBy("@id").first().asDict()
    assert row == {"@id": 1, "n": "One", "@container:[/list]/@made": "2024", "@container:[/list/items]/@kind": "k"}
    for bad, why in (("<a><b/><b/><c/><c/></a>", "several"), ("<a><b/></a>", "no element"), ("<!DOCTYPE a><a><b/><b/></a>", "not read")):
        with pytest.raises(ValueError, match=why):
            sheets.xml_records(bad.encode())


def test_json_guards(spark, tmp_path):
    assert sheets.json_fault("[" * 65 + "]" * 65) == "nested too deep" and sheets.json_fault("[" * 64 + "]" * 64) is None
    assert sheets.json_fault('{"a": 1, "a": 2}') == "a name twice in one object" and sheets.json_fault('{"a": "[[[[{{{\\""}') is None and sheets.json_fault("{") == "malformed"
    path = tmp_path / "twice.jsonl"
    path.write_text('{"a": 1}\n{"a": 1, "a": 2}\n')
    with pytest.raises(ValueError, match="name twice"):
        files.read(spark, str(path))


def test_stream_drops_late_rows(spark, tmp_path):
    folder, at = tmp_path / "in", lambda h, m=0: datetime(2024, 1, 1, h, m)
    schema_ = "ts timestamp, event_type string, value double"
    for i, rows in enumerate([[(at(1), "a", 1.0), (at(1, 30), "a", 2.0)], [(at(6), "a", 4.0)], [(at(6, 1), "a", 0.5)], [(at(1, 10), "a", 8.0), (at(6, 5), "b", 16.0)], [(at(12), "a", 0.0)]]):
        spark.createDataFrame(rows, schema_).coalesce(1).write.mode("append").parquet(str(folder / f"p{i}"))
    stream = spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    # Spark holds late rows against the watermark of the batch before the last one
    query = events.windowed_counts(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r.window_start, r.event_type): (r.n, r.total) for r in spark.table("late").collect()}
    assert got == {(at(1), "a"): (2, 3.0), (at(6), "a"): (2, 4.5), (at(6), "b"): (1, 16.0)}
    assert events.read_events(spark, str(folder / "p0"), schema_).isStreaming


def test_masks_and_names():
    assert text.name_similarity("Customer ID", "customer_id") == 1 and text.name_similarity("customer", "customer_key") == 0.85
    assert text.name_similarity("order_id", "orderCode") == 0.85 and text.name_similarity("", "id") == 0 and text.name_similarity("id", "key") < 0.85


def test_plans_and_states(spark):
    rows = spark.createDataFrame([(1, " A ", None), (2, "b", 4.0), (3, None, 6.0)], "id long, name string, v double")
    done = prep.run_plan(rows, [{"operator": "string_normalization", "columns": ["name"], "case": "lower"}, {"operator": "missing_values", "columns": ["v"], "strategy": "median"}], rows)
    assert [e["status"] for e in done.lineage] == ["done", "done"]
    assert [tuple(r) for r in done.frames["evaluation"].orderBy("id").collect()] == [(1, "a", 5.0), (2, "b", 4.0), (3, None, 6.0)]
    failed = prep.run_plan(rows, [{"operator": "scaling", "columns": ["name"], "strategy": "standard"}, {"operator": "missing_values", "columns": ["v"], "strategy": "mean"}])
    assert [e["status"] for e in failed.lineage] == ["failed", "not_executed"]
    states = spark.createDataFrame([("draft", "pending"), ("draft", "approved"), ("approved", "approved")], "a string, b string")
    assert [tuple(r) for r in corpus.invalid_moves(states, "a", "b").collect()] == [("draft", "approved")]
    split = spark.createDataFrame([("approved", "train"), ("pending", "test")], "state string, split string")
    assert corpus.approved(split, "state", "split", ("train",)).count() == 1
    with pytest.raises(ValueError, match="test"):
        corpus.approved(split, "state", "split", ("train", "test"))
    fact = spark.createDataFrame([], "a_id long, b_id long, amount double")
    links = [{"source": f"f.{c}", "target": f"{c[0]}.id", "status": "inferred"} for c in ("a_id", "b_id")]
    assert schema.model_advice({"f": fact, "a": fact, "b": fact}, links) == "star" and schema.model_advice({"f": fact}, []) == "normalized"
    assert schema.role("customer_id", fact.schema["a_id"].dataType, 0.5) == "identifier" and schema.role("amount", fact.schema["amount"].dataType, 0.5) == "measure"


def test_lineage_and_plan_order():
    a = reports.lineage("read", [], {"path": "x"})
    b = reports.lineage("group", [a], {"by": "y"})
    assert reports.lineage_faults([a, b]) == [] and reports.lineage_faults([b]) == [b["operation_id"]]
    assert reports.lineage_faults([a | {"details": {"path": "z"}}, b]) == [a["operation_id"]]
    assert reports.plan_order({"c": ["a", "b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    for wrong in ({"a": ["b"], "b": ["a"]}, {"a": ["x"]}, {str(i): [] for i in range(6)}):
        with pytest.raises(ValueError):
            reports.plan_order(wrong)
    assert reports.promotion(1.0, 2.0, "minimize", 50, 30) == "eligible_for_human_review"
    assert {reports.promotion(*x) for x in ((1.0, 2.0, "maximize", 50, 30), (1.0, 2.0, "minimize", 5, 30), (None, 2.0, "minimize", 50, 30))} == {"not_recommended"}
    assert rules.config_faults(rules.REGISTRY["outliers"].schema, {"threshold": 99.0, "method": 1, "x": 2}) == ["x: unknown", "method: wrong type", "threshold: not within 0.1 and 10.0"]


def test_charts_refuse(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", -2.0)], "x string, y double")
    for kind, frame in (("pie", rows), ("line", rows), ("radar", rows), ("bar", rows.withColumn("y", F.lit(None).cast("double")))):
        with pytest.raises(ValueError):
            reports.chart(frame, kind, "x", "y")
    assert json.loads(reports.chart(rows, "bar", "x", "y").toJSON().first()) == {"x": "a", "y": 1.0}
