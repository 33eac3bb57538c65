"""Worksheets of .xlsx files, records of XML files whose element is not named, and guards of JSON texts.

Files are read by Spark (binaryFile or whole texts) and opened inside tasks;
only names of sheets and columns, or of the record element, come to the driver.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.files import read_xml

#: Unpacked bytes of a workbook's part at most, how many times its packed ones, and nesting of a JSON text.
PART_BYTES, RATIO, DEPTH = 512 << 20, 200, 64
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Numbers of the format's own date formats, the time-only ones among them left out.
_DATE_FORMATS = frozenset((14, 15, 16, 17, 22))
_CELL = re.compile(r"([A-Z]+)(\d+)")


def _part(book: zipfile.ZipFile, name: str) -> bytes:
    info = book.getinfo(name)
    if info.file_size > PART_BYTES or info.file_size > RATIO * max(info.compress_size, 1) + (1 << 20):
        raise ValueError(f"{name} unpacks to {info.file_size} bytes")
    data = book.read(name)
    if b"<!DOCTYPE" in data[:4096]:
        raise ValueError(f"{name} declares a document type")
    return data


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _dated(book: zipfile.ZipFile) -> list[str]:
    """For each cell style: date, datetime or the empty text."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(_part(book, "xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower() for f in root.iter(f"{_MAIN}numFmt")}
    out = []
    styles = root.find(f"{_MAIN}cellXfs")
    for x in styles if styles is not None else ():
        number = int(x.get("numFmtId", 0))
        code = own.get(number, "")
        days, hours = number in _DATE_FORMATS or bool(re.search("[yd]", code)), number == 22 or "h" in code
        out.append("datetime" if days and hours else "date" if days else "")
    return out


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, cells as text) of a workbook. Formulas stay as =text and are not worked out; dates become ISO texts."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(s) for s in ElementTree.fromstring(_part(book, "xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dated = _dated(book)
        names = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(_part(book, "xl/_rels/workbook.xml.rels"))}
        workbook = ElementTree.fromstring(_part(book, "xl/workbook.xml"))
        props = workbook.find(f"{_MAIN}workbookPr")
        origin = datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        for sheet in workbook.iter(f"{_MAIN}sheet"):
            target = names[sheet.get(_LINK)]
            root = ElementTree.fromstring(_part(book, target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            for nth, row in enumerate(root.iter(f"{_MAIN}row")):
                cells: dict[int, str | None] = {}
                for at, c in enumerate(row.iter(f"{_MAIN}c")):
                    place = _CELL.match(c.get("r", ""))
                    cells[_column(place[1]) if place else at] = _cell(c, shared, dated, origin)
                yield sheet.get("name"), nth, [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def _cell(c, shared: list[str], dated: list[str], origin: datetime) -> str | None:
    formula, value, kind = c.find(f"{_MAIN}f"), c.find(f"{_MAIN}v"), c.get("t", "n")
    if formula is not None:
        return f"={formula.text or ''}"
    if kind == "inlineStr":
        return _text(c)
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    style = int(c.get("s", 0))
    what = dated[style] if kind == "n" and style < len(dated) else ""
    if what:
        at = origin + timedelta(seconds=round(float(value.text) * 86_400))
        return at.date().isoformat() if what == "date" else at.isoformat(sep=" ")
    return value.text


def _sheets(batches):
    schema = pa.schema([("sheet", pa.string()), ("nth", pa.int64()), ("cells", pa.list_(pa.string()))])
    for batch in batches:
        for data in batch.column(0):
            held: list[tuple] = []
            for row in sheet_rows(data.as_py()):
                held.append(row)
                if len(held) == 5000:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                    held = []
            if held:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def read_sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One table of text columns per worksheet, named by its first row; a row with more cells than that is an error when it is read."""
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_sheets, "sheet string, nth long, cells array<string>")
    out = {}
    for head in rows.where("nth = 0").orderBy("sheet").collect():  # one row a sheet
        names = list(head.cells)
        if not names or None in names or len({n.strip().lower() for n in names}) != len(names):
            raise ValueError(f"sheet {head.sheet!r} has empty or repeated column names: {names}")
        wide = F.raise_error(F.lit(f"sheet {head.sheet!r} has a row of more than {len(names)} cells")).cast("string")
        own = rows.where((F.col("sheet") == head.sheet) & (F.col("nth") > 0))
        out[head.sheet] = own.select(*[F.when(F.size("cells") > len(names), wide).otherwise(F.get("cells", F.lit(i))).alias(n.strip()) for i, n in enumerate(names)])
    return out


def xml_records(data: bytes) -> tuple[str, str, dict[str, str]]:
    """(path of the container, record element, attributes of the elements around the records) of an XML text.

    Records are the one group of siblings that repeat, as near to the root as
    any; no such group, or several, is an error, and so is a document type.
    """
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document types and entities are not read")
    plain = lambda tag: tag.rsplit("}", 1)[-1]
    level = [(ElementTree.fromstring(data), "", {})]
    while level:
        found, below = [], []
        for node, path, around in level:
            own = f"{path}/{plain(node.tag)}"
            held = around | {f"@container:[{own}]/@{plain(k)}": v for k, v in node.attrib.items()}
            counts: dict[str, int] = {}
            for k in node:
                counts[plain(k.tag)] = counts.get(plain(k.tag), 0) + 1
            found += [(own, tag, held) for tag, n in counts.items() if n > 1]
            below += [(k, own, held) for k in node]
        if len(found) > 1:
            raise ValueError(f"several groups could be the records: {sorted(f[:2] for f in found)}")
        if found:
            return found[0]
        level = below
    raise ValueError("no element repeats")


def read_xml_found(spark: SparkSession, path: str) -> DataFrame:
    """The records of an XML file, found by their repetition, with the attributes around them as constant columns."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                yield pa.record_batch([pa.array([json.dumps(xml_records(data.as_py()))], pa.string())], names=["found"])

    found = {r.found for r in spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "found string").distinct().limit(2).collect()}
    if len(found) != 1:
        raise ValueError("the files differ in their record element or in the attributes around it")
    _, record, around = json.loads(found.pop())
    return read_xml(spark, path, record).withColumns({k: F.lit(v) for k, v in around.items()})


_JSON_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.S)


def json_fault(text: str | None, depth: int = DEPTH, whole: bool = False) -> str | None:
    """Why a JSON text is not taken: nested too deep (seen before it is decoded), malformed, with a name twice in one object, or (a whole file) records that have other properties beside them."""
    if text is None:
        return None
    at = 0
    for m in _JSON_MARKS.finditer(text):
        mark = m.group()
        at += 1 if mark in "[{" else -1 if mark in "]}" else 0
        if at > depth:
            return "nested too deep"

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise KeyError
        return dict(pairs)

    try:
        found = json.loads(text, object_pairs_hook=once)
        if whole and isinstance(found, dict) and len(found) > 1 and any(isinstance(v, list) and v and all(isinstance(x, dict) for x in v) for v in found.values()):
            return "records with other properties beside them"
    except KeyError:
        return "a name twice in one object"
    except ValueError:
        return "malformed"
    return None


def json_faults(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """fault and n of the JSON texts of a path (whole files, or one a line) that are not to be taken."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([json_fault(t, whole=not lines) for t in batch.column(0).to_pylist()], pa.string())], names=["fault"])

    texts = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    return texts.mapInArrow(run, "fault string").where("fault is not null").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
