"""Suffix sorting and removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from cairn.llm import suffix_dedup
from cairn.llm.suffix_merge import common_prefix, decoded, front_coded, merged


def brute(texts):
    """(n_bytes, n_removed, n_spans, sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(rng.randint(20, 120)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            i = rng.randint(0, len(p) // 2)
            parts += [p[i : i + rng.randint(150, 500)], prose(rng.randint(0, 30))]
        out.append(rng.choice(["", " "]).join(parts))
    out += [out[0], out[0], out[1] + "!", "x" * 1000, "ab" * 150, "", None, "x" * 199, "x" * 200, passages[0] * 3, "y" * 199]
    return out


def result(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, key string")
    return [tuple(r)[1:] for r in suffix_dedup.suffix_spans(docs).orderBy("doc_id").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = texts(seed)
    assert result(spark, rows) == brute(rows)


def test_heavy_grams_are_counted(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    rows = texts(3)
    assert result(spark, rows) == brute(rows)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 25)
    rows = texts(4)
    assert result(spark, rows) == brute(rows)


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(6)
    data = bytes(rng.choice(b"abcd") for _ in range(3000)) + b"x" * 700 + bytes(rng.choice(b"abcd") for _ in range(500))
    whole = suffix_dedup.Anchors(data)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 137)
    parts = suffix_dedup.Anchors(data)
    for name in ("at", "first", "last", "left", "right", "gram", "around"):
        assert (getattr(whole, name) == getattr(parts, name)).all(), name


def test_long_text_repeated_and_null_ids_and_clashing_columns(spark):
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60_000))
    rows = [(1, long + "one", 1), (1, "head " + long[5000:9000], 2), (None, "short", 3), (None, "short", 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes int").selectExpr("*", "bytes AS key", "bytes AS copied", "bytes AS spans", "bytes AS `a.b`")
    got = suffix_dedup.suffix_dedup(docs)
    assert got.columns == docs.columns
    by = {r.bytes: r.text for r in got.collect()}
    assert by == {1: long[:5000] + long[9000:] + "one", 2: "head ", 3: "short", 4: None} and got.count() == 5


def test_empty_table_and_text_of_stage(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert suffix_dedup.suffix_spans(docs).collect() == []
    assert suffix_dedup.suffix_dedup(docs).collect() == []
    rng = random.Random(5)
    one, two, both = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (90, 80, 400))
    docs = spark.createDataFrame([(1, one + both, 490), (2, both + two, 480), (3, None, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == {1: (one, 90), 2: (two, 80), 3: (None, None)}


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(9)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 40))) for _ in range(7)]
    coded = [front_coded(r) for r in runs]
    assert [[s for _, s in decoded(*c)] for c in coded] == runs
    got = list(merged([decoded(*c) for c in coded]))
    strings = [s for _, _, s in got]
    assert strings == sorted(s for r in runs for s in r)
    assert [n for _, n, _ in got] == [common_prefix(a, b) for a, b in zip([b"", *strings], strings)]
