"""Repeated phrases against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import repeated_phrases as rp


def each(rows):
    first = {}
    # documents go by doc_id (null ones last), different texts under one doc_id by MD5
    texts = [(d, (d is None, d or 0, hashlib.md5((t or "").encode()).digest()), (t or "").encode().split()) for d, t in rows]
    for _, own, ws in texts:
        for i in range(len(ws) - 19):
            w, at = tuple(ws[i : i + 20]), (*own, i)
            first[w] = min(first.get(w, at), at)
    out = []
    for d, own, ws in texts:
        gone = set()
        for i in range(len(ws) - 19):
            if first[tuple(ws[i : i + 20])] < (*own, i):
                gone.update(range(i, i + 20))
        out.append((d, len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()))
    return out


def brute(rows):
    return sorted(each(rows), key=str)


def some_rows(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["wort", "Wort", "é", "ünd", "of", "the", "a", "İ", "x y", "z ", "q"] + [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([19, 20, 21, 30, 70]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            if rng.random() < 0.4:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                words += p if rng.random() < 0.7 else p[a:]
            else:
                words += [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        rows.append((rng.choice([i, i, i, None, 7]), "".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in words)))
    rows += [(500, "same words here " * 40), (501, "one " * 19), (502, "one " * 20), (503, "one " * 21), (None, None), (504, ""), (2, "  one  " * 30)]
    rows += [rows[3], (900, rows[4][1]), (901, rows[4][1]), (-5, rows[6][1]), (None, rows[8][1])]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string"


def got(df):
    return sorted((tuple(r) for r in rp.phrase_digests(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rows = some_rows(seed)
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 20
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want


def test_small_segments_and_many_shards(spark, monkeypatch):
    for name, n in (("SEGMENT", 3), ("PHRASES", 40), ("TOGETHER", 4), ("ROUTED", 5)):
        monkeypatch.setattr(rp, name, n)
    rows = some_rows(3, 60)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_anchors_in_pieces(monkeypatch):
    h = rp._mixed(np.arange(5000, dtype=np.uint64) % np.uint64(700))
    whole = rp.anchors(h)
    monkeypatch.setattr(rp, "_PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, rp.anchors(h), strict=True))
    assert (whole[1][1:] == whole[2][:-1] + 1).all()
    words = [f"w{i % 97}".encode() for i in range(500)]
    small = rp.word_hashes(words, 1)
    monkeypatch.setattr(rp, "_PIECE", 1 << 16)
    assert (small == rp.word_hashes(words, 1)).all()


def test_texts_without_phrases(spark):
    rows = some_rows(4, 40)
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int")
    df = df.withColumns({c: F.lit("x") for c in ("key", "spans", "doc", "bytes", "own", "later")})
    out = rp.phrase_dedup(df)
    assert out.columns == df.columns
    texts = {r.row: r.text for r in out.collect()}
    for i, (_, _, n, kept) in enumerate(each(rows)):
        assert hashlib.sha256(texts[i].encode()).hexdigest() == kept if n else texts[i] == rows[i][1]
    assert got(df) == brute(rows)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None), (2, "a b")], SCHEMA)) == brute([(1, None), (2, "a b")])
