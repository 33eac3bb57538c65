"""Empty tables, very long texts, repeated and null ids, and extra columns with clashing names, operator by operator."""

import hashlib

import numpy as np

from cairn.llm import exact_dedup, near_dedup, packing, pieces, quality_rules, toxicity

LONG = "word list of many kinds " * 40_000
ROWS = [(1, LONG), (1, LONG + "."), (None, LONG), (2, None), (2, ""), (2, "two words"), (None, "two  words"), (3, "one"), (3, "one")]
SCHEMA = "doc_id long, text string"


def clashing(spark, *names):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", *[f"doc_id AS `{n}`" for n in names])


def test_exact(spark):
    docs = clashing(spark, "h", "norm", "n", "salt", "best", "group_size")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id is None, r.keep_id or 0, r.group_size) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [(False, 1, False, 1, 1), (False, 1, False, 1, 2), (False, 2, False, 2, 2), (False, 2, False, 2, 2), (False, 2, True, 0, 2), (False, 3, False, 3, 2), (False, 3, False, 3, 2), (True, 0, False, 1, 2), (True, 0, True, 0, 2)]
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == [] and exact_dedup.exact_dedup(docs.limit(0)).collect() == []


def test_near(spark):
    docs = clashing(spark, "digest", "bands", "component", "id")
    kept = near_dedup.near_dedup(docs)
    # the long texts are one group, those of two words one, those of one word one, and rows without words stay
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in kept.collect()) == [(False, 1, False), (False, 2, False), (False, 2, False), (False, 2, True), (False, 3, False)]
    assert near_dedup.near_groups(docs.limit(0)).collect() == []


def test_pieces(spark):
    sp = pieces.codec(pieces.model_file()).library
    want = sorted(hashlib.sha256(np.array(sp.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for _, t in ROWS)
    assert sorted(r.ids_sha256 for r in pieces.piece_digests(clashing(spark, "ids", "n_tokens")).collect()) == want
    assert pieces.piece_digests(spark.createDataFrame([], SCHEMA)).collect() == [] and not any(r.followed_library for r in pieces.piece_digests(clashing(spark, "ids", "n_tokens")).collect())


def test_packing(spark):
    rows = packing.pack(clashing(spark, "class", "slot", "part", "group")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_quality_and_toxicity(spark):
    docs = clashing(spark, "_all", "level", "start", "kept")
    assert quality_rules.judged(docs).count() == len(ROWS)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(ROWS)
