"""The distance's verdict on small groups and on junk near the cut."""

import random
from itertools import combinations

import numpy as np

from cairn.llm import quality_rules


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def barred(rng, n):
    return " ".join(w + " |" * (i % 2) for i, w in enumerate(prose(rng, n).split()))


def test_small_groups_are_judged_by_wider_ones(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(60, 300)), "en", f"s{i % 3}") for i in range(400)]
    # a language of its own with few rows, one with a single row, and none
    rows += [(1000 + i, prose(rng, 90), "small", "s0") for i in range(8)]
    junk = [(2000, barred(rng, 120), "small", "s0"), (2001, barred(rng, 120), "single", "s9"), (2002, barred(rng, 120), None, None), (2003, barred(rng, 120), "en", "s7")]
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {r[0] for r in junk}


def test_cut_follows_from_the_law():
    # chi-square with 4 dimensions has 1e-6 above 33.38; the 3/4 nearest have 1/1.486 of the covariance
    assert abs(quality_rules.CUT - 33.377) < 0.001 and abs(quality_rules._consistent(0.75) - 1.4864) < 0.0001


def test_concentration_against_every_subset(spark):
    """The determinant that the steps reach is that of the best of all subsets, or close to it (ties within a class of distances join a subset)."""
    rng = np.random.default_rng(4)
    groups, rows = {}, []
    for g in range(6):
        x = rng.normal(0, 0.6, (12, 4)) @ rng.normal(0, 1, (4, 4)) * 0.5
        x[:3] += rng.normal(6, 1, (3, 4)) * rng.choice([-1, 1], 4)
        groups[f"g{g}"] = x
        rows += [(1, f"g{g}", "", *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "level int, of_lang string, of_source string, " + ", ".join(f"{c} double" for c in quality_rules.STATS))
    got = {r.of_lang: r.logdet for r in quality_rules.concentrated(df).collect()}
    for g, x in groups.items():
        least = min(np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) * quality_rules._consistent(0.75) + np.eye(4) * quality_rules.FLOOR**2)[1] for s in combinations(range(12), 9))
        assert least - 1e-6 <= got[g] <= least + 0.7, g


def test_planted_outliers_and_small_groups(spark):
    rng = random.Random(7)
    words = [f"wort{i}" for i in range(400)]
    rows = []
    for i in range(400):
        n = rng.randrange(80, 300)
        text = " ".join(rng.choice(words) for _ in range(n))
        if i % 20 == 7:
            text = " ".join(rng.choice(words) + "#|$" for _ in range(n))
        rows.append((i if i % 9 else None, text, "de" if i % 3 else None, "big" if i % 10 else f"own{i}", "clash"))
    rows += [(None, None, None, None, "x"), (3, "", "de", "big", "x"), (3, "", "de", "big", "x"), (7000, "wort1 " * 60_000, "de", "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, level string")
    got = quality_rules.quality_filter(docs)
    assert got.columns == docs.columns
    kept = [r.text for r in got.collect()]
    assert sum("#|$" in t for t in kept) == 0
    assert len(kept) == 380
    assert quality_rules.judged(docs.limit(0)).collect() == []


def test_base_columns_against_sql(spark, sf):
    import duckdb

    sql = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM read_parquet($1)),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
    k AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM g),
    r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM k) WHERE n > 1),
    c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest(range(8)) AS o) GROUP BY doc_id)
    SELECT w.doc_id, len(w) AS n_words, len(list_aggregate(w, 'string_agg', '')) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed
    FROM w LEFT JOIN c USING (doc_id)"""
    want = {r[0]: tuple(0 if x is None else x for x in r[1:]) for r in duckdb.execute(sql, [f"{sf}/documents.parquet"]).fetchall()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judged(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want
