"""Licence labels of joined notices and whole texts against a scan of every place; base columns against SQL."""

import random
from itertools import permutations

from cairn.llm import licenses
from cairn.llm.words import ascii_words


def full_scan(index, words):
    """Every clause at every place of the text, without postings."""
    found = {}
    for n, clause in enumerate(index.clauses):
        for begin in range(1 - len(clause), len(words)):
            share = sum(index.weights[n][i] for i, w in enumerate(clause) if 0 <= begin + i < len(words) and words[begin + i] == w) / index.weight[n]
            if share >= licenses.SHARE:
                found.setdefault(n, []).append((begin, share))
    labels, best = set(), 0.0
    line = b" " + b" ".join(words) + b" "
    for label, own, phrases, near in index.templates:
        if near:
            for begin, share in found.get(own[0], []):
                around = b" " + b" ".join(words[max(0, begin - licenses.DRIFT) : begin + len(index.clauses[own[0]]) + licenses.DRIFT]) + b" "
                if all(p in around for p in phrases):
                    labels.add(label)
                    best = max(best, share)
        else:
            share = sum(index.weight[n] * max((s for _, s in found.get(n, [])), default=0) for n in own) / sum(index.weight[n] for n in own)
            if share >= licenses.SHARE and all(p in line for p in phrases):
                labels.add(label)
                best = max(best, share)
    return labels, best


def test_joined_templates_against_the_full_scan(spark, sf):
    idf = licenses.word_counts(spark.read.parquet(f"{sf}/documents.parquet"))
    rng = random.Random(2)
    pairs = list(permutations([(x[0], x[1]) for x in [*licenses.NOTICES, *licenses.TEXTS]], 2))
    for index in (licenses.Index(idf), licenses.Index()):
        for (a, x), (b, y) in rng.sample(pairs, 60):
            words = ascii_words(f"{x}. Some words between. {y}")
            labels, best = index.scan(words)
            found, most = full_scan(index, words)
            assert {a, b} <= labels == found and abs(best - most) < 1e-9


def test_worn_texts_against_the_full_scan(spark, sf):
    """Words lost, put in or changed: the postings lose no place that the full scan finds."""
    index = licenses.Index(licenses.word_counts(spark.read.parquet(f"{sf}/documents.parquet")))
    rng, light = random.Random(5), 0
    for label, text, _ in licenses.TEXTS:
        for rate in (0.02, 0.15, 0.3):
            words = [w for w in ascii_words(text) if rng.random() > rate / 3]
            words = [x for w in words for x in ((b"other",) if rng.random() < rate / 3 else (w, b"more") if rng.random() < rate / 3 else (w,))]
            got, want = index.scan(words), full_scan(index, words)
            assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9
            light += rate == 0.02 and label in got[0]
    # a worn word may be one of a mandatory phrase
    assert light >= len(licenses.TEXTS) - 2


def test_base_columns_against_sql(spark, sf):
    import duckdb

    sql = r"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM read_parquet($1)),
    w AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
    p AS (SELECT unnest([['cc', 'by'], ['general', 'public', 'license'], ['all', 'rights', 'reserved']]) AS p, unnest(['cc-by', 'gpl', 'reserved']) AS label),
    h AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w), p WHERE list_slice(w, i + 1, i + len(p)) = p)
    SELECT w.doc_id, len(w), count(i), min(i), max(i), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM w LEFT JOIN h USING (doc_id) GROUP BY ALL"""
    want = {r[0]: r[1:] for r in duckdb.execute(sql, [f"{sf}/documents.parquet"]).fetchall()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == want
