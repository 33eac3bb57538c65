"""Near duplicates against all pairs."""

import random

from cairn.llm import near_dedup
from cairn.llm.graph import components


def brute(rows, words):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # groups of several blocks
    rng = random.Random(4)
    prose = lambda n: [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randint(0, 40)) for _ in range(n)]
    texts = []
    for size in (60, 12, 5, 2, 1, 1):
        base = prose(rng.randint(60, 200))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 999))
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "", None, "  \n", "one", "One", "one two", "one two three"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, bucket string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs, words=4).collect()}
    assert got == brute(rows, 4)


def test_empty_table(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.component for r in components(edges).collect()} == {0}


def test_repeated_doc_ids_lose_no_link(spark):
    rng = random.Random(11)
    a, b = ([f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, " ".join([*a, "more"])), (6, " ".join([*b, "more"])), (7, "quite another text of a few words"), (None, " ".join(a)), (1, " ".join(a))]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in got) == sorted([(False, 1, 1, True)] * 3 + [(False, 5, 1, False), (False, 6, 1, False), (False, 7, 7, True), (True, 0, None, True)])
