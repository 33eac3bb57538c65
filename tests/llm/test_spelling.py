"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairn.llm import spelling


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, out = {}, set()
    for w, n in words.items():
        some = [x for x in words if near(w, x)]
        best = min(some, key=lambda x: (-words[x], x), default=None)
        forms[w] = (len(some), best if best and words[best] >= 2 * n else None)
    for w, n in words.items():
        root = w
        while forms[root][1]:
            root = forms[root][1]
        form = forms[w][1]
        out.add((w, form, root, n, forms[w][0], words[form] if form else None))
    return out


def some_texts(seed, alphabet, n, words):
    rng = random.Random(seed)
    known = ["".join(rng.choice(alphabet) for _ in range(rng.choice([4, 5, 5, 6, 7, 9]))) for _ in range(words)]
    rows = [(i, " ".join(rng.choices(known, [1 / (k + 1) for k in range(words)], k=rng.choice([0, 3, 40])))) for i in range(n)]
    return rows + [(None, known[0] + "," + known[1]), (3, None), (3, rows[5][1]), (4, "")]


SCHEMA = "doc_id long, text string"


def got(spark, rows):
    return {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, SCHEMA)).select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "ab"), (2, "abcÉéÀ×"), (3, "aeiouBCD")])
def test_against_all_pairs(spark, seed, alphabet):
    rows = some_texts(seed, alphabet, 150, 220)
    want = brute(rows)
    assert len(want) > 50
    assert got(spark, rows) == want


def test_long_words_and_small_batches_of_depths(spark, monkeypatch):
    monkeypatch.setattr(spelling, "DEPTHS", 3)
    monkeypatch.setattr(spelling, "SLICE", 16)
    monkeypatch.setattr(spelling, "HELD", 10)
    base = "abcdefghijklmnopq"
    words = [base, base + "r", base[:9] + base[10:], base[:-1] + "z", base[:5], base[:6], "x" + base, "b" + base[1:]]
    rows = [(i, " ".join(w for k, w in enumerate(words) for _ in range(3 + 4 * k))) for i in range(2)]
    rows += some_texts(4, "ab", 60, 90)
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == set()
    assert got(spark, [(1, None), (2, "a b c")]) == set()
    rows = some_texts(5, "abc", 60, 90)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("word", "n", "node", "char", "near", "depth", "form")})
    assert {tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute(rows)
