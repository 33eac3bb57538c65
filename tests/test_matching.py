"""difflib's ratio by bounds and levels against difflib itself, and how its pairs are dealt."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import matching
from cairn.operators import corpus


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinorst" * 4 + "äbcdglmpuyz") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice((1, 5, 20, 36, 37, 50, 70)))) for _ in range(n)]


@pytest.mark.parametrize("few", [0, 8192])
@pytest.mark.parametrize("least", [0.0, 0.1, 0.3, 0.55])
def test_ratios_are_those_of_difflib(monkeypatch, least, few):
    monkeypatch.setattr(matching, "FEW", few)
    asked = [*texts(30, 1), "a", "aaaa", "z" * 230, "ab" * 90]
    held = matching.Asked(asked)
    for text in [*texts(30, 2), asked[3], asked[3][40:] + "q", "a", "ж", "ba" * 99, "z" * 199, "z" * 200, asked[5] + "ж" + asked[4]]:
        want = [(i, r) for i, a in enumerate(asked) if (r := difflib.SequenceMatcher(None, a, text).ratio()) >= least]
        assert held.ratios(text, least) == want, text
    assert matching.Asked([]).ratios("abc", least) == []


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PAIRS", 100)
    df = spark.createDataFrame(list(enumerate(texts(100, 3))), "id long, prompt string").coalesce(1)
    assert corpus.similar_texts(df.where("id < 20"), df, "id", "prompt").rdd.getNumPartitions() == 20


@pytest.mark.parametrize(("name", "value"), [("LISTED", 20), ("HUGE", 60), ("MOST_LETTERS", 3), ("RUN", 4)])
def test_ratios_of_texts_that_repeat_themselves(monkeypatch, name, value):
    monkeypatch.setattr(matching, "FEW", 0)
    monkeypatch.setattr(matching, name, value)
    rng = random.Random(4)
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 199))) for letters in ("ab", "abc", "ab ", "abcdefgh") for _ in range(3)]
    odd += ["a" * 300, "a" * 199, "ab" * 400, "abc" * 60, odd[0] * 3, "xyz" + odd[1], "ж" * 70 + odd[2], "漢字" * 30]
    held = matching.Asked(odd)
    for text in [*(t[:199] for t in odd[::4]), "ba" * 60 + "c" * 20, "字" * 5, "q" * 30, "漢" + odd[3][:50] + "q" + odd[3][:50]]:
        every = [(i, difflib.SequenceMatcher(None, a, text).ratio()) for i, a in enumerate(odd)]
        for least in (0.0, 0.3, 0.8):
            assert held.ratios(text, least) == [(i, r) for i, r in every if r >= least], (text, least)


def test_long_texts_with_some_stretches_in_common_are_not_aligned(monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    # each has one stretch of ten letters in common with the long one, and no more in the same order
    asked = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150)) + long[at : at + 10] for at in range(0, 390, 10)]
    aligned, ratio = [], matching.long_ratio
    monkeypatch.setattr(matching, "long_ratio", lambda a, *rest: aligned.append(a) or ratio(a, *rest))
    assert matching.Asked([*asked, long[:200]]).ratios(long, 0.3) == [(len(asked), difflib.SequenceMatcher(None, long[:200], long).ratio())]
    assert len(aligned) == 1


def test_copies_are_looked_at_together(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PAIRS", 200)
    monkeypatch.setattr(corpus, "COPIES", 30)
    monkeypatch.setattr(corpus, "ASKED", 300)
    monkeypatch.setattr(corpus, "FOUND", 50)
    different = [t.strip() for t in texts(10, 6)]
    df = spark.createDataFrame([(i, different[i % 10] if i % 3 else different[0]) for i in range(150)], "id long, prompt string").repartition(7)
    clean = {r.id: r.prompt for r in df.collect()}
    ratio = {(a, b): round(difflib.SequenceMatcher(None, a, b).ratio(), 3) for a in different for b in different if difflib.SequenceMatcher(None, a, b).ratio() >= 0.3}
    want = sorted((q, k, ratio[clean[q], clean[k]]) for q in range(20) for k in range(150) if q != k and (clean[q], clean[k]) in ratio)
    got = corpus.similar_texts(df.where("id < 20"), df, "id", "prompt", 0.3)
    assert sorted(tuple(r) for r in got.collect()) == want
    # the text that occurs 60 times is in two tasks, each other one in one
    homes = got.select("key", F.spark_partition_id().alias("task")).distinct().collect()
    for t in different:
        mine = {r.task for r in homes if clean[r.key] == t}
        assert len(mine) <= (2 if t == different[0] else 1), t
