"""Toxicity by cumulative-link ordinal regression over sparse word features.

Features are the words of a text and the beginnings of its words, since
languages inflect: a stem is seen in many words that are rare by themselves.

Labels say toxic or clean; how severe a toxic text is comes from how much of it
is toxic. The labelled sample is cut in two folds, each with a model of its own
(one threshold), and the passages of PASSAGE words of each toxic text are
scored by the model of the fold that it is not in. Grade 0 is a clean text, 1 a
toxic one, 2 a toxic one of which the other fold's model finds at least SEVERE
of the passages toxic. The final model sees words of whole texts only. One
weight per feature is shared across the ordered thresholds:
P(grade > k) = 1 / (1 + exp(threshold_k - weights . features)). The expected
severity is the sum of these over k.

The model is fitted on at most SAMPLE labelled documents, chosen by a hash of
their ids (of several texts with one id the smallest is taken), on at most
FEATURES features; every document is scored over its whole text.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, text_of
from cairn.llm.words import ascii_words

#: Bound on the labelled documents that the model is fitted on.
SAMPLE = 20_000
#: Words kept as features at most, and the standard deviations by which toxic texts must have them more often than all texts.
FEATURES, TELLING = 2048, 4.0
#: Probability of a grade over 0 from which a text counts as toxic.
TOXIC = 0.3
#: Bytes of the beginnings of words that are features, and words and features that a task remembers.
BEGINNINGS, REMEMBERED = range(4, 10), 400_000
GRADES = 2
#: Words of a passage, and how many toxic ones make a text of the second grade.
PASSAGE, SEVERE = 40, 3


def features(word: bytes) -> list[bytes]:
    """The whole word (marked by a space) and its beginnings."""
    return [word + b" ", *(word[:k] for k in BEGINNINGS if k < len(word))]


class _Known(dict):
    """word -> its features that the model knows."""

    def __init__(self, chosen):
        self.chosen = chosen

    def __missing__(self, word: bytes) -> tuple:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = tuple(f for f in features(word) if f in self.chosen)
        return found

    def counts(self, words: list[bytes]) -> Counter:
        return Counter(f for w in words for f in self[w])


class Model:
    """Weights of words and rising thresholds; ``fit`` maximises the penalised likelihood."""

    def __init__(self, words: list[bytes], weights: np.ndarray, thresholds: np.ndarray):
        self.weights = dict(zip(words, weights.tolist(), strict=True))
        self.thresholds = thresholds.tolist()

    @staticmethod
    def fit(rows: list[tuple[dict[bytes, int], int]], words: list[bytes], grades: int = GRADES, penalty: float = 2e-4, steps: int = 400) -> Model:
        number = {w: i for i, w in enumerate(words)}
        at, col, val = [], [], []
        for i, (counts, _) in enumerate(rows):
            for w, n in counts.items():
                at.append(i)
                col.append(number[w])
                val.append(np.log1p(n))
        at, col, val = np.array(at, int), np.array(col, int), np.array(val)
        grade = np.array([g for _, g in rows])
        above = grade[:, None] > np.arange(grades)  # above[i, k]: the grade of i is over k
        beta, first, gaps = np.zeros(len(words)), 2.0, np.zeros(grades - 1)
        m = [np.zeros(len(words)), 0.0, np.zeros(grades - 1)]
        v = [np.zeros(len(words)), 0.0, np.zeros(grades - 1)]
        clip = lambda x: np.clip(x, -30, 30)
        low = np.zeros((len(rows), grades + 2), bool)
        low[np.arange(len(rows)), grade] = True
        for step in range(1, steps + 1):
            cuts = np.concatenate(([first], first + np.cumsum(np.exp(gaps))))
            score = np.bincount(at, beta[col] * val, len(rows))
            over = 1 / (1 + np.exp(clip(cuts[None, :] - score[:, None])))
            p = np.concatenate((np.ones((len(rows), 1)), over, np.zeros((len(rows), 1))), 1)
            mass = np.maximum(p[np.arange(len(rows)), grade] - p[np.arange(len(rows)), grade + 1], 1e-9)
            slope = np.concatenate((np.zeros((len(rows), 1)), over * (1 - over), np.zeros((len(rows), 1))), 1)
            up, down = slope[np.arange(len(rows)), grade], slope[np.arange(len(rows)), grade + 1]
            d_score = (up - down) / mass / len(rows)
            d_cut = np.zeros(grades + 2)
            np.add.at(d_cut, grade, -up / mass / len(rows))
            np.add.at(d_cut, grade + 1, down / mass / len(rows))
            d_cut = d_cut[1:-1]
            tails = np.cumsum(d_cut[::-1])[::-1]
            slopes = [np.bincount(col, d_score[at] * val, len(words)) - penalty * beta, tails[0], tails[1:] * np.exp(gaps)]
            moved = []
            for i, (x, g) in enumerate(zip((beta, first, gaps), slopes, strict=True)):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                moved.append(x + 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9))
            beta, first, gaps = moved
        del above, low
        return Model(words, beta, np.concatenate(([first], first + np.cumsum(np.exp(gaps)))))

    def severity(self, counts: dict[bytes, int]) -> tuple[float, float]:
        """(expected grade, probability of any grade over 0)."""
        score = sum(self.weights[w] * np.log1p(n) for w, n in counts.items())
        over = [1 / (1 + np.exp(min(30.0, max(-30.0, c - score)))) for c in self.thresholds]
        return float(sum(over)), float(over[0])


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE labelled documents: text, toxic, fold."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE rows at most, whatever the input
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return one.select("text", F.col("toxic").cast("long").alias("toxic"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))


def passages(text: str) -> list[list[bytes]]:
    """The words of a text, PASSAGE by PASSAGE; the last passage may be shorter."""
    words = ascii_words(text)
    return [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)]


def graded(sample: DataFrame, folds: dict[int, Model | None]) -> DataFrame:
    """text, toxic, grade of the sample (text, toxic, fold), by the models of the folds that a text is not in."""

    def run(batches):
        known = {k: _Known(m.weights) for k, m in folds.items() if m}
        for batch in batches:
            out = []
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                model, parts = folds.get(1 - fold), passages(text)
                found = sum(model.severity(known[1 - fold].counts(p))[1] >= TOXIC for p in parts) if toxic and model else 0
                out.append(toxic + (toxic and found >= SEVERE))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["text", "toxic", "grade"])

    return sample.select("text", "toxic", "fold").mapInArrow(run, "text string, toxic long, grade long")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled sample, or none if it has no toxic or no clean text."""
    sample = cut(_sample(docs, labels))
    folds = {k: _fitted(sample.where(F.col("fold") == k).select("text", "toxic", F.col("toxic").alias("grade")), 1) for k in (0, 1)}
    return _fitted(cut(graded(sample, folds)), GRADES)


def _fitted(sample: DataFrame, grades: int) -> Model | None:
    """The model of rows text, toxic, grade."""

    def distinct(batches):
        found: dict[bytes, list[int]] = {}

        def rows():
            out = pa.record_batch([pa.array(list(found), pa.binary()), *(pa.array([n[i] for n in found.values()], pa.int64()) for i in (0, 1))], names=["word", "bad", "all"])
            found.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {b"", *(f for w in set(ascii_words(text)) for f in features(w))}:
                    n = found.setdefault(f, [0, 0])
                    n[0] += y
                    n[1] += 1
                if len(found) > REMEMBERED:
                    yield rows()
        if found:
            yield rows()

    seen = sample.select("text", "toxic").mapInArrow(distinct, "word binary, bad long, all long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
    total = seen.where(F.octet_length("word") == 0).first()
    if total is None or not 0 < total["bad"] < total["all"]:
        return None
    bad, clean = total["bad"], total["all"] - total["bad"]
    a, b = F.col("bad") + 0.5, F.col("all") - F.col("bad") + 0.5
    odds = F.log(a / (bad + 1.0 - a)) - F.log(b / (clean + 1.0 - b))
    share = bad / (bad + clean)
    z = (F.col("bad") - share * F.col("all")) / F.sqrt(share * (1 - share) * F.col("all"))
    inside = (F.octet_length("word") > 0) & (F.col("bad") < bad) & (F.col("all") - F.col("bad") < clean)
    telling = seen.where(inside).withColumn("odds", odds).withColumn("z", z).where(F.col("z") > TELLING).orderBy(F.desc("z"), "word").limit(FEATURES)
    words = [bytes(r.word) for r in telling.select("word").collect()]
    if not words:
        return None
    chosen = frozenset(words)

    def counts(batches):
        known = _Known(chosen)
        for batch in batches:
            rows = [known.counts(ascii_words(text)) for text in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([list(r) for r in rows], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int64())), batch.column(1)], names=["words", "counts", "grade"])

    rows = sample.select("text", "grade").mapInArrow(counts, "words array<binary>, counts array<bigint>, grade long").collect()
    rows = [(dict(zip(map(bytes, r.words), r.counts, strict=True)), r.grade) for r in rows]
    return Model.fit(sorted(rows, key=lambda r: (r[1], sorted(r[0].items()))), words, grades)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, severity (expected grade), probability, grade, toxic.

    A null or empty text has no features and the severity of its thresholds
    alone, which rounds to 0. Without toxic and clean labels severity is 0.
    Null labels are left out; a document labelled twice counts as toxic if one
    label says so. Every row is scored by itself,
    whatever its doc_id, over all its text; other columns are not read.
    """
    model = fit(docs, labels)

    def run(batches):
        known = _Known(model.weights if model else {})
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                out.append(model.severity(known.counts(ascii_words(text))) if model else (0.0, 0.0))
            severity, p = zip(*out) if out else ((), ())
            yield pa.record_batch([batch.column(0), pa.array(severity, pa.float64()), pa.array(p, pa.float64())], names=["doc_id", "severity", "probability"])

    scored = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, severity double, probability double")
    return scored.select("doc_id", "severity", "probability", F.round("severity").cast("int").alias("grade"), (F.col("probability") >= TOXIC).alias("toxic"))
