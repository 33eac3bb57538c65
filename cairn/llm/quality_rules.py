"""Quality rules: base rules and robust multivariate outliers per language and source.

DataFrame functions only. Each text gives a handful of counts; ratios of them,
smoothed so that short texts do not scatter, are transformed to logarithms and
held against a minimum-covariance-determinant estimate of their group. From
each of three fixed starts (medians with median deviations, medians with equal
scales, all rows) concentration steps refit mean and covariance on the share H
of the group's rows with the smallest Mahalanobis distance, until no
determinant falls any more; the fit with the smallest determinant is taken,
refined by the usual one-step reweighting, and rows far outside are rejected.

Every group takes part with all its rows in each step. Steps for all groups and
starts run together: rows are counted and summed by group, start and class of
distance (classes of 2 per cent), which combines before the shuffle, so a group with
a third of all rows is no heavier than any other; only those sums meet.
Estimates of small groups are drawn towards their language's, and those
towards that of all rows, by a weight that rises smoothly with their rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import BLANK, ROW, cut, keyed, text_of

#: Words of a repeated window.
WINDOW = 8
#: Share of a group that the concentration steps fit on, and least fall of a determinant's logarithm that counts.
H, FALL = 0.75, 1e-3
#: Share of regular rows that the reweighting leaves out, and that the cut may reject, by the law of the distance.
TRIM, FALSE = 0.025, 1e-6
#: Rows that the wider estimate counts as when a group's own is drawn towards it, and rows of the table at which the doubt about the widest estimate adds one to each variance.
PRIOR, DOUBT = 200, 30
#: Classes of a statistic's values and of distances (by their logarithm to the base 2) in which medians and quantiles are found.
PER_UNIT, PER_DOUBLING = 64, 32
#: Estimates up to which they are sent to every executor (some 0.5 kB each); more are joined by their keys.
SENT = 20_000
#: Standard deviation of each statistic at the least: differences below it are no sign of anything.
FLOOR = 0.25
STATS = ["word_length", "symbols", "dup_lines", "repeats"]


def _beyond(x: float, p: int) -> float:
    """Probability of more than x by the chi-square law of an even number p of dimensions."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def _quantile(beyond: float, p: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(100):
        low, high = (m, high) if _beyond(m := (low + high) / 2, p) > beyond else (low, m)
    return low


def _consistent(share: float) -> float:
    """What makes the covariance of the ``share`` nearest rows of a normal law that of all."""
    return share / (1 - _beyond(_quantile(1 - share, len(STATS)), len(STATS) + 2))


#: Squared distance from which a row is rejected.
CUT = _quantile(FALSE, len(STATS))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, source and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    named = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    t = F.col("_t")
    df = docs.select("doc_id", named["lang"].alias("lang"), named["source"].alias("source"), text_of(text).alias("_t"))
    df = df.select(
        "doc_id", "lang", "source",
        F.filter(F.split(t, BLANK), lambda w: w != "").alias("_w"),
        (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.ltrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "").alias("_l"),
    )
    df = df.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    spots = F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("doc_id", "lang", "source", "n_symbols", "n_words", "word_chars", "n_dup_lines", spots.alias("_g"))
    df = df.withColumn("_u", F.size(F.array_distinct("_g")))
    return df.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("_u") < F.size("_g"), _covered(F.col("_g"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def _covered(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def neighbours(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"]))

    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    add = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"))
    # F.transform over a one-element array binds the sorted array to a name, so that it is sorted once
    return F.element_at(F.transform(F.array(pairs), lambda s: F.aggregate(neighbours(s), start, add, lambda a: a["n"])), 1)


def statistics(counts: DataFrame) -> DataFrame:
    """The counts with base_failed and the transformed statistics."""
    n = F.col("n_words").cast("double")
    rate = lambda x, prior: F.log((F.col(x) + F.lit(prior)) / (n + F.lit(100.0)))
    return counts.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.log((F.col("word_chars") + 500.0) / (n + 100.0)).alias("word_length"),
        rate("n_symbols", 5.0).alias("symbols"),
        F.log((F.col("n_dup_lines") + 2.0) / (F.sqrt(n) + 10.0)).alias("dup_lines"),
        rate("n_repeat_words", 20.0).alias("repeats"),
    )


_PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _factored(fit: DataFrame, tag: str) -> DataFrame:
    """The estimates with the factors L and D of covariance + FLOOR^2 = L D L'."""
    for i, j in _PAIRS:
        less = sum((F.col(f"{tag}l{i}{k}") * F.col(f"{tag}l{j}{k}") * F.col(f"{tag}d{k}") for k in range(j)), F.lit(0.0))
        if i == j:
            fit = fit.withColumn(f"{tag}d{i}", F.greatest(F.col(f"{tag}c{i}{i}") + F.lit(FLOOR**2) - less, F.lit(FLOOR**2)))
        else:
            fit = fit.withColumn(f"{tag}l{i}{j}", (F.col(f"{tag}c{i}{j}") - less) / F.col(f"{tag}d{j}"))
    return fit


def _drawn(fit: DataFrame, tag: str, wider: str) -> DataFrame:
    """The estimates of ``tag`` (null where a group has no sound row) mixed with PRIOR rows of the wider ones."""
    n = F.coalesce(F.col(f"{tag}n"), F.lit(0))
    w = n / (n + F.lit(PRIOR))
    mixed = lambda x: F.coalesce(w * F.col(tag + x) + (1 - w) * F.col(wider + x), F.col(wider + x))
    apart = lambda i: F.coalesce(F.col(f"{tag}m{i}") - F.col(f"{wider}m{i}"), F.lit(0.0))
    new = {f"{tag}m{i}": mixed(f"m{i}") for i in range(len(STATS))}
    new |= {f"{tag}c{i}{j}": mixed(f"c{i}{j}") + w * (1 - w) * apart(i) * apart(j) for i, j in _PAIRS}
    return fit.withColumns(new)


def _distance(tag: str) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i, c in enumerate(STATS):
        y.append(F.col(c) - F.col(f"{tag}m{i}") - sum((F.col(f"{tag}l{i}{k}") * y[k] for k in range(i)), F.lit(0.0)))
    return sum((v * v / F.col(f"{tag}d{i}") for i, v in enumerate(y)), F.lit(0.0))


KEY = ["level", "of_lang", "of_source"]
_ORDER = [f"m{i}" for i in range(len(STATS))] + [f"c{i}{j}" for i, j in _PAIRS]


def _given(fits: DataFrame) -> DataFrame:
    """Estimates have one row a group: sent to the rows, which then need not meet by group, if their number allows it."""
    return F.broadcast(fits) if fits.count() <= SENT else fits


def _diagonal(located: DataFrame, start: int, variance) -> DataFrame:
    c = {f"c{i}{j}": variance(i) if i == j else F.lit(0.0) for i, j in _PAIRS}
    return located.select(*KEY, F.lit(start).alias("start"), *[f"m{i}" for i in range(len(STATS))], *[x.alias(n) for n, x in c.items()])


def _medians(rows: DataFrame) -> DataFrame:
    """KEY and the middle m0, m1, ... of the class that each column's median falls into; only counts by class meet."""
    counts = rows.select(*KEY, F.posexplode(F.array(*STATS)).alias("i", "x")).groupBy(*KEY, "i", F.floor(F.col("x") * PER_UNIT).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*KEY, "i")
    below = counts.withColumn("all", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("b")))
    middles = below.where(2 * F.col("upto") >= F.col("all")).groupBy(*KEY, "i").agg(((F.min("b") + 0.5) / PER_UNIT).alias("m"))
    return middles.groupBy(*KEY).agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m{i}") for i in range(len(STATS))])


def _starts(rows: DataFrame) -> DataFrame:
    middle = cut(_medians(rows))
    away = rows.join(_given(middle), KEY).select(*KEY, *[F.abs(F.col(c) - F.col(f"m{i}")).alias(c) for i, c in enumerate(STATS)])
    scale = _medians(away).select(*KEY, *[F.col(f"m{i}").alias(f"s{i}") for i in range(len(STATS))])
    located = middle.join(scale, KEY)
    every = rows.groupBy(*KEY).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(STATS)], *[F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i, j in _PAIRS])
    some = _diagonal(located, 0, lambda i: F.pow(1.4826 * F.col(f"s{i}"), 2)).unionByName(_diagonal(located, 1, lambda i: F.lit(1.0)))
    return some.unionByName(every.withColumn("start", F.lit(2)))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    products = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}{j}") for i, j in _PAIRS]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(STATS)], *products)


def _estimated(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean and covariance (by ``factor``) from sums over one or more rows of each key, with the factors and the logarithm of the determinant."""
    names = ["n", *[f"s{i}" for i in range(len(STATS))], *[f"p{i}{j}" for i, j in _PAIRS]]
    one = sums.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in names])
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    fit = one.select(*keys, *[mean(i).alias(f"m{i}") for i in range(len(STATS))], *[((F.col(f"p{i}{j}") / F.col("n") - mean(i) * mean(j)) * factor).alias(f"c{i}{j}") for i, j in _PAIRS])
    fit = _factored(fit, "")
    return fit.withColumn("logdet", sum((F.log(f"d{i}") for i in range(len(STATS))), F.lit(0.0)))


def _step(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """The estimates of one concentration step from ``fits`` (KEY, start)."""
    keys = [*KEY, "start"]
    near = F.floor(F.log2(_distance("") + 2.0**-20) * PER_DOUBLING).alias("near")
    classes = _sums(rows.join(_given(fits), KEY).select(*keys, *STATS, near), [*keys, "near"])
    group = Window.partitionBy(*keys)
    ranked = classes.withColumn("all", F.sum("n").over(group)).withColumn("before", F.sum("n").over(group.orderBy("near")) - F.col("n"))
    return _estimated(ranked.where(F.col("before") < H * F.col("all")), keys, _consistent(H))


def concentrated(rows: DataFrame) -> DataFrame | None:
    """Per KEY of ``rows`` (KEY, STATS) the fit with the smallest determinant of all starts and steps; none without rows."""
    keys = [*KEY, "start"]
    live = cut(_factored(_starts(rows), "").withColumn("logdet", F.lit(float("inf"))))
    seen = []
    while not live.isEmpty():
        new = cut(_step(rows, live).join(live.select(*keys, F.col("logdet").alias("was")), keys))
        seen.append(new)
        live = new.where(F.col("logdet") < F.col("was") - FALL).drop("was")
    if not seen:
        return None
    every = reduce(DataFrame.unionByName, seen)
    return cut(every.groupBy(*KEY).agg(F.min_by(F.struct(*[c for c in every.columns if c not in (*KEY, "was")]), F.struct("logdet", "start")).alias("f")).select(*KEY, "f.*"))


def robust_fits(rows: DataFrame) -> DataFrame:
    """Per KEY of ``rows`` (KEY, STATS): n, mean m and covariance c of the reweighted minimum-covariance-determinant estimate."""
    best = concentrated(rows)
    if best is None:
        return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[F.lit(0.0).alias(x) for x in _ORDER])
    scored = rows.join(_given(best), KEY).select(*KEY, *STATS, _distance("").alias("_d"))
    fit = _estimated(_sums(scored.where(F.col("_d") <= _quantile(TRIM, len(STATS))), KEY), KEY, _consistent(1 - TRIM))
    return cut(fit.join(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), KEY).select(*KEY, "n", *_ORDER))


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, distance, kept.

    Null and empty texts have no words and fail the base rules. A null language
    or source counts as the group ''. Repeated rows and ids are judged each by
    itself; columns other than doc_id, text, lang and source are not read. The
    distance is null where no row of the table passes the base rules.
    """
    stats = statistics(text_counts(docs)).withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("source", F.coalesce("source", F.lit("")))
    stats = cut(stats)
    level = lambda n, lang, source: F.struct(F.lit(n).alias("level"), lang.alias("of_lang"), source.alias("of_source"))
    none = F.lit("")
    levels = F.array(level(0, none, none), level(1, F.col("lang"), none), level(2, F.col("lang"), F.col("source")))
    fits = robust_fits(cut(stats.where(~F.col("base_failed")).select(F.explode(levels).alias("k"), *STATS).select("k.*", *STATS)))
    part = lambda n, tag: fits.where(F.col("level") == n).select(F.col("of_lang").alias("lang"), F.col("of_source").alias("source"), *[F.col(x).alias(tag + x) for x in ("n", *_ORDER)])
    whole = part(0, "a").drop("lang", "source").withColumns({f"ac{i}{i}": F.col(f"ac{i}{i}") + F.pow(F.lit(float(DOUBT)) / F.col("an"), 2) for i in range(len(STATS))})
    fit = stats.select("lang", "source").distinct().join(F.broadcast(whole)).join(part(1, "g").drop("source"), "lang", "left").join(part(2, "s"), ["lang", "source"], "left")
    fit = cut(_factored(_drawn(_drawn(fit, "g", "a"), "s", "g"), "s"))
    d = _distance("s")
    return stats.join(_given(fit), ["lang", "source"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", d.alias("distance"),
        (~F.col("base_failed") & ~F.coalesce(d > CUT, F.lit(False))).alias("kept"),
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Every row is judged by itself, whatever its doc_id (null, or repeated)."""
    rows = keyed(docs)
    rejected = judged(rows.withColumn("doc_id", F.col(ROW))).where(~F.col("kept")).select(F.col("doc_id").alias(ROW))
    return rows.join(rejected, ROW, "left_anti").select(*docs.columns)
