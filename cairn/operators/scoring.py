"""Scores of predictions, leakage checks and splits for supervised evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.guards import col, is_numeric, kind_of, ratio, safe_corr
from cairn.operators.ranks import counted_up, distinct_counts


def regression_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n, mae, rmse, mape (over targets that are not 0), r2."""
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    e = y - p
    one = df.where(y.isNotNull() & p.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.try_divide(F.abs(e), F.abs(y)))).alias("mape"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst"))
    return one.select("n", "mae", "rmse", "mape", (1 - F.try_divide("sse", "sst")).alias("r2"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(col(label).alias("label"), col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 per label, from the confusion counts."""
    c = confusion(df, label, predicted)
    hit = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    by_label = c.groupBy("label").agg(F.sum("n").alias("support"), hit.alias("hit"))
    by_guess = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    precision, recall = F.coalesce(ratio(F.col("hit"), F.col("guessed")), F.lit(0.0)), ratio(F.col("hit"), F.col("support"))
    return by_label.join(by_guess, "label", "left").select("label", "support", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def classification_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """n, accuracy, balanced_accuracy, macro_f1, weighted_f1."""
    s, n = class_scores(df, label, predicted), F.col("support").cast("double")
    total = F.sum(n)
    return s.agg(F.sum("support").alias("n"), F.try_divide(F.sum(n * F.col("recall")), total).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(n * F.col("f1")), total).alias("weighted_f1"))


def ranking_scores(df: DataFrame, label: str, probability: str) -> DataFrame:
    """n, n_positive, roc_auc, average_precision, brier of a binary label (1 is positive) and a probability.

    From counts per different probability, counted up in ranges: no task sees
    all of them. Tied probabilities count half for the area, and as one step of
    the precision-recall curve. Areas are null unless both labels occur.
    """
    rows = df.where(col(label).isNotNull() & col(probability).isNotNull()).select(col(label).cast("int").alias("y"), col(probability).cast("double").alias("p"))
    brier = rows.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    counts = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    up = counted_up(counts.withColumn("_one", F.lit(0)), ["_one"], "p")
    hits_up = counted_up(counts.select("p", F.col("hits").alias("n")).withColumn("_one", F.lit(0)), ["_one"], "p").select("p", F.col("before").alias("hits_before"))
    steps = up.join(hits_up, "p")
    totals = counts.agg(F.sum("n").alias("all"), F.sum("hits").alias("pos"))
    both = steps.join(F.broadcast(totals))
    neg = F.col("all") - F.col("pos")
    # of each step: negatives below it and half of those in it, and precision from it upwards
    below = (F.col("before") - F.col("hits_before")) + (F.col("n") - F.col("hits")) / 2
    precision = F.try_divide((F.col("pos") - F.col("hits_before")).cast("double"), (F.col("all") - F.col("before")).cast("double"))
    one = both.agg(F.max("all").alias("n"), F.max("pos").alias("n_positive"), F.sum(F.col("hits") * below).alias("pairs"), F.max(F.col("pos") * neg).alias("most"), F.sum(precision * F.col("hits")).alias("area"))
    usable = F.col("most") > 0
    out = one.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_positive", F.lit(0)).alias("n_positive"), F.when(usable, F.try_divide("pairs", "most")).alias("roc_auc"), F.when(usable, F.try_divide("area", F.col("n_positive").cast("double"))).alias("average_precision"))
    return out.join(F.broadcast(brier))


def leakage(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """feature, equal_share, correlation (numbers), distinct_share, verdict (copy, suspicious, identifier or fine)."""
    y, out = col(target), []
    for f in features:
        x = col(f)
        same = F.avg(F.when(x.isNotNull() & y.isNotNull(), (x.cast("string") == y.cast("string")).cast("int")))
        both = is_numeric(kind_of(df, f)) and is_numeric(kind_of(df, target))
        out.append(F.struct(F.lit(f).alias("feature"), same.alias("equal_share"), (safe_corr(x, y) if both else F.lit(None).cast("double")).alias("correlation"), F.count(x).alias("n_values")))
    one = df.agg(F.array(*out).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    # different values are counted by column, not by one global aggregate
    kinds = distinct_counts(df, features).select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), col(f"n_distinct:{f}").alias("n_distinct")) for f in features])).alias("k")).select("k.*")
    one = one.join(F.broadcast(kinds), "feature").withColumn("distinct_share", ratio(F.col("n_distinct"), F.col("n_values"))).select("feature", "equal_share", "correlation", "distinct_share", "n_distinct")
    verdict = F.when(F.col("equal_share") == 1, "copy").when((F.abs("correlation") >= 0.995) | (F.col("equal_share") >= 0.995), "suspicious").when((F.col("n_distinct") >= 20) & (F.col("distinct_share") >= 0.98), "identifier").otherwise("fine")
    return one.withColumn("verdict", verdict).drop("n_distinct")


def hash_split(df: DataFrame, key: str, shares: tuple[float, float, float] = (0.6, 0.2, 0.2)) -> DataFrame:
    """The frame with split (train, validation or test), by a hash of the key: rows of one key stay together and no row moves when others are added."""
    u = F.pmod(F.xxhash64(col(key), F.lit(42)), F.lit(10_000)) / 10_000
    return df.withColumn("split", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "validation").otherwise("test"))


def chronological_split(df: DataFrame, time: str, test_share: float = 0.2) -> DataFrame:
    """The frame with split: rows at or after the boundary are test, ties included. The boundary comes from counts per time."""
    counts = df.where(col(time).isNotNull()).groupBy(col(time).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    edge = counts.agg(F.sum("n").alias("all")).select(F.ceil(F.col("all") * (1 - test_share)).alias("want"))  # one row
    days = counts.withColumn("day", F.date_trunc("day", "t"))
    by_day = days.groupBy("day").agg(F.sum("n").alias("n"))
    before_day = by_day.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))  # one row a day
    upto = days.join(before_day, "day").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("day").orderBy("t")))
    boundary = upto.join(F.broadcast(edge), F.col("upto") > F.col("want")).agg(F.min("t").alias("boundary"))
    return df.join(F.broadcast(boundary)).withColumn("split", F.when(col(time) >= F.col("boundary"), "test").otherwise("train")).drop("boundary")
