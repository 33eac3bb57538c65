"""Univariate, bivariate and multivariate statistics, and screening for anomalies."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.exact import ExactFloats
from cairn.functions.guards import col, finite, is_numeric, kind_of, safe_corr
from cairn.operators.ranks import average_ranks, median_and_deviation, percentiles, percentiles_by


def _x(df: DataFrame, column: str):
    if not is_numeric(kind_of(df, column)):
        raise ValueError(f"{column} is no number")
    return finite(df, column).cast("double")


def numeric_summary(df: DataFrame, column: str, shares: tuple[float, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """One row: counts, mean, sample variance and deviation, extremes, range, percentiles (linear) as p5, p25, ..."""
    x = _x(df, column)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(x).alias("n_valid"), F.count_if(col(column).isNull()).alias("n_null"), ExactFloats(df, [column]).average(column).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("stddev"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), (F.max(x) - F.min(x)).alias("value_range"))
    q = percentiles(df, {"q": x}, [p / 100 for p in shares])
    return one.join(F.broadcast(q)).select("*", *[F.col("q")[i].alias(f"p{p:g}".replace(".", "_")) for i, p in enumerate(shares)]).drop("q")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, lower, upper, n of equal-width bins, left-closed, the last closed; a constant falls into bin 0."""
    x = _x(df, column)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("lo is not null")  # one row
    width = F.col("hi") - F.col("lo")
    nth = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("x") - F.col("lo"), width) * bins)))
    counts = df.select(x.alias("x")).where("x is not null").join(F.broadcast(ends)).groupBy(nth.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return grid.join(counts, "bin", "left").select(F.col("bin"), (F.col("lo") + width * F.col("bin") / bins).alias("lower"), (F.col("lo") + width * (F.col("bin") + 1) / bins).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """q1, median, q3, iqr, and whiskers at the outermost values within 1.5 iqr of the box."""
    x = _x(df, column)
    box = percentiles(df, {"q": x}, [0.25, 0.5, 0.75]).select(*[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    box = box.withColumn("iqr", F.col("q3") - F.col("q1"))
    inside = F.when((F.col("x") >= F.col("q1") - 1.5 * F.col("iqr")) & (F.col("x") <= F.col("q3") + 1.5 * F.col("iqr")), F.col("x"))
    return df.select(x.alias("x")).join(F.broadcast(box)).groupBy("q1", "median", "q3", "iqr").agg(F.min(inside).alias("low_whisker"), F.max(inside).alias("high_whisker"), F.count("x").cast("long").alias("n"), (F.count("x") - F.count(inside)).alias("n_outside"))


def temporal_summary(df: DataFrame, column: str) -> DataFrame:
    """n_valid, first, last, whole days and seconds (with fractions; days of a date) between them."""
    c = col(column)
    seconds = F.timestamp_diff("MICROSECOND", F.min(c).cast("timestamp"), F.max(c).cast("timestamp")) / 1e6
    return df.agg(F.count(c).alias("n_valid"), F.min(c).alias("first"), F.max(c).alias("last"), F.datediff(F.max(c), F.min(c)).cast("long").alias("coverage_days"), seconds.alias("coverage_seconds"))


def pair_statistics(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, pearson, covariance (sample) over rows where both values are finite."""
    both = df.select(_x(df, x).alias("x"), _x(df, y).alias("y")).where("x is not null and y is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("x"), F.col("y")).alias("pearson"), F.when(F.count(F.lit(1)) > 1, F.covar_samp("x", "y")).alias("covariance"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n and the Pearson correlation of average ranks over rows where both values are finite."""
    pairs = df.select(_x(df, x).alias("x"), _x(df, y).alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    ranks = {c: average_ranks(pairs.groupBy(c).agg(F.sum("n").alias("n")), c).withColumnRenamed("rank", f"r{c}") for c in ("x", "y")}
    joined = pairs.join(ranks["x"], "x").join(ranks["y"], "y")
    n, a, b = (F.col(c).cast("double") for c in ("n", "rx", "ry"))
    m = joined.agg(F.sum(n).alias("n"), F.sum(n * a).alias("sa"), F.sum(n * b).alias("sb"), F.sum(n * a * a).alias("saa"), F.sum(n * b * b).alias("sbb"), F.sum(n * a * b).alias("sab"))
    va, vb = (F.col(f"s{k}{k}") / F.col("n") - F.pow(F.col(f"s{k}") / F.col("n"), 2) for k in "ab")
    cov = F.col("sab") / F.col("n") - F.col("sa") * F.col("sb") / F.col("n") / F.col("n")
    return m.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when((va > 0) & (vb > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(va) / F.sqrt(vb)))).alias("spearman"))


def group_summary(df: DataFrame, category: str, value: str) -> DataFrame:
    """Count, mean, median, extremes, sample variance and deviation (0 for one row) of each category that is not null."""
    x = _x(df, value)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = df.select(col(category).alias("category"), x.alias("x")).where("category is not null and x is not null")
    out = rows.groupBy("category").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("minimum"), F.max("x").alias("maximum"), zero(F.var_samp("x")).alias("variance"), zero(F.stddev_samp("x")).alias("stddev"))
    return out.join(percentiles_by(rows, ["category"], "x", [0.5]).select("category", F.col("q")[0].alias("median")), "category")


def contingency(df: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    """a, b, n of all pairs of values that occur; ``most``: of the first labels of each side in their order, labels without a count there left out."""
    cells = df.select(col(a).cast("string").alias("a"), col(b).cast("string").alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    if most:
        for side in ("a", "b"):
            cells = cells.join(F.broadcast(cells.select(side).distinct().orderBy(side).limit(most)), side, "left_semi")
    return cells


def eda_report(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """column_name, section, item, value: for numbers their summary and histogram, for others their k most frequent values."""
    out = None
    for c in columns:
        if is_numeric(kind_of(df, c)):
            one = numeric_summary(df, c)
            names = [n for n in one.columns]
            rows = one.select(F.explode(F.array(*[F.struct(F.lit("summary").alias("section"), F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in names])).alias("r")).select("r.*")
            rows = rows.unionByName(histogram(df, c).select(F.lit("histogram").alias("section"), F.col("bin").cast("string").alias("item"), F.col("n").cast("double").alias("value")))
        else:
            top = df.where(col(c).isNotNull()).groupBy(col(c).cast("string").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("value"))
            rows = top.orderBy(F.desc("value"), "item").limit(k).select(F.lit("frequency").alias("section"), "item", "value")
        rows = rows.select(F.lit(c).alias("column_name"), "section", "item", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi_square, cramers_v (null with fewer than two labels on a side), n."""
    cells = contingency(df, a, b)
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("row")), cells.groupBy("b").agg(F.sum("n").alias("column"))
    # sum over all cells of n^2 / (row * column) - 1 needs only the cells that occur
    share = cells.join(rows, "a").join(columns, "b").agg(F.sum(F.col("n").cast("double") * F.col("n") / F.col("row") / F.col("column")).alias("s"), F.sum("n").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    chi = F.col("n") * (F.col("s") - 1)
    least = F.least("r", "c") - 1
    return share.select(chi.alias("chi_square"), F.when(least > 0, F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("s") - 1, least))))).alias("cramers_v"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, pearson, n over pairwise valid rows, for x <= y in the given order.

    Sums of the values, centred at their means, are taken once for each set of
    columns that a row has; a pair adds up the sets that hold both of its columns.
    """
    k = len(columns)
    pairs = list(combinations_with_replacement(range(k), 2))
    rows = df.select(*[_x(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    means = rows.agg(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(k)])
    valid = sum((F.when(F.col(f"x{i}").isNotNull(), 1 << i).otherwise(0) for i in range(k)), F.lit(0))
    centred = rows.join(F.broadcast(means)).select(valid.alias("valid"), *[F.coalesce(F.col(f"x{i}") - F.col(f"m{i}"), F.lit(0.0)).alias(f"x{i}") for i in range(k)])
    ends = [f(f"x{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))]
    sums = centred.groupBy("valid").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(k)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs], *ends)
    out = []
    for i, j in pairs:
        both = F.col("valid").bitwiseAND((1 << i) | (1 << j)) == ((1 << i) | (1 << j))
        total = lambda c: F.sum(F.when(both, F.col(c)))  # noqa: B023, E731
        n = F.coalesce(total("n"), F.lit(0))
        mean = lambda c: F.try_divide(total(c), n)  # noqa: B023, E731
        moment = lambda a, b: mean(f"p{min(a, b)}_{max(a, b)}") - mean(f"s{a}") * mean(f"s{b}")  # noqa: B023, E731
        varies = lambda a: F.max(F.when(both, F.col(f"hi{a}"))) > F.min(F.when(both, F.col(f"lo{a}")))  # noqa: B023, E731
        r = F.try_divide(moment(i, j), F.sqrt(F.greatest(moment(i, i), F.lit(0.0))) * F.sqrt(F.greatest(moment(j, j), F.lit(0.0))))
        out.append(F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), F.when((n > 1) & varies(i) & varies(j), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("pearson"), n.alias("n")).alias(f"r{i}_{j}"))
    return sums.agg(*out).select(F.explode(F.array(*[F.col(f"r{i}_{j}") for i, j in pairs])).alias("r")).select("r.*")


def anomalies(df: DataFrame, key: str, column: str, threshold: float = 3.5, least: int = 8) -> DataFrame:
    """key, value, score of rows whose modified z-score is over the threshold: |x - median| / (1.4826 MAD), else by IQR / 1.349, else any deviation."""
    rows = df.select(col(key).alias("key"), _x(df, column).alias("value")).where("value is not null")
    # a few numbers, known before the rows are scored; distances are counted by value, not by row
    one = median_and_deviation(rows, F.col("value"), [0.25, 0.5, 0.75])
    if one is None or one[0] < least:
        return rows.select("key", "value", F.lit(None).cast("double").alias("score")).limit(0)
    (low, middle, high), mad = one[1], one[2] * 1.4826
    scale = mad if mad > 0 else (high - low) / 1.349
    d = F.abs(F.col("value") - middle)
    score = d / F.lit(float(scale)) if scale > 0 else F.when(d > 0, F.lit(float("inf"))).otherwise(0.0)
    return rows.select("key", "value", score.alias("score")).where(F.col("score") > threshold)
