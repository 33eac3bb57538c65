"""Whether two sets of rows are the same when one value may differ by a tolerance, matched one to one."""

from __future__ import annotations

from collections import deque
from decimal import Decimal
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.guards import col, finite


def _matched(tolerance: Decimal):
    """Ordered (island, value, text, e, a) -> (island, expected, actual, n): the smallest values that are near enough are taken first, which loses no match.

    Only values that can still be matched are held.
    """
    schema = pa.schema([("island", pa.int64()), ("expected", pa.string()), ("actual", pa.string()), ("n", pa.int64())])

    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for island, some in groupby(rows, key=lambda r: r[0]):
            waiting: dict[str, deque] = {"e": deque(), "a": deque()}  # [value, text, count], at most one side has any near ones
            for _, _, text, e, a in some:
                value = None if text is None else Decimal(text)
                for side, other, count in (("e", "a", e), ("a", "e", a)):
                    queue = waiting[other]
                    while count and queue:
                        first = queue[0]
                        if value is not None and value - first[0] > tolerance:
                            out.append((island, first[1] if other == "e" else None, first[1] if other == "a" else None, first[2]))
                            queue.popleft()
                            continue
                        n = min(count, first[2])
                        pair = (text, first[1]) if side == "e" else (first[1], text)
                        out.append((island, *pair, -n))  # the sign tells a match from a row left alone
                        count, first[2] = count - n, first[2] - n
                        if not first[2]:
                            queue.popleft()
                    if count:
                        waiting[side].append([value, text, count])
                if len(out) > 5000:
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            for side, queue in waiting.items():
                out += [(island, t if side == "e" else None, t if side == "a" else None, n) for _, t, n in queue]
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def match_rows(expected: DataFrame, actual: DataFrame, keys: list[str], value: str, tolerance: float | str | Decimal = 0) -> DataFrame:
    """keys, expected, actual, status (matched, missing or surplus), n: rows with equal keys (null equals null) whose values differ by the tolerance or less, one to one.

    Values are compared as the decimals that they are written as; null matches
    null, NaN and infinities count as null. As many rows as possible are
    matched. Equal rows are counted before they move; keys and values more than
    a tolerance apart go to islands of their own, so a key with very many rows
    is spread, and an island is read in order, not held.
    """
    limit = Decimal(str(tolerance))
    if limit < 0:
        raise ValueError("the tolerance is negative")
    side = lambda df, e: df.select(*[col(k).alias(k) for k in keys], finite(df, value).cast("string").alias("text"), F.lit(e).alias("e"), F.lit(1 - e).alias("a"))
    rows = side(expected, 1).unionByName(side(actual, 0)).groupBy(*[col(k) for k in keys], "text").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    rows = rows.withColumn("value", F.col("text").cast("double"))
    # values in bands with an empty band between them cannot match; bands are twice as wide as the tolerance
    rows = rows.withColumn("band", F.floor(F.col("value") / float(2 * limit)) if limit else F.col("value"))
    named = [col(k) for k in keys]
    bands = rows.select(*named, "band").distinct()
    order = Window.partitionBy(*named).orderBy("band")
    begins = F.col("band").isNull() | F.lag("band").over(order).isNull() | ((F.col("band") - F.lag("band").over(order)) > (1 if limit else 0))
    bands = bands.withColumn("from", F.last(F.when(begins, F.coalesce(F.col("band").cast("string"), F.lit("none"))), True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = F.xxhash64(*named, *[F.col(f"`{k}`").isNull() for k in keys], "from")
    same = F.col("r.band").eqNullSafe(F.col("b.band"))
    for k in keys:
        same = same & F.col(f"r.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    placed = rows.alias("r").join(bands.withColumn("island", islands).alias("b"), same).select(*[F.col(f"r.`{k}`").alias(k) for k in keys], "island", "r.value", "r.text", "e", "a")
    ordered = placed.select("island", "value", "text", "e", "a").repartition("island").sortWithinPartitions("island", "value", "text")
    found = ordered.mapInArrow(_matched(limit), "island long, expected string, actual string, n long")
    status = F.when(F.col("n") < 0, "matched").when(F.col("actual").isNull() & F.col("expected").isNotNull(), "missing").when(F.col("expected").isNull() & F.col("actual").isNotNull(), "surplus")
    # rows without a value that are left alone: which side has more of them
    owners = placed.groupBy("island").agg(*[F.first(col(k)).alias(k) for k in keys], F.sum("e").alias("_e"), F.sum("a").alias("_a"))
    status = F.coalesce(status, F.when(F.col("_e") > F.col("_a"), "missing").otherwise("surplus"))
    kind = expected.schema[value].dataType
    return found.join(owners, "island").select(*named, F.col("expected").cast(kind).alias("expected"), F.col("actual").cast(kind).alias("actual"), status.alias("status"), F.abs("n").alias("n"))


def match_report(matches: DataFrame) -> DataFrame:
    """One row: n_expected, n_actual, n_matched, n_missing, n_surplus, equal."""
    total = lambda s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("n"))), F.lit(0)).cast("long")
    one = matches.agg(total(["matched", "missing"]).alias("n_expected"), total(["matched", "surplus"]).alias("n_actual"), total(["matched"]).alias("n_matched"), total(["missing"]).alias("n_missing"), total(["surplus"]).alias("n_surplus"))
    return one.withColumn("equal", (F.col("n_missing") == 0) & (F.col("n_surplus") == 0))
