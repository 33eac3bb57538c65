"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every end of the edges (columns u, v).

    Each round takes the smallest label among an id's neighbours and then the
    label of that label, so the number of rounds grows with the logarithm of
    the longest path. Each round's labels are written to the shared folder.
    """
    both = cut(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = cut(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v")).select("id", F.least("id", "v").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("id").alias("best"), F.col("label").alias("far"))
        moved = cut(step.join(jump, "best").select("id", "label", F.least("best", "far").alias("new")))
        changed = not moved.where("new <> label").isEmpty()
        labels = moved.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
