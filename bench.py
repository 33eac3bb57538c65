"""Cold and warm wall time of headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from cairn.plans import catalog

NAMES = ["join_inner_segment_revenue", "join_evidence_orders_lineitem", "group_evidence", "prep_clip_iqr", "profile_columns", "eda_numeric", "eda_spearman", "eda_correlation_matrix", "anomaly_mad", "ts_monthly"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for times in (cold, warm):
        for name in NAMES:
            began = time.time()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "warm wall time of all queries", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
