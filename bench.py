"""Time the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from plumbline.queries import QUERIES

HEADLINE = ["flagship_order_summary", "c3_traverse_1n", "c9_asof_last", "c16_salted_join", "d2_aggregate", "d7_rollup_levels", "d10_salted_aggregate", "e2_running", "h6_impact", "i3_rules", "j9_profile", "j17_dedupe", "k1_conservation", "m13_followups"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
