"""Runs the headline queries and prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from evenhand.plans import catalog

HEADLINE = ["hardness_overlap", "hardness_neighborhood", "resample_easy", "resample_mid", "resample_hard", "ensemble_bags", "ensemble_soft_nc", "ensemble_soft_tree", "hardness_statistics"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):  # the first warms up
            began = time.time()
            catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
            spark.catalog.clearCache()
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "median": round(statistics.median(took.values()), 3)}))


if __name__ == "__main__":
    main()
