"""Headline queries on local cores; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8)
the number of cores. Every query runs over the whole tables and is written to a
no-op sink, so all rows and columns are produced and nothing reaches the driver.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from syncohort.plans.registered import QUERIES

HEADLINES = [
    "prepare_cohort",
    "survival_at_horizon_diff",
    "logrank_share",
    "jsd_univariate",
    "pcd",
    "percentile_type2",
    "roc_auc",
    "ims",
    "dcr_mean",
    "identifiability_score",
    "mia_density",
    "bootstrap",
    "synthesize_saturated",
    "mlpl",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("syncohort-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start executors before the clock
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
