"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` the local cores.
Every query runs to the end through the ``noop`` sink, which reads all its rows and columns.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from footfall.catalogue.queries import QUERIES  # noqa: E402

HEADLINE = [
    "exposure_summary",
    "exposed_people",
    "cohort_matched",
    "use_by_period",
    "search_by_period",
    "conversion_panel",
    "regression_data",
    "ols_by_app",
    "did_by_app",
    "active_people",
    "app_day_totals",
    "weekly_places_rank",
    "user_day_scaled",
    "topic_terms",
    "kmodes_clusters",
    "cluster_sizes",
    "seed_filter",
    "negative_sample",
    "word_mi",
    "keyword_search",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("footfall-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # Longer generated methods are never optimised by the JVM; Spark then runs the split form instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder}))


if __name__ == "__main__":
    main()
