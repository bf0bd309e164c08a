"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the cores. Each query runs once after a warm-up of the
session; the result goes to Spark's ``noop`` sink, so all rows are computed.
The warehouse is a new folder each time, so stored stage results are made within
the run, by the first query that asks for them.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

HEADLINE = (
    "hourly_profile_raw",
    "hourly_profile_uniform",
    "hourly_profile_informed",
    "profile_HO_informed",
    "profile_legacy_all",
    "compare_profiles",
    "dtw_pairs",
    "next_stop",
    "first_last_raw",
    "month_audit",
    "anchors_dedup",
    "assign_home_zone",
    "assign_fine_zone",
    "od_pairs",
    "od_expanded",
    "od_corr",
    "survey_population",
    "survey_od",
    "survey_hw_hours",
    "survey_ho_hours",
    "survey_all_hours",
    "survey_ho_tours",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tripweave-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tripweave-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()

    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
