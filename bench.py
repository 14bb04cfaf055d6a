"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, and names given as
arguments the queries. Each result is produced in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from heatline.plans.catalog import QUERIES

HEADLINE = [
    "flagship_forecast_error",
    "s1_scan",
    "p11_valid_records",
    "p11_rejected_records",
    "a1_collapse_duplicates",
    "a5_resample",
    "a5_resample_10s",
    "a9_profile",
    "a10_thresholds",
    "a10_thresholds_by_rank",
    "a6_interval_counts",
    "j1_future_targets",
    "j1_future_targets_days",
    "j2_asof_nearest",
    "a20_forecast_performance",
    "j3_latest_per_module",
    "j4_new_records",
    "w13_position",
    "w14_series_features",
    "w14_feature_set",
    "t9_split_by_time",
    "f4_risk_level",
    "w12_risk_transitions",
    "x5_alert_events_batch",
    "a18_model_comparison",
    "t2_latest_events_clamped",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("heatline-bench")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # One query first, so that starting the JVM's code paths is nobody's time.
    QUERIES["a5_resample"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
