"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "label_counts", "build_series", "norm_stats", "make_examples", "sweep_label_counts",
    "sweep_summary", "pack_series", "centroid_score", "feature_profile", "spectral_indices",
    "evaluate_report", "classification_report", "prediction_timeline", "latest_scene_version",
    "class_profile", "skip_existing_scenes", "partition_inventory", "sample_raster_at_points",
    "score_sweep", "shuffle_batches", "mixup", "resume_sweep", "stream_series_refresh",
]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    from pyspark.sql import SparkSession

    from fieldtide.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fieldtide-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds_of_headline_queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(scale.group(1)) if scale else None,
        "cpus": int(cpus), "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
