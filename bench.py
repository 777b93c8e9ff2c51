"""Headline queries on one Parquet folder; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from emberline.plans.registry import catalogue  # noqa: E402

HEADLINE = [
    "a6_load_stats", "d13_load_stats_json", "c1_membership_join", "d4_dominant_event_type", "d6_distinct_actors", "d7_centroid",
    "e1_representatives", "e2_top_classes", "p3_incident_profiles", "h4_chunks", "c3_cache_lookup", "c4_scatter_back",
    "c7_nearest_chunks", "k1_core_distance", "k7_density_labels", "h23_parse_responses",
    "a11_markdown_report", "p1_full_analysis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("emberline-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    queries, seconds = catalogue(), {}
    only = sys.argv[1:] or HEADLINE
    for name in only:
        start = time.perf_counter()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
