"""Times the headline queries: warm median of three, as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from catalog.queries import QUERIES

HEADLINE = (
    "b7_detect_all_documents",
    "c1_distinct_segments",
    "c4_segment_counts",
    "c5_precedence",
    "d2_scrub_documents",
    "d2_scrub_pages",
    "d2_scrub_log_lines",
    "d3_dictionary_rewrite",
    "d4_mask_log_lines",
    "d5_token_dictionary",
    "e1_density_routes",
    "s5_hybrid",
    "s2_sam_documents",
    "a8_merge_parts",
    "g1_run_summary",
    "a5_run_folder",
    "d3_dictionary_rewrite_documents_wide",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("veilframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(repeats + 1):
            start = time.monotonic()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.monotonic() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
