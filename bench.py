"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Per query the median of three runs after a warm-up, building the plan included, with the rows it gives and the jobs a
run takes.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.queries import QUERIES
from copyloom.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3

HEADLINE = [
    "overlap_counts",
    "overlap_counts_sweep",
    "library_size_factor",
    "union_intervals",
    "annotated_sample_calls",
    "gene_deletion_table",
    "calls_common_variants",
    "sample_neighbours",
    "select_references",
    "scan_windows",
]


def seconds(spark, name: str) -> float:
    spark.sparkContext.setJobGroup(name, name)
    started = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def jobs(spark, name: str) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def main() -> None:
    spark = local_session(CPUS, "bench", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    times, counts, rows = {}, {}, {}
    for name in HEADLINE:
        rows[name] = QUERIES[name](spark, SF_DIR).count()
        seconds(spark, name)
        counts[name] = jobs(spark, name)
        times[name] = round(statistics.median(seconds(spark, name) for _ in range(RUNS)), 3)
    scale = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "rows": rows, "jobs": counts, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
