"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after a warm-up pass; the median counts (default 1)
BENCH_QUERIES  comma-separated keys to run instead of the headline queries, or `all`
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from blobtide.scratch import drop_scratch
from blobtide.session import build_session
from verification.catalog import CHECKS

HEADLINE = [
    "slot_inclusion",
    "process_rollup",
    "slot_gas_bidding",
    "inclusion_joined",
    "slot_gas_groupby",
    "block_agg",
    "cumulative_fees",
    "rollup_macro",
    "builder_table",
    "bid_stats",
    "worst_case_resubmission",
    "blob_sidecar_spread",
    "block_sidecar_joined",
    "block_blob_table",
    "rolling_propagation",
    "reorged_blocks",
    "missed_by_blob_count",
    "propagation_box_stats",
    "gas_cap_density",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    keys = list(CHECKS) if chosen == "all" else [k for k in chosen.split(",") if k] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(key: str) -> float:
        start = time.perf_counter()
        # noop writes every column of every row and keeps nothing
        CHECKS[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        elapsed = time.perf_counter() - start
        drop_scratch(spark)
        return elapsed

    # one pass over all queries warms the JVM before the first timed run
    for key in keys:
        once(key)
    seconds = {}
    for key in keys:
        seconds[key] = round(statistics.median(once(key) for _ in range(runs)), 3)
        print(key, seconds[key], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
