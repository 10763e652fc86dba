"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs whole: its result is counted over all columns through a hash, so no column is
pruned away. The figure per query is the median of the runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "app_overview", "P01_parse_file_name", "W01_attempt_number", "J06_task_lifecycle", "G16_app_rollup",
    "J01_logs_with_user", "G02_task_counters", "G04_final_status", "G05_fail_fast", "G07_container_requests",
    "G11_running_average", "G12_gpu_metrics", "G17_status_summary", "J05_slot_assignment", "J07_as_of_metrics",
    "J08_arrival_matching", "W03_rank_plan", "W07_heartbeat_gap", "W08_dependency_countdown", "W09_failure_runs",
    "O01_app_list", "O02_attention_order", "U04_snapshot_difference", "D02_acyclic_app_graphs",
    "S01_event_log_scan", "K01_event_log_append", "T01_event_ingest", "T04_registration_timeout_stream",
    "T05_allocation_timeout_stream", "T07_group_timeout_stream", "T13_dependency_countdown_stream", "K03_store_partition", "J02_killed_landing_contains", "T03_liveness_sessions_stream", "T08_metric_state",
    "T09_task_state_stream", "T15_interval_rollup_stream", "M02_linear_fit", "M10_epoch_table",
]


def run(query, spark, sf_dir: str) -> float:
    from pyspark.sql import functions as F

    start = time.perf_counter()
    df = query(spark, sf_dir)
    df.select(F.xxhash64(*df.columns).alias("h")).agg(F.bit_xor("h")).collect()
    return time.perf_counter() - start


def main() -> None:
    from runledger.plans.catalog import QUERIES
    from runledger.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    seconds = {}
    for name in names:
        run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
