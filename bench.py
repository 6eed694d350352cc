"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gapspark import registry  # noqa: E402
from gapspark.session import build_session  # noqa: E402

HEADLINE = (
    "clean_daily_counts", "top_sensors", "heartbeat_coverage", "gap_intervals", "burst_collapse",
    "validated_rows", "edge_parse", "sent_vs_recorded", "feature_windows", "sliding_sequences",
    "hourly_features_on_calendar", "condition_summary", "box_data", "resource_totals",
    "mann_whitney", "kruskal_batches", "fisher_loss_occurrence", "batch_level_loss",
    "prune_decisions", "backup_log_gaps", "weekday_permutation_test",
    "periodicity_permutation_test", "drift_monitor", "stream_routed_ingest", "rank_correlation", "ar1_fit",
    "kruskal_many_groups", "burst_wait_percentiles",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = registry.entries()
    wanted = sys.argv[1:] or HEADLINE
    entries["rows_per_day"].run(spark, sf_dir).collect()  # warm-up: JVM, codegen, file listing
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
