"""Time the headline queries; prints one JSON line.

Each query runs twice.  The first run also pays for compiling its code and is
reported as ``cold``; the second one, planning included, is the result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import registered  # noqa: E402
from fleetlens.session import build_session  # noqa: E402

HEADLINE = (
    "wifi_running_by_robot", "wifi_minimum_witness", "fleet_kpis", "weighted_hourly_trend", "unsuccessful_outcomes",
    "workload_concentration", "task_timing", "queue_wait", "battery_time_share", "merge_intervals", "state_islands",
    "state_trend_15min", "state_exceptions", "label_trend_distinct", "project_list", "task_list",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "fleetlens-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        started = time.perf_counter()
        registered(name)(spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    cold = {name: seconds(name) for name in HEADLINE}
    times = {name: seconds(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "cold": cold, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
