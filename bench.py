"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from tallyloom.plans import catalog  # noqa: E402
from tallyloom.session import build  # noqa: E402

HEADLINE = (
    "a01_window_rollup", "a03_daily_by_model", "a07_recent_projects", "a10_tools_by_share", "a12_skill_usage",
    "a18_trend_summary", "a25_area_series", "a30_operation_latency", "p11_text_tokens", "t01_counter_deltas",
    "t06_fork_dedup", "t07_message_dedup", "i02_worker_islands", "i03_timeline", "i14_report", "j07_live_board",
    "q04_commit", "b03_next_runs",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build(
        "tallyloom-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["a01_window_rollup"](spark, sf_dir).count()  # session start-up is not a query
    seconds = {}
    for name in names:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
