"""Headline-query benchmark.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "headline_suite_total", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected); one warm-up run, then the median of ``$BENCH_RUNS``
timed runs (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "kpi_totals_by_outlet", "trend_month", "top5_items", "heatmap_dow_hour", "outlet_month_matrix",
    "promo_efficiency", "season_comparison", "decline_summary", "report_breakdowns", "report_summary",
    "ingest_verdicts", "holiday_auto_tune", "ingredient_demand_monthly", "forecast_fit_metrics",
    "forecast_horizon", "intent_classification", "pva_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from tillpoint.session import build_session
    eventlog = tempfile.mkdtemp(prefix="tillpoint-bench-events-")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, app_name="tillpoint-bench",
                          extra={"spark.driver.memory": "16g", "spark.eventLog.enabled": "true",
                                 "spark.eventLog.dir": eventlog})
    from tillpoint.plans.catalog import QUERIES
    names = [n for n in HEADLINE if n in QUERIES]
    only = os.environ.get("BENCH_ONLY")
    if only:
        names = [n for n in names if any(p in n for p in only.split(","))]
    times = {}
    for name in names:
        fn = QUERIES[name][0]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_suite_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "runs": runs,
                      "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))
    spark.stop()


if __name__ == "__main__":
    main()
