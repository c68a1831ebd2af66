"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder with the given tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads (default 8)
    BENCH_REPEATS  runs per query, the fastest counts: the first one also compiles the plan (default 2)

Inputs are derived and written once before timing, as the daily job finds them (``setup_sec``).
Results are computed in full through the no-op sink; nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ledger_days", "po01", "po02", "po03", "po03_daily", "po06", "po07", "po08", "po09", "po11", "po13", "po14", "xfer01", "xfer02", "xfer05",
    "xfer04", "xfer07", "twh01", "complete02", "standard_cost", "waste_daily", "adj_daily", "cost01", "cost02", "find_all",
    "prim_over_receipt", "recheck_po03", "recheck_po14", "recheck_xfer05", "recheck_waste", "upsert_state", "action_replay",
    "reconcile_status", "breakdown_order", "exception_fact", "kpis", "open_by_dim", "by_owner", "search_open",
]


def main() -> None:
    from checks.spark_queries import QUERIES
    from tallyguard.session import build_session
    from tallyguard.sources.derived import staged

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session("tallyguard-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    staged(spark, sf_dir)
    setup = time.perf_counter() - started
    only = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in only:
        runs = []
        for _ in range(repeats):
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        seconds[name] = round(min(runs), 3)
        print(name, [round(x, 2) for x in runs], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "setup_sec": round(setup, 3),
    }))


if __name__ == "__main__":
    main()
