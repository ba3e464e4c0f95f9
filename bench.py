"""Headline-query benchmark.

Runs the headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is fully
materialised with the ``noop`` sink (no driver collect); the figure is the
median of ``$BENCH_REPEAT`` warm runs (the first run warms the JVM and the
file cache and is not counted).  The settlement runs its fixpoint once per
repetition (the per-session cache is cleared) and is repeated
``$BENCH_SETTLE_REPEAT`` times (default 1: one run is ~100 s at sf0.1).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "manager_stats",
    "customer_order_history",
    "admin_orders",
    "revenue_breakdown",
    "conversation_list",
    "restaurant_menu",
    "orders_with_items",
    "loyalty_statement",
    "stock_running",
    "check_orphans",
    "settle_food_orders",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    settle_repeat = int(os.environ.get("BENCH_SETTLE_REPEAT", "1"))
    from ladle.plans import q_settlement
    from ladle.plans.catalog import as_callables
    from ladle.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app_name="ladle-bench")
    qs = as_callables()
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        n = settle_repeat if name.startswith("settle") else repeat
        for i in range(n + 1):
            q_settlement._CACHE.clear()
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "repeat": repeat, "spark": spark.version}))


if __name__ == "__main__":
    main()
