"""Benchmark: the headline plans at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``.  Each query is fully evaluated into Spark's ``noop`` sink (every row
computed, nothing collected); one warm-up pass, then the best of ``$BENCH_RUNS`` (default 3).
Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "s3_build_bars",        # trades -> daily OHLCV bars
    "e2_indicators",        # full indicator set: change, return, RSI, MA20/50/200, volatility
    "a3_trailing_stats",    # latest close, 20-day volume, 52-week high/low
    "j1_value_holdings",    # holdings valued at last close
    "a1_portfolio_totals",  # per-portfolio totals
    "e3_signal",            # scale -> samples -> AR(1) fit -> metrics -> 30-step forecast -> action
    "j4_fired_alerts",      # alert crossings
    "j2_unseen_news",       # news de-duplication against the seen set
    "a6_net_flow",          # buy/sell/net flows
    "r1_statement_wide",    # statements pivot
    "r2_chart_series",      # chart data (unpivot)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from tickweave.plans.catalog import QUERIES
    from tickweave.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times = {}
    for name in HEADLINE:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
