"""Command line: run catalog queries, or whole dashboard tabs, as Spark jobs and write the
results.

    python -m tickweave.cli list
    python -m tickweave.cli run e3_signal --sf-dir /root/testdata/sf0.1 --out /shared/out --format parquet
    python -m tickweave.cli tab stock --sf-dir ... --out ...
    python -m tickweave.cli run a1_portfolio_totals --sf-dir ... --show 20

Outputs are written by the executors (``df.write``), never collected; ``--show`` prints the
first rows only.
"""

from __future__ import annotations

import argparse
import sys

# The dashboard's tabs as groups of catalog queries.
TABS = {
    "portfolio": ["p3_clean_holdings", "j1_value_holdings", "a1_portfolio_totals", "p7_display_format"],
    "market": ["f9_index_quote", "t3_stream_latest_quote", "j2_unseen_news", "l2_rotating_pick"],
    "stock": ["e2_indicators", "a3_trailing_stats", "p7_volume_text", "l1_tail", "r2_chart_series", "s5_export_csv"],
    "forecast": ["e3_signal", "m2_predict_test_ar1", "m4_forecast_table", "a4_forecast_metrics"],
    "flows": ["a6_net_flow_total", "a6_net_flow"],
    "company": ["r1_statement_wide", "p5_fill_and_stringify", "p2_select_available", "p6_profile_field",
                "p1_select_columns"],
    "alerts": ["j4_fired_alerts", "t6_stream_alerts"],
    "settings": ["p8_favorites_distinct", "s6_settings_json"],
}


def _write(df, path: str, fmt: str) -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("nullValue", "").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def main(argv=None) -> int:
    from tickweave.plans.catalog import QUERIES
    ap = argparse.ArgumentParser(prog="tickweave")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    for name in ("run", "tab"):
        p = sub.add_parser(name)
        p.add_argument("target")
        p.add_argument("--sf-dir", default="/root/testdata/sf0.1")
        p.add_argument("--out")
        p.add_argument("--format", choices=["parquet", "csv", "json"], default="parquet")
        p.add_argument("--show", type=int, default=0)
    a = ap.parse_args(argv)
    if a.cmd == "list":
        for t, qs in TABS.items():
            print(f"{t}: {' '.join(qs)}")
        print("all queries:", " ".join(sorted(QUERIES)))
        return 0
    names = [a.target] if a.cmd == "run" else TABS[a.target]
    unknown = [n for n in names if n not in QUERIES]
    if unknown:
        print(f"unknown query: {unknown}", file=sys.stderr)
        return 2
    from tickweave.session import get_session
    spark = get_session()
    for n in names:
        df = QUERIES[n](spark, a.sf_dir)
        if a.out:
            _write(df, f"{a.out.rstrip('/')}/{n}", a.format)
        if a.show:
            print(f"== {n}")
            df.show(a.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
