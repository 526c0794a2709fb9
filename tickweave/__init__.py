"""tickweave — market analytics for many symbols at once, written as Spark DataFrame plans.

Sub-packages:
  sources/    readers of the driver tables, bar building (S1-S3), symbol universe (S4), sinks (S5, S6)
  functions/  Column expressions: indicators (W1-W7), scalar rules (F1-F5, F8), formatting (P5-P7)
  operators/  DataFrame -> DataFrame operators: series (A2, A3, L1, W8, W9, F9), portfolio, feeds,
              statements, charts
  plans/      end-to-end plans: forecasting (F7, A4, A5, A7, M1-M5) and the trade signal (J3)
  streaming/  Structured Streaming forms (T1-T6)
"""

__version__ = "0.1.0"

# The public API in one place: every name below takes and returns DataFrames or Columns.
from tickweave.functions.indicators import add_indicators  # noqa: E402
from tickweave.functions.rules import (  # noqa: E402
    action, business_days, expected_change_pct, risk_score, round_to_strike, rsi_or_default)
from tickweave.operators.feeds import (  # noqa: E402
    article_card, favorites_distinct, fired_alerts, net_flow, rotating_pick, unseen)
from tickweave.operators.portfolio import clean_holdings, portfolio_totals, value_holdings  # noqa: E402
from tickweave.operators.series import (  # noqa: E402
    index_quote, latest, series_chunks, series_index, tail, trailing_stats)
from tickweave.operators.statements import (  # noqa: E402
    fill_and_stringify, profile_fields, select_available, statement_wide)
from tickweave.plans.signal import ar1_signal, pooled_signal  # noqa: E402
from tickweave.sources.bars import build_bars, load_bars, read_bars, recent_bars, store_bars  # noqa: E402
from tickweave.sources.sinks import export_csv, export_settings_json, settings_json  # noqa: E402
from tickweave.session import get_session, materialize, shared_dir  # noqa: E402

__all__ = [
    "add_indicators", "action", "business_days", "expected_change_pct", "risk_score", "round_to_strike",
    "rsi_or_default", "article_card", "favorites_distinct", "fired_alerts", "net_flow", "rotating_pick", "unseen",
    "clean_holdings", "portfolio_totals", "value_holdings", "index_quote", "latest", "series_chunks",
    "series_index", "tail", "trailing_stats", "fill_and_stringify", "profile_fields", "select_available",
    "statement_wide", "ar1_signal", "pooled_signal", "build_bars", "load_bars", "read_bars", "recent_bars",
    "store_bars", "export_csv", "export_settings_json", "settings_json", "get_session", "materialize", "shared_dir",
]
