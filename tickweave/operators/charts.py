"""Data behind the dashboard's charts (rendering itself is not built)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHART_COLUMNS = ["open", "high", "low", "close", "volume", "ma20", "ma50", "ma200", "rsi", "volatility"]


def chart_series(enriched: DataFrame, cols=CHART_COLUMNS) -> DataFrame:
    """Long form ``(symbol, date, series, value)``: one line per chart series, the candle
    fields and volume included; missing points are left out, as a plot skips them.  [R2]

    ``unpivot`` is a narrow Expand, no shuffle."""
    cols = [c for c in cols if c in enriched.columns]
    long = enriched.select("symbol", "date", *[F.col(c).cast("double") for c in cols]).unpivot(
        ["symbol", "date"], cols, "series", "value")
    return long.filter(F.col("value").isNotNull())
