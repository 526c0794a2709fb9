"""Portfolio valuation: clean holdings (P3), value them at the last close (J1, F6) and sum
per portfolio (A1).  The reference loops over holdings in Python; here it is one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.operators.series import latest
from tickweave.sources.bars import recent_bars


def clean_holdings(holdings: DataFrame) -> DataFrame:
    """Keep holdings with a non-empty ticker, quantity > 0 and buy price > 0; upper-case the
    ticker.  [P3]  Narrow: a filter and a projection, fused into the scan's codegen stage."""
    sym = F.col("symbol")
    return holdings.filter(
        sym.isNotNull() & (F.length(sym) > 0) & (F.col("quantity") > 0) & (F.col("buy_price") > 0)
    ).withColumn("symbol", F.upper(F.col("symbol")))


def holding_pnl(df: DataFrame, price_col: str = "current_price") -> DataFrame:
    """cost, value, pnl and pnl % (0 when the cost is 0).  [F6]"""
    cost = F.col("buy_price") * F.col("quantity")
    value = F.col(price_col) * F.col("quantity")
    return (
        df.withColumn("value", value).withColumn("cost", cost)
        .withColumn("pnl", F.col("value") - F.col("cost"))
        .withColumn("pnl_pct", F.when(F.col("cost") != 0, F.col("pnl") / F.col("cost") * F.lit(100.0))
                    .otherwise(F.lit(0.0)))
    )


def last_prices(bars: DataFrame, as_of, months: int = 1) -> DataFrame:
    """Last close of every symbol inside the last ``months`` before ``as_of``."""
    return latest(recent_bars(bars, as_of, months), ["close"]).select(
        "symbol", F.col("last_close").alias("current_price"))


def value_holdings(holdings: DataFrame, bars: DataFrame, as_of, months: int = 1) -> DataFrame:
    """Each holding at the last close of its symbol; holdings without a price are dropped
    (inner join); two holdings of one ticker stay two rows.  [J1]

    The price side has one row per symbol.  No broadcast hint: AQE measures that side at
    runtime and broadcasts it when it is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``;
    a universe too large for that becomes a sort-merge join whose skewed partitions AQE splits."""
    px = last_prices(bars, as_of, months)
    return holding_pnl(clean_holdings(holdings).join(px, "symbol", "inner"))


def portfolio_totals(valued: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """Total cost, value, PNL and return % per portfolio; the return is sum(pnl)/sum(cost),
    not a mean of percentages, and 0 when the cost is 0.  [A1]"""
    agg = valued.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_holdings"),
        F.sum("cost").alias("total_cost"),
        F.sum("value").alias("total_value"),
        F.sum("pnl").alias("total_pnl"),
    )
    return agg.withColumn(
        "total_return_pct",
        F.when(F.col("total_cost") != 0, F.col("total_pnl") / F.col("total_cost") * F.lit(100.0)).otherwise(F.lit(0.0)),
    )
