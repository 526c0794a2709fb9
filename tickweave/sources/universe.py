"""Symbol universe: the reference's fixed lists, and the dimension built from tables.  [S4]"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave import constants as K
from tickweave.schemas import SYMBOLS

EXCHANGE_SUFFIX = {"NS": "NSE", "BO": "BSE"}


def exchange_of(symbol) -> "F.Column":
    """Exchange from a ticker suffix: ``.NS`` -> NSE, ``.BO`` -> BSE, else NULL."""
    sfx = F.regexp_extract(symbol, r"\.(NS|BO)$", 1)
    return F.when(sfx == "NS", F.lit("NSE")).when(sfx == "BO", F.lit("BSE"))


def reference_universe(spark: SparkSession) -> DataFrame:
    """The 9 indices and 2 x 20 stocks the dashboard offers, as a small dimension table."""
    rows = [(code, name, None, "index") for name, code in K.INDICES]
    rows += [(s, s.split(".")[0], None, "stock") for s in K.TOP_NSE + K.TOP_BSE]
    df = spark.createDataFrame(rows, SYMBOLS)
    return df.withColumn("exchange", exchange_of(F.col("symbol")))


def by_exchange(universe: DataFrame, exchange: str) -> DataFrame:
    """The stocks of one exchange (the sidebar's exchange choice)."""
    return universe.filter((F.col("exchange") == exchange) & (F.col("kind") == "stock"))
