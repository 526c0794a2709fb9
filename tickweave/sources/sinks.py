"""Sinks: the enriched frame as CSV (S5) and user settings as JSON (S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave import constants as K


def export_csv(df: DataFrame, path: str, partition_by: str | None = "symbol", sort_by: str | None = "date") -> None:
    """Write with a header; missing values become empty fields.  [S5]  Partitioned by symbol
    so that each symbol's file is what the reference's download button gives for one ticker,
    and the write is parallel.

    Rows are dealt by symbol first, whatever the frame's own partitioning, so a symbol is one file and not
    one per task; the deal is a rebalance, which AQE splits where a symbol is larger than the advisory
    partition size and merges where many are small. Files are in ``sort_by`` order, where there is such a column."""
    if partition_by:
        df = df.hint("rebalance", partition_by)
        if sort_by and sort_by in df.columns:
            df = df.sortWithinPartitions(partition_by, sort_by)
    w = df.write.mode("overwrite").option("header", True).option("nullValue", "")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def settings_json(favorites_lists: DataFrame, alerts: DataFrame | None = None,
                  epochs: int = K.DEFAULT_EPOCHS, batch_size: int = K.DEFAULT_BATCH_SIZE,
                  holdings: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Per user, the exportable settings as one JSON document: favourites (in their list
    order), saved alerts, portfolio, seen article urls (each a sorted array, where its table
    is given) and the model configuration.  [S6]  Sets and tuples of the reference become
    arrays; ``to_json`` does the serialising inside the JVM."""
    df = favorites_lists
    names = ["favorites"]
    parts = [("alerts", alerts, F.collect_list(F.struct(F.col("symbol").alias("stock"), "price"))),
             ("portfolio", holdings, F.collect_list(F.struct(F.upper("symbol").alias("ticker"), "quantity", "buy_price"))),
             ("seen_articles", seen, F.collect_set("url"))]
    for name, rows, items in parts:
        if rows is None:
            continue
        part = rows.groupBy(F.col("user_id").alias("_user")).agg(F.array_sort(items).alias(name))
        # either side may be alone: a user with alerts only still has settings
        df = df.join(part, df["user_id"].eqNullSafe(part["_user"]), "full").withColumn(
            "user_id", F.coalesce("user_id", "_user")).drop("_user")
        names.append(name)
    types = dict(df.dtypes)
    cols = [F.coalesce(F.col(n), F.array().cast(types[n])).alias(n) for n in names]
    cfg = F.struct(F.lit(epochs).alias("epochs"), F.lit(batch_size).alias("batch_size")).alias("model_config")
    return df.select("user_id", F.to_json(F.struct(*cols, cfg)).alias("settings_json"))


def export_settings_json(settings: DataFrame, path: str) -> None:
    """One JSON document per line.  [S6]"""
    settings.select("settings_json").write.mode("overwrite").text(path)
