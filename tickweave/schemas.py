"""Explicit schemas of the engine's inputs (the reference infers all of them from a provider)."""

from pyspark.sql import types as T

BARS = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("close", T.DoubleType(), True),
    T.StructField("volume", T.DoubleType(), True),
])

HOLDINGS = T.StructType([
    T.StructField("portfolio_id", T.LongType(), True),
    T.StructField("symbol", T.StringType(), True),
    T.StructField("quantity", T.DoubleType(), True),
    T.StructField("buy_price", T.DoubleType(), True),
])

SYMBOLS = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("exchange", T.StringType(), True),
    T.StructField("kind", T.StringType(), True),
])

QUOTES = T.StructType([
    T.StructField("symbol", T.StringType(), True),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("price", T.DoubleType(), True),
])

NEWS = T.StructType([
    T.StructField("url", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("published_at", T.TimestampType(), True),
    T.StructField("source", T.StructType([T.StructField("name", T.StringType(), True)]), True),
    T.StructField("feed_pos", T.LongType(), True),
])

FLOWS = T.StructType([
    T.StructField("date", T.DateType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("side", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
])

STATEMENTS = T.StructType([
    T.StructField("symbol", T.StringType(), True),
    T.StructField("period", T.DateType(), True),
    T.StructField("item", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
])

ALERTS = T.StructType([
    T.StructField("symbol", T.StringType(), True),
    T.StructField("price", T.DoubleType(), True),
])

FAVORITES = T.StructType([
    T.StructField("user_id", T.LongType(), True),
    T.StructField("symbol", T.StringType(), True),
    T.StructField("added_at", T.TimestampType(), True),
])
