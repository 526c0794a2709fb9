"""Inputs of the dashboard derived from the driver's tables (rules in FIXTURES.md).

Every fixture reads whole tables; the only arithmetic on keys makes edge cases that the
reference handles (unpriced holdings, repeated and already-seen news), it drops no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.sources.tables import read_table


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One holding per order line: portfolio = customer, symbol = supplier, quantity and price
    of the line.  Every 7th order's lines get a lower-case symbol that has no bars, to exercise
    the upper-casing of P3 and the inner-join drop of J1."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    sym = F.col("l_suppkey").cast("string")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner").select(
        F.col("o_custkey").alias("portfolio_id"),
        F.when(F.col("l_orderkey") % 7 == 0, F.concat(F.lit("x"), sym)).otherwise(sym).alias("symbol"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("buy_price"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol dimension from ``supplier``: even keys list on NSE, odd keys on BSE."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    return s.select(
        F.col("s_suppkey").cast("string").alias("symbol"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("NSE")).otherwise(F.lit("BSE")).alias("exchange"),
        F.lit("stock").alias("kind"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks from ``events`` (see :func:`quotes_from`)."""
    return quotes_from(read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"]))


def quotes_from(e: DataFrame) -> DataFrame:
    """Ticks from ``events`` rows, batch or stream: symbol = event type, price = value; ``ts``
    turned into a zoned timestamp (watermarks reject TIMESTAMP_NTZ)."""
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.col("event_id"),
    )


def _host(url):
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A news feed from ``pages`` (see :func:`news_from`)."""
    return news_from(read_table(spark, sf_dir, "pages", ["page_id", "url"]))


def news_from(p: DataFrame) -> DataFrame:
    """A news feed from ``pages`` rows, batch or stream: one article per page plus a second
    copy of every 5th page (in-batch repeats); feed order is ``page_id``, then the copy."""
    base = p.select("page_id", "url", F.lit(0).alias("copy"))
    dup = p.filter(F.col("page_id") % 5 == 0).select("page_id", "url", F.lit(1).alias("copy"))
    feed = base.unionByName(dup)
    return feed.select(
        "url",
        F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("content"),
        (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_interval(mins=F.col("page_id").cast("int"))).alias("published_at"),
        F.struct(_host(F.col("url")).alias("name")).alias("source"),
        (F.col("page_id") * 2 + F.col("copy")).alias("feed_pos"),
    )


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs already shown: every 3rd page."""
    p = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    return p.filter(F.col("page_id") % 3 == 0).select("url")


def seen_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs of :func:`seen`, dealt over 500 users by page."""
    p = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    return p.filter(F.col("page_id") % 3 == 0).select((F.col("page_id") % 500).alias("user_id"), "url")


def flows(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Buy/sell amounts per market segment: open lines buy, filled lines sell.  ``lineitem``
    may be a stream of lineitem rows (stream-static joins with orders and customers)."""
    li = lineitem if lineitem is not None else read_table(spark, sf_dir, "lineitem")
    li = li.select("l_orderkey", "l_extendedprice", "l_linestatus", "l_shipdate")
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    cu = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    j = li.join(od, li.l_orderkey == od.o_orderkey).join(cu, F.col("o_custkey") == cu.c_custkey)
    return j.select(
        F.to_date("l_shipdate").alias("date"),
        F.col("c_mktsegment").alias("category"),
        F.when(F.col("l_linestatus") == "O", F.lit("buy")).when(F.col("l_linestatus") == "F", F.lit("sell")).alias("side"),
        F.col("l_extendedprice").alias("amount"),
    )


STATUS_ITEM = {"F": "Total Revenue", "O": "Net Income", "P": "Operating Expense"}


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long statements ``(symbol, period, item, value)``: nation = company, order quarter =
    period, order status = line item, value = sum of order totals.  Absent cells stay absent."""
    od = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])
    cu = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    item = F.when(F.col("o_orderstatus") == "F", F.lit(STATUS_ITEM["F"])) \
        .when(F.col("o_orderstatus") == "O", F.lit(STATUS_ITEM["O"])) \
        .when(F.col("o_orderstatus") == "P", F.lit(STATUS_ITEM["P"]))
    return (
        od.join(cu, od.o_custkey == cu.c_custkey)
        .select(F.col("c_nationkey").cast("string").alias("symbol"),
                F.trunc(F.to_date("o_orderdate"), "quarter").alias("period"),
                item.alias("item"), F.col("o_totalprice").alias("value"))
        .groupBy("symbol", "period", "item").agg(F.sum("value").alias("value"))
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company profiles as string maps: ``events.props`` parsed with ``from_json``."""
    e = read_table(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    return e.select(
        F.col("event_id"),
        F.col("event_type").alias("symbol"),
        F.from_json("props", "map<string,string>").alias("info"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved price alert per supplier: 50 000 + account balance."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_acctbal"])
    return s.select(F.col("s_suppkey").alias("alert_id"), F.col("s_suppkey").cast("string").alias("symbol"),
                    (F.lit(50000.0) + F.col("s_acctbal")).alias("price"))


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourite additions from ``events``: user, event type as symbol, time; repeats kept."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return e.select("user_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("added_at"),
                    "event_id")


def tick_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved alerts on the tick streams of ``events``: one per supplier, on the event type whose place in
    name order is the supplier's key modulo their number, at a tenth of the account balance (-100 to
    1000, where ticks run from 0 to 490: some are crossed upwards, some downwards, some never)."""
    kinds = read_table(spark, sf_dir, "events", ["event_type"]).distinct()  # a handful of rows
    kinds = kinds.agg(F.array_sort(F.collect_list("event_type"))).scalar()
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_acctbal"]).withColumn("kinds", kinds)
    return s.select(F.col("s_suppkey").alias("alert_id"), F.get("kinds", (F.col("s_suppkey") % F.size("kinds")).cast("int")).alias("symbol"),
                    F.round(F.col("s_acctbal") / 10, 2).alias("price"))


#: Line items per statement kind, in display order.
STATEMENT_ITEMS = {
    "income": ["Total Revenue", "Net Income", "Operating Expense"],
    "balance": ["Total Assets", "Total Debt", "Cash And Cash Equivalents"],
    "cashflow": ["Operating Cash Flow", "Capital Expenditure"],
}


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long statements of all three kinds ``(symbol, statement, period, item, value)``; company = nation.

    ``income`` as :func:`statements`.  Of the nations' suppliers, per quarter of the ship date: ``balance`` = sum
    of the extended price by return flag (A assets, N debt, R cash), ``cashflow`` = sum of the discounted
    price by line status (O operating cash flow, F capital expenditure, negative)."""
    income = statements(spark, sf_dir).select("symbol", F.lit("income").alias("statement"), "period", "item", "value")
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount"])
    su = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    assets, debt, cash = STATEMENT_ITEMS["balance"]
    operating, spent = STATEMENT_ITEMS["cashflow"]
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    balance = F.struct(F.lit("balance").alias("statement"),
                       F.when(flag == "A", assets).when(flag == "N", debt).when(flag == "R", cash).alias("item"), F.col("l_extendedprice").alias("value"))
    cashflow = F.struct(F.lit("cashflow").alias("statement"), F.when(status == "O", operating).when(status == "F", spent).alias("item"),
                        F.when(status == "F", -net).otherwise(net).alias("value"))
    lines = li.join(su, li.l_suppkey == su.s_suppkey).select(
        F.col("s_nationkey").cast("string").alias("symbol"), F.trunc(F.to_date("l_shipdate"), "quarter").alias("period"),
        F.explode(F.array(balance, cashflow)).alias("l"))
    lines = lines.groupBy("symbol", "l.statement", "period", "l.item").agg(F.sum("l.value").alias("value"))
    return income.unionByName(lines)
