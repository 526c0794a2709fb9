"""The query catalog: one named query per operator of the inventory.

Every query reads the driver's tables under ``sf_dir`` (or data Spark derives from them) and
returns a DataFrame whose columns are named exactly like the twin SQL in
:mod:`tickweave.plans.oracle`.  Doubles are rounded to 6 decimals at the very end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.functions.indicators import add_indicators
from tickweave.operators import series as S
from tickweave.plans.common import round_doubles
from tickweave.sources import bars as B

# Parameters of the catalog queries (fixed, documented in FIXTURES.md).
LOAD_START, LOAD_END = "1997-01-01", "2000-01-01"
AS_OF = "2001-06-30"
PRICE_SCALE = 2  # l_extendedprice has two decimals


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.daily_bars(spark, sf_dir)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_indicators(bars(spark, sf_dir), price_scale=PRICE_SCALE)


def q_s3_build_bars(spark, sf_dir):
    return round_doubles(bars(spark, sf_dir))


def q_s3_bars_any_key(spark, sf_dir):
    """Daily bars with the tie-break given as plain columns: every trade of a day has the same time here,
    so all bars go through the settling of ties."""
    b = B.build_bars(B.lineitem_trades(spark, sf_dir), seq=B.LINEITEM_SEQ)
    return round_doubles(b.withColumn("volume", F.col("volume").cast("double")))


def q_s3_intraday_any_key(spark, sf_dir):
    """Hourly bars of the tick streams with the event id as tie-break column: ties are rare."""
    from tickweave.sources.fixtures import quotes
    q = quotes(spark, sf_dir).withColumn("qty", F.lit(1.0))
    b = B.build_bars(q, every="1 hour", seq=["event_id"])
    return round_doubles(b.withColumn("bar_start", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss")))


def q_s3_intraday_bars(spark, sf_dir):
    """Hourly OHLC bars of every tick stream in ``events`` (volume = number of ticks); open and
    close by (time, event id), packed into one fixed-width key."""
    from tickweave.sources.bars import ts_seq_key
    from tickweave.sources.fixtures import quotes
    q = quotes(spark, sf_dir).withColumn("qty", F.lit(1.0))
    b = B.build_bars(q, every="1 hour", order_key=ts_seq_key(F.col("ts"), F.col("event_id")))
    return round_doubles(b.withColumn("bar_start", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss")))


def q_s1_load_bars(spark, sf_dir):
    """The date range is given to the bar builder too, so it is pushed into the trade scan."""
    return round_doubles(B.load_bars(B.daily_bars(spark, sf_dir, LOAD_START, LOAD_END), LOAD_START, LOAD_END))


def q_s2_recent_bars(spark, sf_dir):
    return round_doubles(B.recent_bars(bars(spark, sf_dir), AS_OF, months=1))


def _ind(spark, sf_dir, cols):
    return round_doubles(enriched(spark, sf_dir).select("symbol", "date", *cols))


def q_w1_diff(spark, sf_dir):
    return _ind(spark, sf_dir, ["change"])


def q_w2_daily_return(spark, sf_dir):
    return _ind(spark, sf_dir, ["daily_return"])


def q_w3_gain_loss(spark, sf_dir):
    return _ind(spark, sf_dir, ["gain", "loss"])


def q_w4_sma(spark, sf_dir):
    return _ind(spark, sf_dir, ["ma20", "ma50", "ma200"])


def q_w5_rolling_mean(spark, sf_dir):
    from tickweave.functions.indicators import rolling_mean, series_window
    w = series_window()
    df = enriched(spark, sf_dir)
    return round_doubles(df.select("symbol", "date",
                                   rolling_mean(F.col("gain"), 14, w, 14).alias("avg_gain"),
                                   rolling_mean(F.col("loss"), 14, w, 14).alias("avg_loss")))


def q_w6_rsi(spark, sf_dir):
    return _ind(spark, sf_dir, ["rsi"])


def q_w7_volatility(spark, sf_dir):
    return _ind(spark, sf_dir, ["volatility"])


def q_e2_indicators(spark, sf_dir):
    """The whole enriched frame (entry point E2)."""
    return round_doubles(enriched(spark, sf_dir))


def q_e2_indicators_chunked(spark, sf_dir):
    """The enriched frame computed on 200-row pieces of every series (plus a 200-row halo):
    what the plan does when one symbol is too large for one task.  Equal to ``e2``."""
    from tickweave.session import materialize
    # series_index reads the bars twice (positions, bucket counts): written once
    return round_doubles(add_indicators(materialize(bars(spark, sf_dir)), price_scale=PRICE_SCALE, chunk_rows=200))


def q_e2_indicators_bucketed(spark, sf_dir):
    """The enriched frame computed from a bar table bucketed by symbol: the windows read
    co-located buckets, so the plan after the scan has no Exchange.  Equal to ``e2``."""
    name = B.store_bars(bars(spark, sf_dir))
    return round_doubles(add_indicators(B.read_bars(spark, name), price_scale=PRICE_SCALE))


def q_e2_intraday_indicators(spark, sf_dir):
    """RSI, MA20/50 and volatility over the hourly bars of the tick streams in ``events``."""
    from tickweave.sources.bars import ts_seq_key
    from tickweave.sources.fixtures import quotes
    q = quotes(spark, sf_dir).withColumn("qty", F.lit(1.0))
    b = B.build_bars(q, every="1 hour", order_key=ts_seq_key(F.col("ts"), F.col("event_id")))
    ind = add_indicators(b, price_scale=PRICE_SCALE, ma_windows=(20, 50), order_col="bar_start")
    return round_doubles(ind.select("symbol", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss").alias("bar_start"),
                                    "close", "rsi", "ma20", "ma50", "volatility"))


def _recent(spark, sf_dir, n):
    return S.recent_indicators(bars(spark, sf_dir), n, price_scale=PRICE_SCALE)


def q_a2_latest(spark, sf_dir):
    return round_doubles(S.latest(_recent(spark, sf_dir, 1), ["close", "rsi"]))


def q_a3_trailing_stats(spark, sf_dir):
    return round_doubles(S.trailing_stats(bars(spark, sf_dir)))


def q_l1_tail(spark, sf_dir):
    return round_doubles(_recent(spark, sf_dir, 50))


def q_p1_select_columns(spark, sf_dir):
    return round_doubles(S.select_columns(_recent(spark, sf_dir, 20), ["close", "rsi"]))


def q_p4_add_if_missing(spark, sf_dir):
    """MA columns are added only where absent: ``ma20`` already exists and is kept as is."""
    from tickweave.functions.indicators import rolling_mean, series_window
    w = series_window()
    df = bars(spark, sf_dir).withColumn("ma20", F.lit(None).cast("double"))
    for n in (20, 50, 200):
        df = S.add_if_missing(df, f"ma{n}", lambda _d, n=n: rolling_mean(F.col("close"), n, w))
    return round_doubles(df.select("symbol", "date", "ma20", "ma50", "ma200"))


def q_f9_index_quote(spark, sf_dir):
    return round_doubles(S.index_quote(bars(spark, sf_dir)))


def q_r2_chart_series(spark, sf_dir):
    from tickweave.operators.charts import chart_series
    return round_doubles(chart_series(enriched(spark, sf_dir)))



# --- portfolio ---------------------------------------------------------------------------

def q_p3_clean_holdings(spark, sf_dir):
    from tickweave.operators.portfolio import clean_holdings
    from tickweave.sources.fixtures import holdings
    return round_doubles(clean_holdings(holdings(spark, sf_dir)))


def _valued(spark, sf_dir):
    from tickweave.operators.portfolio import value_holdings
    from tickweave.sources.fixtures import holdings
    return value_holdings(holdings(spark, sf_dir), bars(spark, sf_dir), AS_OF)


MONEY = {"value": 2, "cost": 2, "pnl": 2, "total_cost": 2, "total_value": 2, "total_pnl": 2}


def q_j1_value_holdings(spark, sf_dir):
    return round_doubles(_valued(spark, sf_dir), overrides=MONEY)


def q_f6_holding_pnl(spark, sf_dir):
    """Cost, value, PNL and PNL % of every priced holding."""
    v = _valued(spark, sf_dir)
    return round_doubles(v.select("portfolio_id", "symbol", "cost", "value", "pnl", "pnl_pct"), overrides=MONEY)


def q_a1_portfolio_totals(spark, sf_dir):
    from tickweave.operators.portfolio import portfolio_totals
    return round_doubles(portfolio_totals(_valued(spark, sf_dir)), overrides=MONEY)


def q_p7_display_format(spark, sf_dir):
    """Portfolio metrics as the dashboard prints them: totals with thousands separators, the
    return without, and the per-holding table at two decimals."""
    from tickweave.functions.formatting import fixed, money
    from tickweave.operators.portfolio import portfolio_totals
    t = portfolio_totals(_valued(spark, sf_dir))
    return t.select("portfolio_id",
                    F.concat(F.lit("₹"), money(F.col("total_value"))).alias("total_value_text"),
                    F.concat(F.lit("₹"), money(F.col("total_pnl"))).alias("total_pnl_text"),
                    F.concat(F.lit("₹"), money(F.col("total_cost"))).alias("total_cost_text"),
                    F.concat(fixed(F.col("total_return_pct")), F.lit("%")).alias("total_return_text"))


def q_p7_volume_text(spark, sf_dir):
    """The stock tab's four metrics: latest close, 20-day volume, 52-week high and low."""
    from tickweave.functions.formatting import fixed, int_text
    t = S.trailing_stats(bars(spark, sf_dir))
    return t.select("symbol", F.concat(F.lit("₹"), fixed(F.col("last_close"))).alias("last_close_text"),
                    int_text(F.col("avg_volume_20")).alias("avg_volume_text"),
                    F.concat(F.lit("₹"), fixed(F.col("high_52w"))).alias("high_52w_text"),
                    F.concat(F.lit("₹"), fixed(F.col("low_52w"))).alias("low_52w_text"))


def q_p7_quote_text(spark, sf_dir):
    """Market-overview metric per symbol: price, "change (change %)", or "data unavailable"."""
    from tickweave.functions.formatting import fixed
    q = S.index_quote(bars(spark, sf_dir))
    ok = F.col("price").isNotNull() & F.col("change").isNotNull() & F.col("change_pct").isNotNull()
    return q.select(
        "symbol",
        F.when(ok, F.concat(F.lit("₹"), fixed(F.col("price")))).otherwise(F.lit("data unavailable")).alias("price_text"),
        F.when(ok, F.concat(fixed(F.col("change")), F.lit(" ("), fixed(F.col("change_pct")), F.lit("%)")))
        .alias("change_text"))


def q_p7_signal_text(spark, sf_dir):
    """Forecast tab texts: MAE to 4 decimals, MAPE, risk score out of 100, expected change."""
    from tickweave.functions.formatting import fixed
    s = _signal(spark, sf_dir)
    return s.select("symbol",
                    fixed(F.col("mae"), 4).alias("mae_text"),
                    F.concat(fixed(F.col("mape")), F.lit("%")).alias("mape_text"),
                    F.concat(fixed(F.col("risk_score")), F.lit(" / 100")).alias("risk_text"),
                    F.concat(fixed(F.col("change_pct")), F.lit("%")).alias("change_text"),
                    "action")


# --- scalar rules ----------------------------------------------------------------------------

def q_f2_round_to_strike(spark, sf_dir):
    """Strikes both ways for every tick price of ``events`` (0.01 .. 490: steps 0.5, 1, 5)."""
    from tickweave.functions.rules import round_to_strike
    from tickweave.sources.fixtures import quotes
    q = quotes(spark, sf_dir)
    return round_doubles(q.select("event_id", "price",
                                  round_to_strike(F.col("price"), "up").alias("strike_up"),
                                  round_to_strike(F.col("price"), "down").alias("strike_down"),
                                  round_to_strike(F.col("price")).alias("strike_nearest")))


def q_f2_strike_bars(spark, sf_dir):
    """Call and put strikes around every close (prices of 900 .. 105 000: step 100)."""
    from tickweave.functions.rules import round_to_strike
    b = bars(spark, sf_dir)
    return round_doubles(b.select("symbol", "date",
                                  round_to_strike(F.col("close") * F.lit(1.02), "up").alias("call_strike"),
                                  round_to_strike(F.col("close") * F.lit(0.98), "down").alias("put_strike")))


def q_f8_business_days(spark, sf_dir):
    from tickweave.functions.rules import business_days
    last = bars(spark, sf_dir).groupBy("symbol").agg(F.max("date").alias("last_date"))
    return last.select("symbol", "last_date", F.posexplode(business_days(F.col("last_date"))).alias("pos", "date")) \
        .select("symbol", "last_date", (F.col("pos") + 1).cast("long").alias("step"), "date")


# --- forecasting (on the smoothed bars, where every rule branch is reached) ------------------

LOOK_BACK = 30


def smooth(spark, sf_dir):
    return B.smooth_bars(bars(spark, sf_dir), 60, PRICE_SCALE)


PRICE4 = {"predicted": 4, "mae": 4, "price": 4, "last_forecast": 4, "actual": 4}


def q_s3_smooth_bars(spark, sf_dir):
    return round_doubles(smooth(spark, sf_dir).select("symbol", "date", "close"))


def q_a5_series_min_max(spark, sf_dir):
    return round_doubles(S.series_min_max(bars(spark, sf_dir)))


def q_f7_minmax_scale(spark, sf_dir):
    from tickweave.plans.forecast import scale, unscale, with_min_max
    m = with_min_max(bars(spark, sf_dir))
    sc = scale(F.col("close"), F.col("s_min"), F.col("s_max"))
    return round_doubles(m.select("symbol", "date", sc.alias("scaled"),
                                  unscale(sc, F.col("s_min"), F.col("s_max")).alias("restored")))


def _samples(spark, sf_dir, src=None):
    from tickweave.plans.forecast import samples
    return samples(src if src is not None else smooth(spark, sf_dir), LOOK_BACK)


def q_w8_lag_windows(spark, sf_dir):
    """Look-back samples, each feature vector summarised (size, first, last, sum)."""
    s = _samples(spark, sf_dir)
    return round_doubles(s.select(
        "symbol", "date", F.size("features").cast("long").alias("n_features"),
        F.element_at("features", 1).alias("first_feature"), F.element_at("features", -1).alias("last_feature"),
        F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("sum_features"),
        F.col("label")))


def q_w9_chronological_split(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return s.select("symbol", "date", F.col("sample_idx").cast("long").alias("sample_idx"), "is_train")


def q_a7_fit_ar1(spark, sf_dir):
    from tickweave.plans.forecast import fit_ar1, samples
    return round_doubles(fit_ar1(samples(smooth(spark, sf_dir), LOOK_BACK, with_features=False)))


def _pred_ar1(spark, sf_dir, src=None):
    from tickweave.plans.forecast import fit_ar1, predict_test_ar1, samples
    s = samples(src if src is not None else smooth(spark, sf_dir), LOOK_BACK, with_features=False)
    return predict_test_ar1(s, fit_ar1(s))


def q_m2_predict_test_ar1(spark, sf_dir):
    return round_doubles(_pred_ar1(spark, sf_dir), overrides=PRICE4)


def q_a4_forecast_metrics(spark, sf_dir):
    from tickweave.plans.forecast import metrics
    return round_doubles(metrics(_pred_ar1(spark, sf_dir)), overrides=PRICE4)


def q_a4_baseline_last_value(spark, sf_dir):
    """MAE/MAPE of the last-value forecaster on the same test samples, for comparison."""
    from tickweave.plans.forecast import metrics, predict_test_last_value, samples
    s = samples(smooth(spark, sf_dir), LOOK_BACK, with_features=False)
    return round_doubles(metrics(predict_test_last_value(s)), overrides=PRICE4)


def q_a4_forecast_metrics_raw(spark, sf_dir):
    from tickweave.plans.forecast import metrics
    return round_doubles(metrics(_pred_ar1(spark, sf_dir, bars(spark, sf_dir))), overrides=PRICE4)


def _fc_ar1(spark, sf_dir):
    from tickweave.plans.forecast import fit_ar1, last_state, recursive_forecast_ar1
    from tickweave.plans.forecast import samples
    b = smooth(spark, sf_dir)
    return recursive_forecast_ar1(last_state(b, LOOK_BACK), fit_ar1(samples(b, LOOK_BACK, with_features=False)))


def q_m3_forecast_ar1(spark, sf_dir):
    """The 30-step recursion per symbol: first and last forecast price and the path length."""
    fc = _fc_ar1(spark, sf_dir)
    return round_doubles(fc.select("symbol", "last_date", F.size("prices").cast("long").alias("n_steps"),
                                   F.element_at("prices", 1).alias("first_price"),
                                   F.element_at("prices", -1).alias("price")), overrides={**PRICE4, "first_price": 4})


def q_m4_forecast_table(spark, sf_dir):
    from tickweave.plans.forecast import forecast_table
    return round_doubles(forecast_table(_fc_ar1(spark, sf_dir)), overrides=PRICE4)


def _signal(spark, sf_dir, src=None, chunk_rows=None):
    from tickweave.plans.signal import ar1_signal
    return ar1_signal(src if src is not None else smooth(spark, sf_dir), LOOK_BACK, chunk_rows=chunk_rows)


SIGNAL_COLS = ["symbol", "last_date", "last_close", "last_forecast", "mape", "mae", "last_rsi", "change_pct",
               "rsi_used", "risk_score", "action", "strike"]


def q_j3_signal_inputs(spark, sf_dir):
    return round_doubles(_signal(spark, sf_dir).select("symbol", "mape", "mae", "last_close", "last_forecast",
                                                        "last_rsi"), overrides=PRICE4)


def q_f4_expected_change(spark, sf_dir):
    return round_doubles(_signal(spark, sf_dir).select("symbol", "change_pct"))


def q_f5_rsi_default(spark, sf_dir):
    return round_doubles(_signal(spark, sf_dir).select("symbol", "rsi_used"))


def q_f1_risk_score(spark, sf_dir):
    return round_doubles(_signal(spark, sf_dir).select("symbol", "risk_score"))


def q_f3_action(spark, sf_dir):
    return round_doubles(_signal(spark, sf_dir).select("symbol", "action", "strike"))


def q_e3_signal(spark, sf_dir):
    return round_doubles(_signal(spark, sf_dir).select(*SIGNAL_COLS), overrides=PRICE4)


def q_e3_signal_chunked(spark, sf_dir):
    """E3 with every series cut into 100-row halo chunks (the hot-symbol plan); equal to e3."""
    return round_doubles(_signal(spark, sf_dir, chunk_rows=100).select(*SIGNAL_COLS), overrides=PRICE4)


def q_e3_signal_raw(spark, sf_dir):
    return round_doubles(_signal(spark, sf_dir, bars(spark, sf_dir)).select(*SIGNAL_COLS), overrides=PRICE4)



# --- feeds, alerts, flows, favourites --------------------------------------------------------

PICK_K = 7  # the rotating news counter of the catalog query


def _unseen(spark, sf_dir):
    from tickweave.operators.feeds import unseen
    from tickweave.sources.fixtures import news, seen
    return unseen(news(spark, sf_dir), seen(spark, sf_dir))


def q_j2_unseen_news(spark, sf_dir):
    return _unseen(spark, sf_dir).select("url", "title", "feed_pos", F.col("source.name").alias("source_name"))


def q_l2_rotating_pick(spark, sf_dir):
    """The article each source's news card shows, with the card's texts."""
    from tickweave.operators.feeds import article_card, rotating_pick
    u = _unseen(spark, sf_dir).withColumn("source_name", F.col("source.name"))
    return article_card(rotating_pick(u, PICK_K, "source_name")).select(
        "source_name", "url", "feed_pos", "n_items", "pick_index", "title", "published_text", "description_text",
        "content_text", "link")


def q_j4_fired_alerts(spark, sf_dir):
    from tickweave.operators.feeds import fired_alerts
    from tickweave.sources.fixtures import alerts
    return round_doubles(fired_alerts(bars(spark, sf_dir), alerts(spark, sf_dir)))


def q_j4_fired_alerts_chunked(spark, sf_dir):
    """J4 with every series cut into 100-row pieces (the hot-symbol plan); equal to j4."""
    from tickweave.operators.feeds import fired_alerts
    from tickweave.sources.fixtures import alerts
    return round_doubles(fired_alerts(bars(spark, sf_dir), alerts(spark, sf_dir), chunk_rows=100))


def q_a6_net_flow(spark, sf_dir):
    from tickweave.operators.feeds import net_flow
    from tickweave.sources.fixtures import flows
    return round_doubles(net_flow(flows(spark, sf_dir)), digits=2)


def q_a6_net_flow_total(spark, sf_dir):
    """The institutional-activity table itself: one row per category over all dates."""
    from tickweave.operators.feeds import net_flow
    from tickweave.sources.fixtures import flows
    return round_doubles(net_flow(flows(spark, sf_dir), keys=("category",)), digits=2)


def q_p8_favorites_distinct(spark, sf_dir):
    from tickweave.operators.feeds import favorites_distinct
    from tickweave.sources.fixtures import favorites
    return favorites_distinct(favorites(spark, sf_dir)).select("user_id", "symbol", "n_adds", "position")


# --- statements and profiles -----------------------------------------------------------------

ITEMS = ["Total Revenue", "Net Income", "Operating Expense"]


def _wide(spark, sf_dir):
    from tickweave.operators.statements import statement_wide
    from tickweave.sources.fixtures import statements
    return statement_wide(statements(spark, sf_dir), ITEMS)


def q_r1_statement_wide(spark, sf_dir):
    return round_doubles(_wide(spark, sf_dir), digits=2)


def q_r1_statement_kinds(spark, sf_dir):
    """Income statement, balance sheet and cash flow of every company and quarter, side by side in one
    frame with the kind as a key."""
    from tickweave.operators.statements import statement_wide
    from tickweave.sources.fixtures import STATEMENT_ITEMS, statement_lines
    items = [i for kind in STATEMENT_ITEMS.values() for i in kind]
    return round_doubles(statement_wide(statement_lines(spark, sf_dir), items, keys=("symbol", "statement", "period")), digits=2)


def q_r1_statement_views(spark, sf_dir):
    """The three statement views as the company tab prints them: own columns only, "N/A" where absent."""
    from tickweave.operators.statements import fill_and_stringify, statement_views
    from tickweave.sources.fixtures import STATEMENT_ITEMS, statement_lines
    views = statement_views(statement_lines(spark, sf_dir), STATEMENT_ITEMS)
    long = None
    for kind, wide in views.items():
        shown = fill_and_stringify(round_doubles(wide, digits=2))
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.col(f"`{i}`").alias("shown")) for i in STATEMENT_ITEMS[kind]]))
        part = shown.select("symbol", F.lit(kind).alias("statement"), "period", cells.alias("c")).select("symbol", "statement", "period", "c.*")
        long = part if long is None else long.unionByName(part)
    return long


def q_p2_select_available(spark, sf_dir):
    from tickweave import constants as K
    from tickweave.operators.statements import select_available
    return round_doubles(select_available(_wide(spark, sf_dir), K.PNL_ITEMS), digits=2)


def q_p5_fill_and_stringify(spark, sf_dir):
    from tickweave.operators.statements import fill_and_stringify
    return fill_and_stringify(_wide(spark, sf_dir))


def q_p6_profile_field(spark, sf_dir):
    from tickweave.functions.formatting import map_field
    from tickweave.operators.statements import profile_fields
    from tickweave.sources.fixtures import profiles
    p = profiles(spark, sf_dir)
    return profile_fields(p.withColumn("k", map_field(F.col("info"), "k"))).drop("info")


# --- symbol universe -------------------------------------------------------------------------

def q_s4_symbol_universe(spark, sf_dir):
    from tickweave.sources.fixtures import symbols
    return symbols(spark, sf_dir)


def q_s4_by_exchange(spark, sf_dir):
    from tickweave.sources.fixtures import symbols
    from tickweave.sources.universe import by_exchange
    return by_exchange(symbols(spark, sf_dir), "NSE")



# --- streaming (availableNow runs; results read back from the sinks) -------------------------

def q_t2_stream_unseen_news(spark, sf_dir):
    from tickweave.sources.fixtures import news_from, seen
    from tickweave.streaming import streams as T
    pages = T.table_stream(spark, sf_dir, "pages").select("page_id", "url")
    live = T.stream_unseen_news(news_from(pages), seen(spark, sf_dir))
    _, out = T.run_to_files(live.select("url", "title", F.col("source.name").alias("source_name")), "t2")
    return spark.read.parquet(out)


def q_t2_stream_unseen_news_exact(spark, sf_dir):
    """T2 in its exact form: the feed as a stream, first repeat in feed order, seen forever."""
    from tickweave.session import shared_dir
    from tickweave.sources.fixtures import news_from, seen
    from tickweave.streaming import streams as T
    pages = T.table_stream(spark, sf_dir, "pages").select("page_id", "url")
    out = shared_dir(spark, "t2x-out")
    q = news_from(pages).writeStream.option("checkpointLocation", shared_dir(spark, "t2x-ckpt")) \
        .foreachBatch(T.unseen_batch_writer(seen(spark, sf_dir), out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("url", "title", "feed_pos", F.col("source.name").alias("source_name"))


def q_t3_stream_latest_quote(spark, sf_dir):
    from tickweave.sources.fixtures import quotes_from
    from tickweave.streaming import streams as T
    ev = T.table_stream(spark, sf_dir, "events")
    _, table = T.run_to_versions(T.stream_latest_quote(quotes_from(ev), seq="event_id").drop("last_ts"), "t3")
    return round_doubles(table.read())


def q_t4_stream_bars(spark, sf_dir):
    from tickweave.sources.fixtures import quotes_from
    from tickweave.streaming import streams as T
    ev = T.table_stream(spark, sf_dir, "events")
    _, out = T.run_to_files(T.stream_bars(quotes_from(ev), "1 hour", "2 hours", seq="event_id"), "t4")
    return round_doubles(spark.read.parquet(out).withColumn("bar_start", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss"))
                         .drop("bar_end"))


def q_t5_stream_indicators(spark, sf_dir):
    """Daily bars as a stream in random date order (dealt into 4 micro-batches by hash, so nearly every
    bar is late): the indicators kept by cell must equal the batch computation."""
    from tickweave.session import shared_dir
    from tickweave.streaming import streams as T
    from tickweave.streaming.live import LiveIndicators
    live = LiveIndicators(spark, shared_dir(spark, "t5"), price_scale=PRICE_SCALE, month_files=1)
    T.replay(bars(spark, sf_dir), F.pmod(F.xxhash64("symbol", "date"), F.lit(4)), 4, "t5", live.write)
    return round_doubles(live.current().select("symbol", "date", "close", "rsi", "ma20", "ma50", "ma200", "volatility"))


def q_t1_stream_net_flow(spark, sf_dir):
    """The flows view as a stream (lineitem rows arriving; orders and customers static)."""
    from tickweave.sources.fixtures import flows
    from tickweave.streaming import streams as T
    li = T.table_stream(spark, sf_dir, "lineitem")
    live = T.stream_net_flow(flows(spark, sf_dir, lineitem=li))
    _, table = T.run_to_versions(live, "t1-flows")
    return round_doubles(table.read(), digits=2)


def q_t6_stream_alerts(spark, sf_dir):
    from tickweave.session import shared_dir
    from tickweave.sources.bars import trades_from
    from tickweave.sources.fixtures import alerts
    from tickweave.streaming import streams as T
    li = T.table_stream(spark, sf_dir, "lineitem")
    out = shared_dir(spark, "t6-out")
    q = trades_from(li).writeStream.option("checkpointLocation", shared_dir(spark, "t6-ckpt")) \
        .foreachBatch(T.alert_batch_writer(alerts(spark, sf_dir), out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return round_doubles(T.fired_alerts_table(spark, out))


def q_t6_stream_alerts_live(spark, sf_dir):
    """Live J4: ticks in time order, four micro-batches, alerts crossed upwards and downwards."""
    from tickweave.session import shared_dir
    from tickweave.sources.fixtures import quotes, tick_alerts
    from tickweave.streaming import streams as T
    from tickweave.streaming.live import LiveAlerts
    ticks = quotes(spark, sf_dir).select("symbol", "ts", F.col("event_id").alias("seq"), "price")
    live = LiveAlerts(spark, tick_alerts(spark, sf_dir), shared_dir(spark, "t6-live"))
    T.replay(ticks, T.quantile_slice(ticks, F.unix_micros("ts"), 4), 4, "t6-live", live.write)
    fired = live.fired_so_far().withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).drop("batch_id")
    return round_doubles(fired)


def q_t2_stream_unseen_news_indexed(spark, sf_dir):
    """T2 in its exact form by the seen index: the feed in feed order, four micro-batches."""
    from tickweave.session import shared_dir
    from tickweave.sources.fixtures import news, seen
    from tickweave.streaming import streams as T
    from tickweave.streaming.seen import IndexedNews
    feed = news(spark, sf_dir)
    live = IndexedNews(spark, seen(spark, sf_dir), shared_dir(spark, "t2-indexed"))
    T.replay(feed, T.quantile_slice(feed, F.col("feed_pos"), 4), 4, "t2-indexed", live.write)
    return live.news().select("url", "title", "feed_pos", F.col("source.name").alias("source_name"))



# --- pooled look-back regression (no SQL twin: an iterative fit) -----------------------------

def _pooled(spark, sf_dir):
    from tickweave.plans import forecast as FC
    b = smooth(spark, sf_dir)
    smp = FC.samples(b, LOOK_BACK)
    model = FC.fit_pooled(smp)
    b0, coef = FC.pooled_coefficients(model)
    return b, smp, b0, coef


def q_m1_fit_pooled(spark, sf_dir):
    """Coefficients of the pooled model as rows ``(term, weight)``: term 0 is the intercept,
    term k the k-th oldest look-back value."""
    _, smp, b0, coef = _pooled(spark, sf_dir)
    rows = [(0, b0)] + [(i + 1, c) for i, c in enumerate(coef)]
    return spark.createDataFrame(rows, "term int, weight double")


def q_m2_predict_test_pooled(spark, sf_dir):
    from tickweave.plans import forecast as FC
    _, smp, b0, coef = _pooled(spark, sf_dir)
    return round_doubles(FC.predict_test_pooled(smp, b0, coef), overrides=PRICE4)


def q_m5_actual_vs_predicted(spark, sf_dir):
    """Test rows with their own dates, actual next to predicted, for both models."""
    from tickweave.plans import forecast as FC
    _, smp, b0, coef = _pooled(spark, sf_dir)
    pooled = FC.predict_test_pooled(smp, b0, coef).select("symbol", "date", "actual",
                                                          F.col("predicted").alias("predicted_pooled"))
    ar1 = FC.predict_test_ar1(smp, FC.fit_ar1(smp)).select("symbol", "date", F.col("predicted").alias("predicted_ar1"))
    return round_doubles(pooled.join(ar1, ["symbol", "date"]), digits=4)


def q_m3_forecast_pooled(spark, sf_dir):
    from tickweave.plans import forecast as FC
    b, _, b0, coef = _pooled(spark, sf_dir)
    fc = FC.recursive_forecast_pooled(FC.last_state(b, LOOK_BACK), b0, coef)
    return round_doubles(FC.forecast_table(fc), overrides=PRICE4)


def q_e3_signal_pooled(spark, sf_dir):
    from tickweave.plans.signal import pooled_signal
    return round_doubles(pooled_signal(smooth(spark, sf_dir), LOOK_BACK).select(*SIGNAL_COLS), overrides=PRICE4)


def q_m4_forecast_table_raw(spark, sf_dir):
    """AR(1) forecast rows on the raw bars."""
    from tickweave.plans.forecast import fit_ar1, forecast_table, last_state, recursive_forecast_ar1, samples
    b = bars(spark, sf_dir)
    fc = recursive_forecast_ar1(last_state(b, LOOK_BACK), fit_ar1(samples(b, LOOK_BACK, with_features=False)))
    return round_doubles(forecast_table(fc), overrides=PRICE4)


# --- one model per series: normal equations (twins solve them again in SQL) and networks -------------

def _series(spark, sf_dir):
    """(bars, samples, coefficients), bars and samples written once for the fit, predictions and last states."""
    from tickweave.plans import forecast as FC
    from tickweave.plans.series_model import fit_per_series
    b = _written(smooth(spark, sf_dir).select("symbol", "date", "close"), "series-bars")
    smp = _written(FC.samples(b, LOOK_BACK), "series-samples")
    return b, smp, fit_per_series(smp, LOOK_BACK)


def _written(df, name):
    from tickweave.session import shared_dir
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def q_m1_fit_per_series(spark, sf_dir):
    """Every symbol's coefficients as rows ``(symbol, term, weight)``: term 0 is the intercept, term k the
    k-th oldest look-back value."""
    _, _, fit = _series(spark, sf_dir)
    rows = fit.select("symbol", "n_train", F.posexplode("coef").alias("term", "weight"))
    return round_doubles(rows.withColumn("term", F.col("term").cast("long")), digits=4)


def q_m2_predict_test_per_series(spark, sf_dir):
    from tickweave.plans.series_model import predict_test_series
    _, smp, fit = _series(spark, sf_dir)
    return round_doubles(predict_test_series(smp, fit, LOOK_BACK), digits=2)


def q_m3_forecast_per_series(spark, sf_dir):
    from tickweave.plans import forecast as FC
    from tickweave.plans.series_model import recursive_forecast_series
    b, _, fit = _series(spark, sf_dir)
    return round_doubles(FC.forecast_table(recursive_forecast_series(FC.last_state(b, LOOK_BACK), fit, LOOK_BACK)), digits=2)


def q_a4_forecast_metrics_per_series(spark, sf_dir):
    from tickweave.plans import forecast as FC
    from tickweave.plans.series_model import predict_test_series
    _, smp, fit = _series(spark, sf_dir)
    return round_doubles(FC.metrics(predict_test_series(smp, fit, LOOK_BACK)), digits=2)


def _networks(spark, sf_dir):
    from tickweave.plans import forecast as FC
    from tickweave.plans.network import fit_series_networks
    b = _written(smooth(spark, sf_dir).select("symbol", "date", "close"), "network-bars")
    smp = _written(FC.samples(b, LOOK_BACK), "network-samples")
    return b, smp, _written(fit_series_networks(smp, LOOK_BACK), "network-models")


def q_m1_fit_networks(spark, sf_dir):
    """Every symbol's own network: training samples, epochs, and whether the last epoch's loss is below the
    first one's."""
    _, _, models = _networks(spark, sf_dir)
    losses = F.col("losses")
    return models.select("symbol", "n_train", F.size(losses).cast("long").alias("n_epochs"),
                         (F.element_at(losses, -1) < F.element_at(losses, 1)).alias("learned"))


def q_m3_forecast_networks(spark, sf_dir):
    """The forecast rows of every symbol's own network, and whether each has a price."""
    from tickweave.plans import forecast as FC
    from tickweave.plans.network import recursive_forecast_network
    b, _, models = _networks(spark, sf_dir)
    rows = FC.forecast_table(recursive_forecast_network(FC.last_state(b, LOOK_BACK), models, LOOK_BACK))
    return rows.select("symbol", "step", "date", (F.col("price").isNotNull() & ~F.isnan("price")).alias("priced"))


def q_m2_metrics_networks(spark, sf_dir):
    """Whether the test MAPE of every symbol's own network, and of the pooled one, is in the range that the
    trade rules call reliable."""
    from tickweave import constants as K
    from tickweave.plans import forecast as FC
    from tickweave.plans.network import fit_pooled_network, predict_test_network
    _, smp, models = _networks(spark, sf_dir)
    pooled, _ = fit_pooled_network(smp, LOOK_BACK)
    reliable = lambda name: (F.col("mape") < K.MAPE_RELIABLE_BELOW).alias(name)
    own = FC.metrics(predict_test_network(smp, models, LOOK_BACK)).select("symbol", "n_test", reliable("own_reliable"))
    one = FC.metrics(predict_test_network(smp, pooled, LOOK_BACK)).select("symbol", reliable("pooled_reliable"))
    return own.join(one, "symbol")


# --- sinks ------------------------------------------------------------------------------------

def q_s5_export_csv(spark, sf_dir):
    """The enriched frame written as CSV partitioned by symbol, read back with its schema."""
    from tickweave.session import shared_dir
    from tickweave.sources.sinks import export_csv
    df = enriched(spark, sf_dir).drop("gain", "loss")
    path = shared_dir(spark, "s5-csv")
    export_csv(df, path)
    schema = df.drop("symbol").schema.add("symbol", "string")
    back = spark.read.option("header", True).schema(schema).csv(path)
    return round_doubles(back)


def q_s6_settings_json(spark, sf_dir):
    """Per user: favourites in list order and the model configuration, as one JSON text."""
    from tickweave.operators.feeds import favorites_list
    from tickweave.sources.fixtures import favorites
    from tickweave.sources.sinks import settings_json
    return settings_json(favorites_list(favorites(spark, sf_dir)))


def q_s6_settings_json_full(spark, sf_dir):
    """Per user: favourites, alerts, portfolio, seen urls and the model configuration; users
    with any of them. A user is an event's user, an order's customer and an alert's supplier."""
    from tickweave.operators.feeds import favorites_list
    from tickweave.sources import fixtures as X
    from tickweave.sources.sinks import settings_json
    owned = X.alerts(spark, sf_dir).select(F.col("alert_id").alias("user_id"), "symbol", F.round("price", 2).alias("price"))
    held = X.holdings(spark, sf_dir).withColumnRenamed("portfolio_id", "user_id")
    return settings_json(favorites_list(X.favorites(spark, sf_dir)), owned, holdings=held, seen=X.seen_by_user(spark, sf_dir))


def flagship(spark, sf_dir):
    """Trade signal of every symbol (E3) on the smoothed bars."""
    return q_e3_signal(spark, sf_dir)


QUERIES = {
    "s3_build_bars": q_s3_build_bars,
    "s3_bars_any_key": q_s3_bars_any_key,
    "s3_intraday_any_key": q_s3_intraday_any_key,
    "s3_intraday_bars": q_s3_intraday_bars,
    "s1_load_bars": q_s1_load_bars,
    "s2_recent_bars": q_s2_recent_bars,
    "w1_diff": q_w1_diff,
    "w2_daily_return": q_w2_daily_return,
    "w3_gain_loss": q_w3_gain_loss,
    "w4_sma": q_w4_sma,
    "w5_rolling_mean": q_w5_rolling_mean,
    "w6_rsi": q_w6_rsi,
    "w7_volatility": q_w7_volatility,
    "e2_indicators": q_e2_indicators,
    "e2_indicators_chunked": q_e2_indicators_chunked,
    "e2_indicators_bucketed": q_e2_indicators_bucketed,
    "e2_intraday_indicators": q_e2_intraday_indicators,
    "a2_latest": q_a2_latest,
    "a3_trailing_stats": q_a3_trailing_stats,
    "l1_tail": q_l1_tail,
    "p1_select_columns": q_p1_select_columns,
    "p4_add_if_missing": q_p4_add_if_missing,
    "f9_index_quote": q_f9_index_quote,
    "r2_chart_series": q_r2_chart_series,
    "p3_clean_holdings": q_p3_clean_holdings,
    "j1_value_holdings": q_j1_value_holdings,
    "f6_holding_pnl": q_f6_holding_pnl,
    "a1_portfolio_totals": q_a1_portfolio_totals,
    "p7_display_format": q_p7_display_format,
    "p7_volume_text": q_p7_volume_text,
    "p7_quote_text": q_p7_quote_text,
    "p7_signal_text": q_p7_signal_text,
    "f2_round_to_strike": q_f2_round_to_strike,
    "f2_strike_bars": q_f2_strike_bars,
    "f8_business_days": q_f8_business_days,
    "s3_smooth_bars": q_s3_smooth_bars,
    "a5_series_min_max": q_a5_series_min_max,
    "f7_minmax_scale": q_f7_minmax_scale,
    "w8_lag_windows": q_w8_lag_windows,
    "w9_chronological_split": q_w9_chronological_split,
    "a7_fit_ar1": q_a7_fit_ar1,
    "m2_predict_test_ar1": q_m2_predict_test_ar1,
    "a4_forecast_metrics": q_a4_forecast_metrics,
    "a4_forecast_metrics_raw": q_a4_forecast_metrics_raw,
    "a4_baseline_last_value": q_a4_baseline_last_value,
    "m3_forecast_ar1": q_m3_forecast_ar1,
    "m4_forecast_table": q_m4_forecast_table,
    "j3_signal_inputs": q_j3_signal_inputs,
    "f4_expected_change": q_f4_expected_change,
    "f5_rsi_default": q_f5_rsi_default,
    "f1_risk_score": q_f1_risk_score,
    "f3_action": q_f3_action,
    "e3_signal": q_e3_signal,
    "e3_signal_raw": q_e3_signal_raw,
    "e3_signal_chunked": q_e3_signal_chunked,
    "j2_unseen_news": q_j2_unseen_news,
    "l2_rotating_pick": q_l2_rotating_pick,
    "j4_fired_alerts": q_j4_fired_alerts,
    "j4_fired_alerts_chunked": q_j4_fired_alerts_chunked,
    "a6_net_flow": q_a6_net_flow,
    "a6_net_flow_total": q_a6_net_flow_total,
    "p8_favorites_distinct": q_p8_favorites_distinct,
    "r1_statement_wide": q_r1_statement_wide,
    "r1_statement_kinds": q_r1_statement_kinds,
    "r1_statement_views": q_r1_statement_views,
    "p2_select_available": q_p2_select_available,
    "p5_fill_and_stringify": q_p5_fill_and_stringify,
    "p6_profile_field": q_p6_profile_field,
    "s4_symbol_universe": q_s4_symbol_universe,
    "s4_by_exchange": q_s4_by_exchange,
    "t1_stream_net_flow": q_t1_stream_net_flow,
    "t2_stream_unseen_news": q_t2_stream_unseen_news,
    "t2_stream_unseen_news_exact": q_t2_stream_unseen_news_exact,
    "t3_stream_latest_quote": q_t3_stream_latest_quote,
    "t4_stream_bars": q_t4_stream_bars,
    "t5_stream_indicators": q_t5_stream_indicators,
    "t6_stream_alerts": q_t6_stream_alerts,
    "t6_stream_alerts_live": q_t6_stream_alerts_live,
    "t2_stream_unseen_news_indexed": q_t2_stream_unseen_news_indexed,
    "m1_fit_pooled": q_m1_fit_pooled,
    "m2_predict_test_pooled": q_m2_predict_test_pooled,
    "m5_actual_vs_predicted": q_m5_actual_vs_predicted,
    "m3_forecast_pooled": q_m3_forecast_pooled,
    "e3_signal_pooled": q_e3_signal_pooled,
    "m4_forecast_table_raw": q_m4_forecast_table_raw,
    "m1_fit_per_series": q_m1_fit_per_series,
    "m2_predict_test_per_series": q_m2_predict_test_per_series,
    "m3_forecast_per_series": q_m3_forecast_per_series,
    "a4_forecast_metrics_per_series": q_a4_forecast_metrics_per_series,
    "m1_fit_networks": q_m1_fit_networks,
    "m2_metrics_networks": q_m2_metrics_networks,
    "m3_forecast_networks": q_m3_forecast_networks,
    "s5_export_csv": q_s5_export_csv,
    "s6_settings_json": q_s6_settings_json,
    "s6_settings_json_full": q_s6_settings_json_full,
}
