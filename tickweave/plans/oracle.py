"""DuckDB twins of the catalog queries (``oracle_sql``), written independently as plain SQL
over the driver's tables.  Column names equal the Spark ones; doubles are rounded like
:func:`tickweave.plans.common.round_doubles`."""

from __future__ import annotations

from tickweave.plans.catalog import AS_OF, LOAD_END, LOAD_START
from tickweave.plans.common import sql_round as R

BAR_KEY = "l_orderkey{d}, l_linenumber{d}, l_partkey{d}, l_extendedprice{d}, l_quantity{d}"

BARS = f"""bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         first(l_extendedprice ORDER BY {BAR_KEY.format(d='')}) AS open,
         max(l_extendedprice) AS high, min(l_extendedprice) AS low,
         first(l_extendedprice ORDER BY {BAR_KEY.format(d=' DESC')}) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _mean(col: str, n: int) -> str:
    return f"CASE WHEN count({col}) OVER {_frame(n)} = {n} THEN avg({col}) OVER {_frame(n)} END"


IND = f"""{BARS},
b1 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM bars),
b2 AS (SELECT *, close - prev_close AS change, close / nullif(prev_close, 0) - 1 AS daily_return FROM b1),
b3 AS (SELECT *,
         CASE WHEN change IS NULL THEN NULL WHEN change > 0 THEN change ELSE 0.0 END AS gain,
         CASE WHEN change IS NULL THEN NULL WHEN change < 0 THEN -change ELSE 0.0 END AS loss FROM b2),
ind AS (SELECT symbol, date, open, high, low, close, volume, change, daily_return, gain, loss,
         {_mean('gain', 14)} AS avg_gain, {_mean('loss', 14)} AS avg_loss,
         {_mean('close', 20)} AS ma20, {_mean('close', 50)} AS ma50, {_mean('close', 200)} AS ma200,
         CASE WHEN count(daily_return) OVER {_frame(20)} = 20
              THEN stddev_samp(daily_return) OVER {_frame(20)} END * sqrt(252) AS volatility
       FROM b3),
enr AS (SELECT symbol, date, open, high, low, close, volume, change, daily_return, gain, loss,
         100 - 100 / (1 + avg_gain / nullif(avg_loss, 0)) AS rsi, ma20, ma50, ma200, volatility,
         avg_gain, avg_loss
       FROM ind)"""

ENR_COLS = ["open", "high", "low", "close", "volume", "change", "daily_return", "gain", "loss",
            "rsi", "ma20", "ma50", "ma200", "volatility"]


def _sel(cols, src="enr", keys=("symbol", "date"), where: str = "") -> str:
    parts = list(keys) + [R(c, c) for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src}{(' WHERE ' + where) if where else ''}"


ORACLE: dict[str, str] = {}

ORACLE["s3_build_bars"] = f"WITH {BARS} " + _sel(["open", "high", "low", "close", "volume"], "bars")
ORACLE["s1_load_bars"] = f"WITH {BARS} " + _sel(
    ["open", "high", "low", "close", "volume"], "bars",
    where=f"date >= DATE '{LOAD_START}' AND date < DATE '{LOAD_END}'")
ORACLE["s2_recent_bars"] = f"WITH {BARS} " + _sel(
    ["open", "high", "low", "close", "volume"], "bars",
    where=f"date > DATE '{AS_OF}' - INTERVAL 1 MONTH AND date <= DATE '{AS_OF}'")
ORACLE["w1_diff"] = f"WITH {IND} " + _sel(["change"])
ORACLE["w2_daily_return"] = f"WITH {IND} " + _sel(["daily_return"])
ORACLE["w3_gain_loss"] = f"WITH {IND} " + _sel(["gain", "loss"])
ORACLE["w4_sma"] = f"WITH {IND} " + _sel(["ma20", "ma50", "ma200"])
ORACLE["w5_rolling_mean"] = f"WITH {IND} " + _sel(["avg_gain", "avg_loss"])
ORACLE["w6_rsi"] = f"WITH {IND} " + _sel(["rsi"])
ORACLE["w7_volatility"] = f"WITH {IND} " + _sel(["volatility"])
ORACLE["e2_indicators"] = f"WITH {IND} " + _sel(ENR_COLS)
ORACLE["e2_indicators_chunked"] = ORACLE["e2_indicators"]
ORACLE["e2_indicators_bucketed"] = ORACLE["e2_indicators"]
ORACLE["a2_latest"] = f"""WITH {IND}
SELECT symbol, max(date) AS last_date,
       {R('arg_max_null(close, date)', 'last_close')}, {R('arg_max_null(rsi, date)', 'last_rsi')}
FROM enr GROUP BY symbol"""
ORACLE["a3_trailing_stats"] = f"""WITH {BARS},
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars)
SELECT symbol, max(date) AS last_date,
       {R('arg_max_null(close, date)', 'last_close')},
       {R('avg(CASE WHEN rn <= 20 THEN volume END)', 'avg_volume_20')},
       {R('max(CASE WHEN rn <= 252 THEN high END)', 'high_52w')},
       {R('min(CASE WHEN rn <= 252 THEN low END)', 'low_52w')}
FROM r GROUP BY symbol"""
ORACLE["l1_tail"] = f"""WITH {IND},
t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM enr)
""" + _sel(ENR_COLS, "t", where="rn <= 50")
ORACLE["p1_select_columns"] = f"""WITH {IND},
t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM enr)
""" + _sel(["close", "rsi"], "t", where="rn <= 20")
ORACLE["p4_add_if_missing"] = f"""WITH {BARS}
SELECT symbol, date, CAST(NULL AS DOUBLE) AS ma20,
       {R(_mean('close', 50), 'ma50')}, {R(_mean('close', 200), 'ma200')} FROM bars"""
ORACLE["f9_index_quote"] = f"""WITH {BARS},
p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars),
l AS (SELECT symbol, max(date) AS quote_date, arg_max_null(close, date) AS price,
             arg_max_null(prev, date) AS prev_close FROM p GROUP BY symbol)
SELECT symbol, quote_date, {R('price', 'price')}, {R('price - prev_close', 'change')},
       {R('(price - prev_close) / nullif(prev_close, 0) * 100', 'change_pct')} FROM l"""
_CHART = ["open", "high", "low", "close", "volume", "ma20", "ma50", "ma200", "rsi", "volatility"]
ORACLE["r2_chart_series"] = f"""WITH {IND},
u AS (UNPIVOT (SELECT symbol, date, {', '.join(_CHART)} FROM enr)
      ON {', '.join(_CHART)} INTO NAME series VALUE value)
SELECT symbol, date, series, {R('value', 'value')} FROM u WHERE value IS NOT NULL"""


# --- portfolio -------------------------------------------------------------------------------

HOLD = f"""{BARS},
hold AS (SELECT o_custkey AS portfolio_id,
           CASE WHEN l_orderkey % 7 = 0 THEN 'x' || CAST(l_suppkey AS VARCHAR) ELSE CAST(l_suppkey AS VARCHAR) END AS symbol,
           l_quantity AS quantity, l_extendedprice AS buy_price
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
clean AS (SELECT portfolio_id, upper(symbol) AS symbol, quantity, buy_price FROM hold
          WHERE symbol IS NOT NULL AND length(symbol) > 0 AND quantity > 0 AND buy_price > 0),
px AS (SELECT symbol, arg_max_null(close, date) AS current_price FROM bars
       WHERE date > DATE '{AS_OF}' - INTERVAL 1 MONTH AND date <= DATE '{AS_OF}' GROUP BY symbol),
v1 AS (SELECT c.portfolio_id, c.symbol, c.quantity, c.buy_price, p.current_price,
              p.current_price * c.quantity AS value, c.buy_price * c.quantity AS cost
       FROM clean c JOIN px p ON c.symbol = p.symbol),
val AS (SELECT *, value - cost AS pnl,
               CASE WHEN cost <> 0 THEN (value - cost) / cost * 100 ELSE 0.0 END AS pnl_pct FROM v1),
tot AS (SELECT portfolio_id, count(*) AS n_holdings, sum(cost) AS total_cost, sum(value) AS total_value,
               sum(pnl) AS total_pnl FROM val GROUP BY portfolio_id),
tot2 AS (SELECT *, CASE WHEN total_cost <> 0 THEN total_pnl / total_cost * 100 ELSE 0.0 END AS total_return_pct
         FROM tot)"""

ORACLE["p3_clean_holdings"] = f"WITH {HOLD} SELECT portfolio_id, symbol, " + \
    ", ".join(R(c, c) for c in ["quantity", "buy_price"]) + " FROM clean"
ORACLE["j1_value_holdings"] = f"WITH {HOLD} SELECT portfolio_id, symbol, " + ", ".join(
    [R("quantity", "quantity"), R("buy_price", "buy_price"), R("current_price", "current_price"),
     R("value", "value", 2), R("cost", "cost", 2), R("pnl", "pnl", 2), R("pnl_pct", "pnl_pct")]) + " FROM val"
ORACLE["a1_portfolio_totals"] = f"WITH {HOLD} SELECT portfolio_id, n_holdings, " + ", ".join(
    [R("total_cost", "total_cost", 2), R("total_value", "total_value", 2), R("total_pnl", "total_pnl", 2),
     R("total_return_pct", "total_return_pct")]) + " FROM tot2"
ORACLE["p7_display_format"] = f"""WITH {HOLD}
SELECT portfolio_id, '₹' || format('{{:,.2f}}', total_value) AS total_value_text,
       '₹' || format('{{:,.2f}}', total_pnl) AS total_pnl_text,
       '₹' || format('{{:,.2f}}', total_cost) AS total_cost_text,
       format('{{:.2f}}', total_return_pct) || '%' AS total_return_text FROM tot2"""
ORACLE["p7_volume_text"] = f"""WITH {BARS},
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars),
t AS (SELECT symbol, avg(CASE WHEN rn <= 20 THEN volume END) AS v, max(CASE WHEN rn <= 252 THEN high END) AS hi,
             min(CASE WHEN rn <= 252 THEN low END) AS lo, arg_max_null(close, date) AS c FROM r GROUP BY symbol)
SELECT symbol, '₹' || format('{{:.2f}}', c) AS last_close_text, format('{{:,}}', CAST(trunc(v) AS BIGINT)) AS avg_volume_text,
       '₹' || format('{{:.2f}}', hi) AS high_52w_text, '₹' || format('{{:.2f}}', lo) AS low_52w_text FROM t"""


# --- scalar rules ------------------------------------------------------------------------------

def _step(p: str) -> str:
    return (f"(CASE WHEN ({p}) < 10 THEN 0.5::DOUBLE WHEN ({p}) < 100 THEN 1.0::DOUBLE "
            f"WHEN ({p}) < 500 THEN 5.0::DOUBLE ELSE 100.0::DOUBLE END)")


def strike_sql(p: str, direction: str = "neutral") -> str:
    inc = _step(p)
    nearest = f"(round_even(({p}) / {inc}, 0) * {inc})"
    if direction == "up":
        nearest = f"(CASE WHEN ({p}) % {inc} > {inc} / 2 THEN {nearest} + {inc} ELSE {nearest} END)"
    elif direction == "down":
        nearest = f"(CASE WHEN ({p}) % {inc} < {inc} / 2 THEN {nearest} - {inc} ELSE {nearest} END)"
    return f"round({nearest}, 2)"


def strike_text_sql(p: str, direction: str) -> str:
    k = strike_sql(p, direction)
    return f"(CASE WHEN {_step(p)} < 1 THEN CAST({k} AS VARCHAR) ELSE CAST(CAST({k} AS BIGINT) AS VARCHAR) END)"


ORACLE["f2_round_to_strike"] = f"""SELECT event_id, {R('value', 'price')},
  {R(strike_sql('value', 'up'), 'strike_up')}, {R(strike_sql('value', 'down'), 'strike_down')},
  {R(strike_sql('value'), 'strike_nearest')} FROM events"""
ORACLE["f2_strike_bars"] = f"""WITH {BARS} SELECT symbol, date,
  {R(strike_sql('close * 1.02', 'up'), 'call_strike')}, {R(strike_sql('close * 0.98', 'down'), 'put_strike')}
FROM bars"""
ORACLE["f8_business_days"] = f"""WITH {BARS},
l AS (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol),
d AS (SELECT symbol, last_date, CAST(last_date + CAST(unnest(range(1, 45)) AS INTEGER) AS DATE) AS date FROM l),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS step FROM d WHERE isodow(date) <= 5)
SELECT symbol, last_date, step, date FROM b WHERE step <= 30"""


# --- forecasting ---------------------------------------------------------------------------------

SMOOTH = f"""{BARS},
sm0 AS (SELECT symbol, date, open, high, low, volume,
          CAST(sum(CAST(round(close * 100) AS BIGINT)) OVER {_frame(60)} AS DOUBLE) / 6000.0 AS close,
          count(close) OVER {_frame(60)} AS c60 FROM bars),
smooth AS (SELECT symbol, date, open, high, low, close, volume FROM sm0 WHERE c60 = 60)"""


def ind_ctes(src: str, p: str) -> str:
    """Indicator chain over table ``src``; the result is ``{p}enr``."""
    return f"""{p}b1 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM {src}),
{p}b2 AS (SELECT *, close - prev_close AS change FROM {p}b1),
{p}b3 AS (SELECT *, CASE WHEN change IS NULL THEN NULL WHEN change > 0 THEN change ELSE 0.0 END AS gain,
                CASE WHEN change IS NULL THEN NULL WHEN change < 0 THEN -change ELSE 0.0 END AS loss FROM {p}b2),
{p}ind AS (SELECT symbol, date, close, {_mean('gain', 14)} AS avg_gain, {_mean('loss', 14)} AS avg_loss FROM {p}b3),
{p}enr AS (SELECT symbol, date, close, 100 - 100 / (1 + avg_gain / nullif(avg_loss, 0)) AS rsi FROM {p}ind)"""


def fc_ctes(src: str, L: int = 30) -> str:
    return f"""mm AS (SELECT *, min(close) OVER (PARTITION BY symbol) AS s_min, max(close) OVER (PARTITION BY symbol) AS s_max
       FROM {src}),
sc AS (SELECT *, CASE WHEN s_max > s_min THEN (close - s_min) / (s_max - s_min)
                      WHEN close IS NOT NULL THEN 0.0 END AS scaled FROM mm),
lw AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx,
              lag(scaled, 1) OVER (PARTITION BY symbol ORDER BY date) AS prev,
              lag(scaled, {L}) OVER (PARTITION BY symbol ORDER BY date) AS first_feature,
              sum(scaled) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING) AS sum_features
       FROM sc),
s0 AS (SELECT symbol, date, close, s_min, s_max, scaled AS label, prev, first_feature, sum_features
       FROM lw WHERE idx >= {L}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS sample_idx,
              count(*) OVER (PARTITION BY symbol) AS n_samples FROM s0),
smp AS (SELECT *, sample_idx < floor(n_samples * 0.8::DOUBLE) AS is_train FROM s1),
coef AS (SELECT symbol, regr_intercept(label, prev) AS ar_a, regr_slope(label, prev) AS ar_b
         FROM smp WHERE is_train GROUP BY symbol),
pred AS (SELECT s.symbol, s.date, s.sample_idx, s.close AS actual,
                (c.ar_a + c.ar_b * s.prev) * (s.s_max - s.s_min) + s.s_min AS predicted
         FROM smp s JOIN coef c ON s.symbol = c.symbol WHERE NOT s.is_train),
met AS (SELECT symbol, count(*) AS n_test, avg(abs(actual - predicted)) AS mae,
               avg(abs((actual - predicted) / nullif(actual, 0))) * 100 AS mape FROM pred GROUP BY symbol),
st AS (SELECT symbol, max(date) AS last_date, arg_max_null(close, date) AS last_close,
              arg_max_null(scaled, date) AS h0, max(s_min) AS s_min, max(s_max) AS s_max FROM sc GROUP BY symbol),
fc AS (SELECT st.symbol, 0 AS step, st.h0 AS h FROM st JOIN coef ON st.symbol = coef.symbol
       UNION ALL
       SELECT fc.symbol, fc.step + 1, coef.ar_a + coef.ar_b * fc.h FROM fc JOIN coef ON fc.symbol = coef.symbol
       WHERE fc.step < 30),
bd0 AS (SELECT symbol, CAST(last_date + CAST(unnest(range(1, 45)) AS INTEGER) AS DATE) AS date FROM st),
bd AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS step FROM bd0 WHERE isodow(date) <= 5),
fct AS (SELECT fc.symbol, CAST(fc.step AS BIGINT) AS step, bd.date, fc.h * (st.s_max - st.s_min) + st.s_min AS price
        FROM fc JOIN st ON fc.symbol = st.symbol JOIN bd ON bd.symbol = fc.symbol AND bd.step = fc.step
        WHERE fc.step >= 1)"""


def signal_ctes(src: str) -> str:
    chg = "(f.price / nullif(st.last_close, 0) - 1) * 100"
    return f"""{fc_ctes(src)},
{ind_ctes(src, 'r_')},
lrsi AS (SELECT symbol, arg_max_null(rsi, date) AS last_rsi FROM r_enr GROUP BY symbol),
sg0 AS (SELECT m.symbol, st.last_date, st.last_close, f.price AS last_forecast, m.mape, m.mae, r.last_rsi,
               {chg} AS change_pct, coalesce(r.last_rsi, 50.0) AS rsi_used
        FROM met m JOIN st ON m.symbol = st.symbol JOIN (SELECT * FROM fct WHERE step = 30) f ON f.symbol = m.symbol
        LEFT JOIN lrsi r ON r.symbol = m.symbol),
sg AS (SELECT *,
         CASE WHEN mape IS NULL OR rsi_used IS NULL OR change_pct IS NULL THEN NULL
              ELSE greatest(0.0, least(100.0, 100 - mape * 2 - abs(rsi_used - 50) / 50 * 20 - abs(change_pct) / 10))
         END AS risk_score,
         CASE WHEN mape IS NOT NULL AND change_pct IS NOT NULL AND mape < 5 THEN
                CASE WHEN change_pct > 2 THEN 'Buy Calls ~₹' || {strike_text_sql('last_close * 1.02', 'up')}
                     WHEN change_pct >= -2 AND change_pct <= 2 THEN 'Hold / Avoid Options'
                     ELSE 'Buy Puts ~₹' || {strike_text_sql('last_close * 0.98', 'down')} END
              ELSE 'Unreliable - Avoid Trades' END AS action,
         CASE WHEN mape IS NOT NULL AND change_pct IS NOT NULL AND mape < 5 THEN
                CASE WHEN change_pct > 2 THEN {strike_sql('last_close * 1.02', 'up')}
                     WHEN change_pct >= -2 AND change_pct <= 2 THEN NULL
                     ELSE {strike_sql('last_close * 0.98', 'down')} END
         END AS strike
       FROM sg0)"""


P4 = {"predicted": 4, "mae": 4, "price": 4, "last_forecast": 4, "actual": 4}


def _r(c: str, alias: str | None = None) -> str:
    alias = alias or c
    return R(c, alias, P4.get(alias, 6))


ORACLE["s3_smooth_bars"] = f"WITH {SMOOTH} SELECT symbol, date, {_r('close')} FROM smooth"
ORACLE["a5_series_min_max"] = f"""WITH {BARS} SELECT symbol, {_r('min(close)', 's_min')}, {_r('max(close)', 's_max')}
FROM bars GROUP BY symbol"""
ORACLE["f7_minmax_scale"] = f"""WITH {BARS},
mm AS (SELECT *, min(close) OVER (PARTITION BY symbol) AS s_min, max(close) OVER (PARTITION BY symbol) AS s_max FROM bars),
sc AS (SELECT *, CASE WHEN s_max > s_min THEN (close - s_min) / (s_max - s_min) WHEN close IS NOT NULL THEN 0.0 END AS scaled
       FROM mm)
SELECT symbol, date, {_r('scaled')}, {_r('scaled * (s_max - s_min) + s_min', 'restored')} FROM sc"""
_FC = f"WITH RECURSIVE {SMOOTH},\n{fc_ctes('smooth')}\n"
ORACLE["w8_lag_windows"] = _FC + f"""SELECT symbol, date, CAST(30 AS BIGINT) AS n_features, {_r('first_feature')},
  {_r('prev', 'last_feature')}, {_r('sum_features')}, {_r('label')} FROM smp"""
ORACLE["w9_chronological_split"] = _FC + "SELECT symbol, date, sample_idx, is_train FROM smp"
ORACLE["a7_fit_ar1"] = _FC + f"SELECT symbol, {_r('ar_a')}, {_r('ar_b')} FROM coef"
ORACLE["m2_predict_test_ar1"] = _FC + f"SELECT symbol, date, sample_idx, {_r('actual')}, {_r('predicted')} FROM pred"
ORACLE["a4_forecast_metrics"] = _FC + f"SELECT symbol, n_test, {_r('mae')}, {_r('mape')} FROM met"
ORACLE["a4_forecast_metrics_raw"] = f"WITH RECURSIVE {BARS},\n{fc_ctes('bars')}\n" + \
    f"SELECT symbol, n_test, {_r('mae')}, {_r('mape')} FROM met"
ORACLE["m4_forecast_table"] = _FC + f"SELECT symbol, step, date, {_r('price')} FROM fct"
_SG = f"WITH RECURSIVE {SMOOTH},\n{signal_ctes('smooth')}\n"
ORACLE["j3_signal_inputs"] = _SG + "SELECT symbol, " + ", ".join(
    _r(c) for c in ["mape", "mae", "last_close", "last_forecast", "last_rsi"]) + " FROM sg"
ORACLE["f4_expected_change"] = _SG + f"SELECT symbol, {_r('change_pct')} FROM sg"
ORACLE["f5_rsi_default"] = _SG + f"SELECT symbol, {_r('rsi_used')} FROM sg"
ORACLE["f1_risk_score"] = _SG + f"SELECT symbol, {_r('risk_score')} FROM sg"
ORACLE["f3_action"] = _SG + f"SELECT symbol, action, {_r('strike')} FROM sg"
_SIG_COLS = ["last_close", "last_forecast", "mape", "mae", "last_rsi", "change_pct", "rsi_used", "risk_score", "strike"]
ORACLE["e3_signal"] = _SG + "SELECT symbol, last_date, action, " + ", ".join(_r(c) for c in _SIG_COLS) + " FROM sg"
ORACLE["e3_signal_raw"] = f"WITH RECURSIVE {BARS},\n{signal_ctes('bars')}\n" + \
    "SELECT symbol, last_date, action, " + ", ".join(_r(c) for c in _SIG_COLS) + " FROM sg"


# --- feeds, alerts, flows, favourites --------------------------------------------------------

NEWS = """feed AS (SELECT page_id, url, 0 AS copy FROM pages
             UNION ALL SELECT page_id, url, 1 AS copy FROM pages WHERE page_id % 5 = 0),
news AS (SELECT url, 'Page ' || CAST(page_id AS VARCHAR) AS title, page_id * 2 + copy AS feed_pos,
                regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS source_name FROM feed),
seen AS (SELECT url FROM pages WHERE page_id % 3 = 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY feed_pos) AS rn FROM news)
           WHERE rn = 1),
unseen AS (SELECT url, title, feed_pos, source_name FROM firsts f
           WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.url IS NOT DISTINCT FROM f.url))"""

ORACLE["j2_unseen_news"] = f"WITH {NEWS} SELECT url, title, feed_pos, source_name FROM unseen"
ORACLE["l2_rotating_pick"] = f"""WITH {NEWS},
r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY feed_pos) - 1 AS idx,
             count(*) OVER (PARTITION BY source_name) AS n_items FROM unseen)
SELECT source_name, url, feed_pos, n_items, 7 % n_items AS pick_index, title,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + CAST(feed_pos // 2 AS INTEGER) * INTERVAL 1 MINUTE,
                '%Y-%m-%d %H:%M:%S') AS published_text,
       'No description.' AS description_text, 'Full content not available.' AS content_text, url AS link
FROM r WHERE idx = 7 % n_items"""
ORACLE["j4_fired_alerts"] = f"""WITH {BARS},
b AS (SELECT symbol, date, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM bars),
a AS (SELECT s_suppkey AS alert_id, CAST(s_suppkey AS VARCHAR) AS symbol, 50000.0 + s_acctbal AS alert_price
      FROM supplier),
j AS (SELECT b.symbol, b.date, b.close, b.prev_close, a.alert_id, a.alert_price,
             CASE WHEN b.prev_close < a.alert_price AND a.alert_price <= b.close THEN 'up'
                  WHEN b.prev_close > a.alert_price AND a.alert_price >= b.close THEN 'down' END AS direction
      FROM b JOIN a ON a.symbol = b.symbol)
SELECT symbol, date, {R('close', 'close')}, {R('prev_close', 'prev_close')}, alert_id,
       {R('alert_price', 'alert_price')}, direction FROM j WHERE direction IS NOT NULL"""
FLOWS = """fl AS (SELECT CAST(l_shipdate AS DATE) AS date, c_mktsegment AS category,
                CASE WHEN l_linestatus = 'O' THEN 'buy' WHEN l_linestatus = 'F' THEN 'sell' END AS side,
                l_extendedprice AS amount
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _flow(keys: str) -> str:
    return f"""WITH {FLOWS},
g AS (SELECT {keys}, sum(CASE WHEN side = 'buy' THEN amount ELSE 0.0 END) AS buy_value,
             sum(CASE WHEN side = 'sell' THEN amount ELSE 0.0 END) AS sell_value FROM fl GROUP BY {keys})
SELECT {keys}, {R('buy_value', 'buy_value', 2)}, {R('sell_value', 'sell_value', 2)},
       {R('buy_value - sell_value', 'net_value', 2)} FROM g"""


ORACLE["a6_net_flow"] = _flow("date, category")
ORACLE["a6_net_flow_total"] = _flow("category")
ORACLE["p8_favorites_distinct"] = """WITH f AS (SELECT user_id, event_type AS symbol, ts AS added_at, event_id FROM events),
g AS (SELECT user_id, symbol, count(*) AS n_adds, min(added_at) AS a0,
             arg_min(event_id, (added_at, event_id)) AS e0 FROM f GROUP BY user_id, symbol)
SELECT user_id, symbol, n_adds, row_number() OVER (PARTITION BY user_id ORDER BY a0, e0) AS position FROM g"""


# --- statements and profiles -----------------------------------------------------------------

STMT = """st0 AS (SELECT CAST(c_nationkey AS VARCHAR) AS symbol,
                 CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period,
                 CASE o_orderstatus WHEN 'F' THEN 'Total Revenue' WHEN 'O' THEN 'Net Income'
                                    WHEN 'P' THEN 'Operating Expense' END AS item,
                 o_totalprice AS value
          FROM orders JOIN customer ON o_custkey = c_custkey),
wide AS (SELECT symbol, period,
                sum(CASE WHEN item = 'Total Revenue' THEN value END) AS "Total Revenue",
                sum(CASE WHEN item = 'Net Income' THEN value END) AS "Net Income",
                sum(CASE WHEN item = 'Operating Expense' THEN value END) AS "Operating Expense"
         FROM st0 GROUP BY symbol, period)"""


def _txt(c: str) -> str:
    return f"""coalesce(CAST(CAST("{c}" AS DECIMAL(38,2)) AS VARCHAR), 'N/A') AS "{c}\""""


ORACLE["r1_statement_wide"] = f"""WITH {STMT} SELECT symbol, period, {R('"Total Revenue"', '"Total Revenue"', 2)},
  {R('"Net Income"', '"Net Income"', 2)}, {R('"Operating Expense"', '"Operating Expense"', 2)} FROM wide"""
ORACLE["p2_select_available"] = f"""WITH {STMT} SELECT symbol, period, {R('"Total Revenue"', '"Total Revenue"', 2)},
  {R('"Net Income"', '"Net Income"', 2)} FROM wide"""
ORACLE["p5_fill_and_stringify"] = f"""WITH {STMT} SELECT symbol, period, {_txt('Total Revenue')},
  {_txt('Net Income')}, {_txt('Operating Expense')} FROM wide"""
ORACLE["p6_profile_field"] = """SELECT event_id, event_type AS symbol,
  coalesce(json_extract_string(props, '$.k'), 'N/A') AS k,
  coalesce(json_extract_string(props, '$.longName'), 'N/A') AS longName,
  coalesce(json_extract_string(props, '$.sector'), 'N/A') AS sector,
  coalesce(json_extract_string(props, '$.industry'), 'N/A') AS industry,
  coalesce(json_extract_string(props, '$.website'), 'N/A') AS website,
  coalesce(json_extract_string(props, '$.longBusinessSummary'), 'N/A') AS longBusinessSummary
FROM events"""


# --- symbol universe -------------------------------------------------------------------------

UNIV = """SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exchange, 'stock' AS kind FROM supplier"""
ORACLE["s4_symbol_universe"] = UNIV
ORACLE["s4_by_exchange"] = f"SELECT * FROM ({UNIV}) WHERE exchange = 'NSE' AND kind = 'stock'"


# --- streaming twins ---------------------------------------------------------------------------

ORACLE["t2_stream_unseen_news"] = f"WITH {NEWS} SELECT url, title, source_name FROM unseen"
ORACLE["t3_stream_latest_quote"] = f"""SELECT event_type AS symbol, {R('arg_max(value, ts)', 'price')},
  count(*) AS n_ticks FROM events GROUP BY event_type"""
ORACLE["t4_stream_bars"] = f"""WITH t AS (SELECT event_type AS symbol, ts, event_id, value AS price,
      time_bucket(INTERVAL 1 HOUR, ts) AS bar_start FROM events),
g AS (SELECT symbol, bar_start, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
             first(price ORDER BY ts DESC, event_id DESC) AS close, count(*) AS ticks FROM t GROUP BY symbol, bar_start)
SELECT symbol, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar_start, {R('open', 'open')}, {R('high', 'high')},
       {R('low', 'low')}, {R('close', 'close')}, ticks FROM g
WHERE bar_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"""
ORACLE["t5_stream_indicators"] = f"WITH {IND} " + _sel(["close", "rsi", "ma20", "ma50", "ma200", "volatility"])
ORACLE["t6_stream_alerts"] = f"""WITH a AS (SELECT s_suppkey AS alert_id, CAST(s_suppkey AS VARCHAR) AS symbol,
      50000.0 + s_acctbal AS alert_price FROM supplier),
hi AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, max(l_extendedprice) AS top FROM lineitem GROUP BY 1)
SELECT a.alert_id, a.symbol, {R('a.alert_price', 'alert_price')} FROM a JOIN hi ON a.symbol = hi.symbol
WHERE hi.top >= a.alert_price"""


# --- raw-bar forecast and sinks ------------------------------------------------------------------

ORACLE["m4_forecast_table_raw"] = f"WITH RECURSIVE {BARS},\n{fc_ctes('bars')}\n" + \
    f"SELECT symbol, step, date, {_r('price')} FROM fct"
ORACLE["s5_export_csv"] = f"WITH {IND} " + _sel([c for c in ENR_COLS if c not in ("gain", "loss")])
ORACLE["s6_settings_json"] = """WITH f AS (SELECT user_id, event_type AS symbol, ts AS added_at, event_id FROM events),
g AS (SELECT user_id, symbol, min(added_at) AS a0, arg_min(event_id, (added_at, event_id)) AS e0
      FROM f GROUP BY user_id, symbol)
SELECT user_id, CAST(to_json({'favorites': list(symbol ORDER BY a0, e0),
                              'model_config': {'epochs': 20, 'batch_size': 32}}) AS VARCHAR) AS settings_json
FROM g GROUP BY user_id"""
ORACLE["s6_settings_json_full"] = """WITH f AS (SELECT user_id, event_type AS symbol, ts AS added_at, event_id FROM events),
g AS (SELECT user_id, symbol, min(added_at) AS a0, arg_min(event_id, (added_at, event_id)) AS e0
      FROM f GROUP BY user_id, symbol),
fav AS (SELECT user_id, list(symbol ORDER BY a0, e0) AS favorites FROM g GROUP BY user_id),
al AS (SELECT s_suppkey AS user_id, list({'stock': CAST(s_suppkey AS VARCHAR), 'price': round(50000.0 + s_acctbal, 2)}) AS alerts
       FROM supplier GROUP BY s_suppkey),
h AS (SELECT o_custkey AS user_id, l_quantity AS quantity, l_extendedprice AS buy_price,
             CASE WHEN l_orderkey % 7 = 0 THEN 'X' ELSE '' END || CAST(l_suppkey AS VARCHAR) AS ticker
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
po AS (SELECT user_id, list({'ticker': ticker, 'quantity': quantity, 'buy_price': buy_price} ORDER BY ticker, quantity, buy_price) AS portfolio
       FROM h GROUP BY user_id),
se AS (SELECT page_id % 500 AS user_id, list(DISTINCT url ORDER BY url) AS seen FROM pages WHERE page_id % 3 = 0 AND url IS NOT NULL GROUP BY 1),
users AS (SELECT user_id FROM fav UNION SELECT user_id FROM al UNION SELECT user_id FROM po
          UNION SELECT page_id % 500 FROM pages WHERE page_id % 3 = 0)
SELECT u.user_id, CAST(to_json({'favorites': coalesce(favorites, []), 'alerts': coalesce(alerts, []),
                                'portfolio': coalesce(portfolio, []), 'seen_articles': coalesce(seen, []),
                                'model_config': {'epochs': 20, 'batch_size': 32}}) AS VARCHAR) AS settings_json
FROM users u LEFT JOIN fav ON u.user_id IS NOT DISTINCT FROM fav.user_id LEFT JOIN al ON u.user_id IS NOT DISTINCT FROM al.user_id
LEFT JOIN po ON u.user_id IS NOT DISTINCT FROM po.user_id LEFT JOIN se ON u.user_id IS NOT DISTINCT FROM se.user_id"""


ORACLE["f6_holding_pnl"] = f"WITH {HOLD} SELECT portfolio_id, symbol, " + ", ".join(
    [R("cost", "cost", 2), R("value", "value", 2), R("pnl", "pnl", 2), R("pnl_pct", "pnl_pct")]) + " FROM val"
ORACLE["m3_forecast_ar1"] = _FC + f"""SELECT st.symbol, st.last_date, count(*) AS n_steps,
  {R('arg_min(fct.price, fct.step)', 'first_price', 4)}, {R('arg_max(fct.price, fct.step)', 'price', 4)}
FROM fct JOIN st ON fct.symbol = st.symbol GROUP BY st.symbol, st.last_date"""
ORACLE["e3_signal_chunked"] = ORACLE["e3_signal"]
ORACLE["a4_baseline_last_value"] = _FC + f"""SELECT symbol, count(*) AS n_test,
  {_r('avg(abs(close - (prev * (s_max - s_min) + s_min)))', 'mae')},
  {_r('avg(abs((close - (prev * (s_max - s_min) + s_min)) / nullif(close, 0))) * 100', 'mape')}
FROM smp WHERE NOT is_train GROUP BY symbol"""
ORACLE["p7_quote_text"] = f"""WITH {BARS},
p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM bars),
l AS (SELECT symbol, arg_max_null(close, date) AS price, arg_max_null(prev, date) AS prev_close FROM p GROUP BY symbol),
q AS (SELECT symbol, price, price - prev_close AS change, (price - prev_close) / nullif(prev_close, 0) * 100 AS pct FROM l)
SELECT symbol,
  CASE WHEN price IS NOT NULL AND change IS NOT NULL AND pct IS NOT NULL THEN '₹' || format('{{:.2f}}', price)
       ELSE 'data unavailable' END AS price_text,
  CASE WHEN price IS NOT NULL AND change IS NOT NULL AND pct IS NOT NULL
       THEN format('{{:.2f}}', change) || ' (' || format('{{:.2f}}', pct) || '%)' END AS change_text
FROM q"""
ORACLE["p7_signal_text"] = _SG + """SELECT symbol, format('{:.4f}', mae) AS mae_text, format('{:.2f}', mape) || '%' AS mape_text,
  format('{:.2f}', risk_score) || ' / 100' AS risk_text, format('{:.2f}', change_pct) || '%' AS change_text, action
FROM sg"""
ORACLE["t1_stream_net_flow"] = _flow("category")
ORACLE["s3_intraday_bars"] = f"""WITH t AS (SELECT event_type AS symbol, ts, event_id, value AS price,
      time_bucket(INTERVAL 1 HOUR, ts) AS bar_start FROM events),
g AS (SELECT symbol, bar_start, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
             first(price ORDER BY ts DESC, event_id DESC) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM t GROUP BY symbol, bar_start)
SELECT symbol, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar_start, {R('open', 'open')}, {R('high', 'high')},
       {R('low', 'low')}, {R('close', 'close')}, {R('volume', 'volume')} FROM g"""

# tie-break columns instead of a packed key: the same bars
ORACLE["s3_bars_any_key"] = ORACLE["s3_build_bars"]
ORACLE["s3_intraday_any_key"] = ORACLE["s3_intraday_bars"]



def _frame_by(n: int, order: str) -> str:
    return f"(PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _mean_by(col: str, n: int, order: str) -> str:
    return f"CASE WHEN count({col}) OVER {_frame_by(n, order)} = {n} THEN avg({col}) OVER {_frame_by(n, order)} END"


ORACLE["e2_intraday_indicators"] = f"""WITH t AS (SELECT event_type AS symbol, ts, event_id, value AS price,
      time_bucket(INTERVAL 1 HOUR, ts) AS bar_start FROM events),
hb AS (SELECT symbol, bar_start, first(price ORDER BY ts DESC, event_id DESC) AS close FROM t GROUP BY symbol, bar_start),
i1 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_start) AS prev_close FROM hb),
i2 AS (SELECT *, close - prev_close AS change, close / nullif(prev_close, 0) - 1 AS ret FROM i1),
i3 AS (SELECT *, CASE WHEN change IS NULL THEN NULL WHEN change > 0 THEN change ELSE 0.0 END AS gain,
              CASE WHEN change IS NULL THEN NULL WHEN change < 0 THEN -change ELSE 0.0 END AS loss FROM i2),
i4 AS (SELECT symbol, bar_start, close, {_mean_by('gain', 14, 'bar_start')} AS ag, {_mean_by('loss', 14, 'bar_start')} AS al,
              {_mean_by('close', 20, 'bar_start')} AS ma20, {_mean_by('close', 50, 'bar_start')} AS ma50,
              CASE WHEN count(ret) OVER {_frame_by(20, 'bar_start')} = 20
                   THEN stddev_samp(ret) OVER {_frame_by(20, 'bar_start')} END * sqrt(252) AS volatility FROM i3)
SELECT symbol, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar_start, {R('close', 'close')},
       {R('100 - 100 / (1 + ag / nullif(al, 0))', 'rsi')}, {R('ma20', 'ma20')}, {R('ma50', 'ma50')},
       {R('volatility', 'volatility')} FROM i4"""
ORACLE["t2_stream_unseen_news_exact"] = ORACLE["j2_unseen_news"]
ORACLE["j4_fired_alerts_chunked"] = ORACLE["j4_fired_alerts"]


# --- live state ------------------------------------------------------------------------------------

ORACLE["t2_stream_unseen_news_indexed"] = ORACLE["j2_unseen_news"]
ORACLE["t6_stream_alerts_live"] = f"""WITH k AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS kinds FROM events),
a AS (SELECT s_suppkey AS alert_id, kinds[CAST(s_suppkey % len(kinds) AS INTEGER) + 1] AS symbol, round(s_acctbal / 10, 2) AS alert_price
      FROM supplier, k),
t AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
             lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev_price FROM events),
x AS (SELECT a.alert_id, a.symbol, a.alert_price, CASE WHEN prev_price < price THEN 'up' ELSE 'down' END AS direction, ts, seq, prev_price, price,
             row_number() OVER (PARTITION BY a.alert_id ORDER BY ts, seq) AS rn
      FROM a JOIN t ON a.symbol = t.symbol
      WHERE (prev_price < alert_price AND alert_price <= price) OR (prev_price > alert_price AND alert_price >= price))
SELECT alert_id, symbol, {R('alert_price', 'alert_price')}, direction, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, seq,
       {R('prev_price', 'prev_price')}, {R('price', 'price')} FROM x WHERE rn = 1"""


# --- one regression per series: the normal equations once more, by Gauss-Jordan elimination ---------

def series_ctes(L: int = 30, ridge: float = 1e-3) -> str:
    """After :func:`fc_ctes`: ``smf`` (samples with their look-back lists) and ``own`` (symbol, n, w: the
    coefficients, intercept first)."""
    d = L + 1
    return f"""fl AS (SELECT symbol, date, list(scaled) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING) AS f FROM sc),
smf AS (SELECT smp.*, f FROM smp JOIN fl ON smp.symbol = fl.symbol AND smp.date = fl.date),
zs AS (SELECT symbol, list_concat([1.0::DOUBLE], f, [label]) AS z FROM smf WHERE is_train),
cells AS (SELECT symbol, i, j, sum(z[i] * z[j]) AS v FROM zs, range(1, {d + 1}) a(i), range(1, {d + 2}) b(j) GROUP BY symbol, i, j),
ns AS (SELECT symbol, count(*) AS n FROM zs GROUP BY symbol),
mrows AS (SELECT c.symbol, n, i, list(v + CASE WHEN i = j AND i > 1 THEN {ridge} * n ELSE 0 END ORDER BY j) AS r
          FROM cells c JOIN ns ON c.symbol = ns.symbol GROUP BY c.symbol, n, i),
gj AS (SELECT symbol, n, 0 AS k, list(r ORDER BY i) AS m FROM mrows GROUP BY symbol, n
       UNION ALL
       SELECT symbol, n, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / m[k + 1][k + 1])
                ELSE list_transform(r, lambda x, j: x - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END)
       FROM gj WHERE k < {d}),
own AS (SELECT symbol, n, list_transform(m, lambda r: r[{d + 1}]) AS w FROM gj WHERE k = {d}),
opred AS (SELECT s.symbol, s.date, s.sample_idx, s.close AS actual,
                 (w[1] + list_sum(list_transform(f, lambda x, i: x * w[i + 1]))) * (s_max - s_min) + s_min AS predicted
          FROM smf s JOIN own ON s.symbol = own.symbol WHERE NOT is_train),
hist AS (SELECT symbol, list(scaled ORDER BY date) AS h FROM
           (SELECT symbol, date, scaled, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM sc) WHERE rn <= {L} GROUP BY symbol),
ofc AS (SELECT hist.symbol, 0 AS step, h, w FROM hist JOIN own ON hist.symbol = own.symbol WHERE len(h) = {L}
        UNION ALL
        SELECT symbol, step + 1, list_append(h[2:], w[1] + list_sum(list_transform(h, lambda x, i: x * w[i + 1]))), w FROM ofc WHERE step < 30),
ofct AS (SELECT ofc.symbol, CAST(ofc.step AS BIGINT) AS step, bd.date, h[{L}] * (st.s_max - st.s_min) + st.s_min AS price
         FROM ofc JOIN st ON ofc.symbol = st.symbol JOIN bd ON bd.symbol = ofc.symbol AND bd.step = ofc.step WHERE ofc.step >= 1)"""


_OWN = _FC.rstrip() + ",\n" + series_ctes() + "\n"
ORACLE["m1_fit_per_series"] = _OWN + f"""SELECT symbol, n AS n_train, CAST(t - 1 AS BIGINT) AS term, {R('w[t]', 'weight', 4)}
FROM own, range(1, 32) r(t)"""
ORACLE["m2_predict_test_per_series"] = _OWN + f"SELECT symbol, date, sample_idx, {R('actual', 'actual', 2)}, {R('predicted', 'predicted', 2)} FROM opred"
ORACLE["m3_forecast_per_series"] = _OWN + f"SELECT symbol, step, date, {R('price', 'price', 2)} FROM ofct"
ORACLE["a4_forecast_metrics_per_series"] = _OWN + f"""SELECT symbol, count(*) AS n_test, {R('avg(abs(actual - predicted))', 'mae', 2)},
  {R('avg(abs((actual - predicted) / nullif(actual, 0))) * 100', 'mape', 2)} FROM opred GROUP BY symbol"""


# --- statement kinds ---------------------------------------------------------------------------------

KINDS = """li AS (SELECT CAST(s_nationkey AS VARCHAR) AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, lineitem.*
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
lines AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS symbol, 'income' AS statement, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period,
         CASE o_orderstatus WHEN 'F' THEN 'Total Revenue' WHEN 'O' THEN 'Net Income' WHEN 'P' THEN 'Operating Expense' END AS item, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT symbol, 'balance', period, CASE l_returnflag WHEN 'A' THEN 'Total Assets' WHEN 'N' THEN 'Total Debt' WHEN 'R' THEN 'Cash And Cash Equivalents' END,
         l_extendedprice FROM li
  UNION ALL
  SELECT symbol, 'cashflow', period, CASE l_linestatus WHEN 'O' THEN 'Operating Cash Flow' WHEN 'F' THEN 'Capital Expenditure' END,
         l_extendedprice * (1 - l_discount) * CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END FROM li),
wide AS (SELECT symbol, statement, period"""
_KIND_ITEMS = {"income": ["Total Revenue", "Net Income", "Operating Expense"],
               "balance": ["Total Assets", "Total Debt", "Cash And Cash Equivalents"], "cashflow": ["Operating Cash Flow", "Capital Expenditure"]}
for _items in _KIND_ITEMS.values():
    for _i in _items:
        KINDS += f", sum(value) FILTER (item = '{_i}') AS \"{_i}\""
KINDS += " FROM lines GROUP BY symbol, statement, period)"
ORACLE["r1_statement_kinds"] = f"WITH {KINDS} SELECT symbol, statement, period, " + ", ".join(
    R(f'"{_i}"', f'"{_i}"', 2) for _items in _KIND_ITEMS.values() for _i in _items) + " FROM wide"
_SHOWN = ", ".join(f"{{'k': '{_k}', 'item': '{_i}', 'v': \"{_i}\"}}" for _k, _items in _KIND_ITEMS.items() for _i in _items)
ORACLE["r1_statement_views"] = f"""WITH {KINDS},
c AS (SELECT symbol, statement, period, unnest([{_SHOWN}]) AS x FROM wide)
SELECT symbol, statement, period, x.item AS item,
       coalesce(CAST(CAST(round(x.v, 2) AS DECIMAL(38, 2)) AS VARCHAR), 'N/A') AS shown FROM c WHERE x.k = statement"""


# --- networks: their rows, and what a fit has to reach -------------------------------------------------

ORACLE["m1_fit_networks"] = _FC + "SELECT symbol, count(*) AS n_train, CAST(20 AS BIGINT) AS n_epochs, TRUE AS learned FROM smp WHERE is_train GROUP BY symbol"
ORACLE["m2_metrics_networks"] = _FC + """SELECT symbol, count(*) AS n_test, TRUE AS own_reliable, TRUE AS pooled_reliable FROM smp
WHERE NOT is_train GROUP BY symbol"""
ORACLE["m3_forecast_networks"] = _FC + "SELECT symbol, step, date, TRUE AS priced FROM fct"
