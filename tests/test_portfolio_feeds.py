"""Portfolio valuation (P3, J1, F6, A1) and feeds (J2, L2, J4, A6, P8) on hand-made inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickweave.operators.feeds import favorites_distinct, fired_alerts, net_flow, rotating_pick, unseen
from tickweave.operators.portfolio import clean_holdings, portfolio_totals, value_holdings

D = dt.date(2024, 3, 1)


def _bars(spark, rows):
    return spark.createDataFrame([(s, d, c, c, c, c, 1.0) for s, d, c in rows],
                                 "symbol string, date date, open double, high double, low double, close double, volume double")


def test_holdings_cleaning_and_valuation(spark):
    bars = _bars(spark, [("AAA", D, 10.0), ("AAA", D + dt.timedelta(days=1), 12.0), ("BBB", D, 5.0),
                         ("OLD", D - dt.timedelta(days=90), 7.0)])
    h = spark.createDataFrame([
        (1, "aaa", 10.0, 11.0),   # lower-case ticker: upper-cased, priced at 12
        (1, "AAA", 5.0, 10.0),    # second holding of one ticker stays a row
        (1, "", 5.0, 10.0),       # empty ticker: dropped
        (1, "BBB", 0.0, 10.0),    # quantity 0: dropped
        (1, "BBB", 3.0, 0.0),     # price 0: dropped
        (2, "ZZZ", 1.0, 1.0),     # no bars: dropped by the inner join
        (2, "OLD", 1.0, 1.0),     # bars only older than a month: dropped
        (3, "BBB", 2.0, 5.0),     # cost == value
    ], "portfolio_id long, symbol string, quantity double, buy_price double")
    assert clean_holdings(h).count() == 5
    v = value_holdings(h, bars, D + dt.timedelta(days=1)).orderBy("portfolio_id", "quantity").collect()
    assert [(r.portfolio_id, r.symbol, r.current_price) for r in v] == [(1, "AAA", 12.0), (1, "AAA", 12.0), (3, "BBB", 5.0)]
    first = v[1]
    assert (first.cost, first.value, first.pnl) == (110.0, 120.0, 10.0)
    assert first.pnl_pct == pytest.approx(10 / 110 * 100)
    t = {r.portfolio_id: r for r in portfolio_totals(value_holdings(h, bars, D + dt.timedelta(days=1))).collect()}
    assert set(t) == {1, 3}
    assert t[1].total_pnl == pytest.approx(t[1].total_value - t[1].total_cost)
    assert t[1].total_return_pct == pytest.approx((180.0 - 160.0) / 160.0 * 100)  # sum(pnl)/sum(cost)
    assert t[3].total_return_pct == 0.0


def _news(spark, rows):
    return spark.createDataFrame(rows, "url string, feed_pos long, title string")


def test_unseen_news(spark):
    news = _news(spark, [("u1", 1, "first"), ("u2", 2, "a"), ("u1", 3, "repeat"), (None, 4, "n1"),
                         (None, 5, "n2"), ("u3", 6, "seen")])
    seen = spark.createDataFrame([("u3",)], "url string")
    got = sorted(((r.url or ""), r.title) for r in unseen(news, seen).collect())
    assert got == [("", "n1"), ("u1", "first"), ("u2", "a")]
    # a NULL in the seen set hides NULL urls (null-safe equality)
    seen2 = spark.createDataFrame([("u3",), (None,)], "url string")
    assert sorted(r.url for r in unseen(news, seen2).collect()) == ["u1", "u2"]


@pytest.mark.parametrize("k", [0, 1, 4, 7, 100])
@pytest.mark.parametrize("width", [1, 3, 1 << 16, None])
def test_rotating_pick_equals_brute_force(spark, k, width):
    rows = [("a", i * 3 + 1, f"a{i}") for i in range(7)] + [("b", i * 5, f"b{i}") for i in range(3)] + [("c", 2, "c0")]
    df = spark.createDataFrame(rows, "src string, feed_pos long, title string")
    got = {r.src: r.title for r in rotating_pick(df, k, "src", bucket_width=width).collect()}
    want = {}
    for s in ("a", "b", "c"):
        items = sorted((p, t) for g, p, t in rows if g == s)
        want[s] = items[k % len(items)][1]
    assert got == want


def test_fired_alerts(spark):
    bars = _bars(spark, [("A", D + dt.timedelta(days=i), c) for i, c in enumerate([9.0, 10.0, 11.0, 10.0, 9.5])])
    alerts = spark.createDataFrame([(1, "A", 10.0), (2, "A", 10.5), (3, "B", 1.0)], "alert_id long, symbol string, price double")
    got = sorted((r.alert_id, r.date.day, r.direction) for r in fired_alerts(bars, alerts).collect())
    # 9 -> 10 reaches 10 (up); 10 -> 11 crosses 10.5 (up); 11 -> 10 crosses 10.5 and reaches 10 (down)
    assert got == [(1, 2, "up"), (1, 4, "down"), (2, 3, "up"), (2, 4, "down")]


def test_net_flow_is_buy_minus_sell(spark):
    fl = spark.createDataFrame([(D, "X", "buy", 5.0), (D, "X", "sell", 2.0), (D, "Y", "sell", 1.0)],
                               "date date, category string, side string, amount double")
    got = {r.category: (r.buy_value, r.sell_value, r.net_value) for r in net_flow(fl).collect()}
    assert got == {"X": (5.0, 2.0, 3.0), "Y": (0.0, 1.0, -1.0)}


def test_favorites_keep_first_added_order(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    fav = spark.createDataFrame([(1, "B", t(1), 1), (1, "A", t(2), 2), (1, "B", t(3), 3), (2, "A", t(0), 4)],
                                "user_id long, symbol string, added_at timestamp, event_id long")
    got = sorted((r.user_id, r.position, r.symbol, r.n_adds) for r in favorites_distinct(fav).collect())
    assert got == [(1, 1, "B", 2), (1, 2, "A", 1), (2, 1, "A", 1)]


def test_rotating_pick_with_sparse_positions(spark):
    """Timestamp-like positions: the adaptive width keeps every group at a few buckets."""
    rows = [("s", 1_700_000_000_000_000 + i * 7_919_993, f"t{i}") for i in range(500)] + [("u", 5, "only")]
    df = spark.createDataFrame(rows, "src string, feed_pos long, title string")
    got = {r.src: r.title for r in rotating_pick(df, 1234, "src", buckets_per_group=16).collect()}
    assert got == {"s": f"t{1234 % 500}", "u": "only"}
