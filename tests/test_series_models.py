"""Per-series regression and networks (M1) against numpy; statement kinds and recent indicators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tickweave.plans import forecast as FC
from tickweave.plans import network as N
from tickweave.plans import series_model as SM

SAMPLES = "symbol string, date date, sample_idx long, features array<double>, label double, is_train boolean, close double, s_min double, s_max double"


def samples(spark, L=10, sizes=(("A", 60), ("B", 45), ("C", 200)), seed=1):
    rng = np.random.default_rng(seed)
    rows, arrays = [], {}
    for symbol, n in sizes:
        x = rng.uniform(0, 1, (n, L))
        y = x @ rng.normal(0, 0.4, L) + 0.3 + rng.normal(0, 0.05, n)
        arrays[symbol] = x, y
        rows += [(symbol, None, k, x[k].tolist(), float(y[k]), k < n * 0.8, float(y[k]) * 10 + 5, 5.0, 15.0) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], SAMPLES), arrays


def ridge_fit(x, y, ridge):
    a = np.column_stack([np.ones(len(x)), x])
    m = a.T @ a + np.diag([0.0] + [ridge * len(x)] * x.shape[1])
    return np.linalg.solve(m, a.T @ y)


@pytest.mark.parametrize("ridge", [0.0, 1e-3])
def test_coefficients_equal_numpy(spark, ridge):
    df, arrays = samples(spark)
    got = {r.symbol: r for r in SM.fit_per_series(df, 10, ridge=ridge).collect()}
    for symbol, (x, y) in arrays.items():
        n = int(len(y) * 0.8)
        want = ridge_fit(x[:n], y[:n], ridge)
        assert got[symbol].n_train == n and np.abs(np.array(got[symbol].coef) - want).max() < 1e-8
        residual = y[:n] - np.column_stack([np.ones(n), x[:n]]) @ got[symbol].coef
        assert abs(residual.sum()) < 1e-8  # the intercept carries no ridge


def test_predictions_and_recursion_equal_numpy(spark):
    df, arrays = samples(spark)
    coef = SM.fit_per_series(df, 10)
    w = {r.symbol: np.array(r.coef) for r in coef.collect()}
    for r in SM.predict_test_series(df, coef, 10).collect():
        want = w[r.symbol][0] + arrays[r.symbol][0][r.sample_idx] @ w[r.symbol][1:]
        assert r.predicted == pytest.approx(want * 10 + 5, abs=1e-9)
    state = spark.createDataFrame([("A", [0.1 * k for k in range(10)], 10, 5.0, 15.0, 7.0), ("B", [0.5] * 9, 9, 5.0, 15.0, 7.0)],
                                  "symbol string, history array<double>, n_hist int, s_min double, s_max double, last_close double") \
        .withColumn("last_date", F.to_date(F.lit("2024-01-05")))
    got = SM.recursive_forecast_series(state, coef, 10, steps=4).collect()
    h = [0.1 * k for k in range(10)]
    for _ in range(4):
        h.append(w["A"][0] + np.array(h[-10:]) @ w["A"][1:])
    assert [r.symbol for r in got] == ["A"] and got[0].prices == pytest.approx([10 * v + 5 for v in h[-4:]])


def test_series_without_a_unique_solution(spark):
    flat = [("F", None, k, [0.0] * 10, 0.0, True, 5.0, 5.0, 5.0) for k in range(30)]
    few = [("G", None, k, [random.Random(k).random()] * 10, 0.5, True, 5.0, 0.0, 9.0) for k in range(4)]
    gap = [("H", None, 0, [0.1] * 9, 0.2, True, 5.0, 0.0, 9.0), ("H", None, 1, [0.1] * 10, None, True, None, 0.0, 9.0)]
    df = spark.createDataFrame(flat + few + gap, SAMPLES)
    plain = {r.symbol: r.coef for r in SM.fit_per_series(df, 10, ridge=0.0).collect()}
    assert plain == {"F": None, "G": None}
    held = {r.symbol: r.coef for r in SM.fit_per_series(df, 10).collect()}
    assert held["F"] == pytest.approx([0.0] * 11) and all(np.isfinite(held["G"]))
    assert SM.fit_per_series(df.filter("false"), 10).count() == 0


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(7, 10)), rng.normal(size=7)
    p = N.start_parameters(10, 4, 1) + rng.normal(0, 0.1, 1 + 4 * 12)
    _, g = N.loss_and_gradient(p, x, y)
    for k in range(len(p)):
        e = np.zeros_like(p)
        e[k] = 1e-6
        assert (N.loss_and_gradient(p + e, x, y)[0] - N.loss_and_gradient(p - e, x, y)[0]) / 2e-6 == pytest.approx(g[k], abs=1e-6)


def forward(p, x):
    offset, out, inner_offset, inner = N.split_parameters(np.array(p), x.shape[-1])
    return np.tanh(x @ inner.T + inner_offset) @ out + offset


def test_networks_learn_and_epochs_and_batch_size_matter(spark):
    df, arrays = samples(spark)
    fit = lambda **k: {r.symbol: r for r in N.fit_series_networks(df, 10, hidden=4, **k).collect()}
    base = fit(epochs=20, batch_size=8)
    assert set(base) == set(arrays)
    for symbol, r in base.items():
        assert len(r.losses) == 20 and r.losses[-1] < r.losses[0] / 3 and r.n_train == int(len(arrays[symbol][1]) * 0.8)
    assert fit(epochs=20, batch_size=8)["A"].parameters == base["A"].parameters  # the same again
    assert fit(epochs=5, batch_size=8)["A"].losses == base["A"].losses[:5]
    assert fit(epochs=20, batch_size=64)["A"].parameters != base["A"].parameters
    models = N.fit_series_networks(df, 10, epochs=20, batch_size=8, hidden=4)
    for r in N.predict_test_network(df, models, 10, hidden=4).collect():
        assert r.predicted == pytest.approx(10 * forward(base[r.symbol].parameters, arrays[r.symbol][0][r.sample_idx]) + 5)
    for bad in ({"epochs": 4}, {"batch_size": 10}, {"epochs": 101}):
        with pytest.raises(ValueError):
            N.fit_series_networks(df, 10, **bad)


def test_pooled_network_averages_shards(spark):
    df, arrays = samples(spark)
    p, losses = N.fit_pooled_network(df, 10, epochs=6, batch_size=8, hidden=4, shard_rows=100)
    again, _ = N.fit_pooled_network(df.repartition(7), 10, epochs=6, batch_size=8, hidden=4, shard_rows=100)
    assert p == pytest.approx(again, abs=1e-12) and losses[-1] < losses[0]
    one, _ = N.fit_pooled_network(df, 10, epochs=6, batch_size=8, hidden=4)
    assert one != p and len(p) == 1 + 4 * 12
    # one shard is plain mini-batch descent
    x = np.concatenate([arrays[s][0][:int(len(arrays[s][1]) * 0.8)] for s in "ABC"])
    y = np.concatenate([arrays[s][1][:int(len(arrays[s][1]) * 0.8)] for s in "ABC"])
    q, step = N.start_parameters(10, 4, 7), 0
    mean, square = np.zeros_like(q), np.zeros_like(q)
    for epoch in range(6):
        q, mean, square, step, _ = N.run_epoch(q, mean, square, step, x, y, 8, N.RATE, [7, epoch, 0])
    assert one == pytest.approx(q.tolist())
    assert N.fit_pooled_network(df.filter("false"), 10, epochs=5)[1] == []


def test_samples_are_dealt_once_as_runs(spark):
    """Runs hold every sample once, at little more than a value each, and an epoch exchanges no sample; gaps, equal
    keys, nulls and a null symbol part runs and lose nothing."""
    import datetime as dt
    rng, day = random.Random(8), dt.date(2024, 1, 1)
    bars = [(s, day + dt.timedelta(days=k), rng.random()) for s in "AB" for k in range(200)]
    df = FC.samples(spark.createDataFrame(bars, "symbol string, date date, close double"), 10)
    odd = [(None, k, [rng.random() for _ in range(10)], 0.5) for k in (0, 1, 1, 5)] + [("Z", 0, [None] + [0.25] * 9, 0.25), ("Z", 1, [0.25] * 10, 0.75)]
    train = N._train(df, 10).unionByName(spark.createDataFrame(odd, "symbol string, k long, features array<double>, label double"))
    runs = N.sample_runs(train, 10, 50)
    got, want = [], [(r.symbol, r.features, r.label) for r in train.collect()]
    for r in runs.collect():
        assert len(r["values"]) == 10 + r.n and r.n <= 50
        got += [(r.symbol, r["values"][i:i + 10], r["values"][i + 10]) for i in range(r.n)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert runs.filter("symbol <> 'Z'").count() == 8  # 304 samples, at most 50 a run
    name = N._dealt(runs, 7)
    epoch = spark.table(name).groupBy("shard").applyInArrow(lambda t: t, spark.table(name).schema)
    assert epoch.count() == runs.count() and "Exchange" not in epoch._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {name}")


def test_recent_indicators_equal_the_tail_of_all(spark):
    from tickweave.functions.indicators import add_indicators
    from tickweave.operators.series import recent_indicators, tail
    from tickweave.sources.bars import daily_bars
    bars = daily_bars(spark, SF_SMALL)
    got, want = recent_indicators(bars, 5, price_scale=2), tail(add_indicators(bars, price_scale=2), 5)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_last_state_passes_only_the_last_bars_to_the_window(spark):
    import datetime as dt
    day = dt.date(2024, 1, 1)
    rows = [(s, day + dt.timedelta(days=k), float((k * 37) % 101)) for s in ("A", None) for k in range(60)] + [("B", day, 4.0), ("B", day + dt.timedelta(days=1), None)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    state = FC.last_state(df, 10)
    assert "WindowGroupLimit" in state._jdf.queryExecution().executedPlan().toString()
    got = {r.symbol: r for r in state.collect()}
    closes = [float((k * 37) % 101) for k in range(60)]
    lo, hi = min(closes), max(closes)
    for symbol in ("A", None):
        r = got[symbol]
        assert r.n_hist == 10 and r.last_date == day + dt.timedelta(days=59) and (r.s_min, r.s_max, r.last_close) == (lo, hi, closes[-1])
        assert r.history == pytest.approx([(c - lo) / (hi - lo) for c in closes[-10:]])
    assert got["B"].n_hist == 2 and got["B"].last_close is None and got["B"].history == [0.0, None]


def test_statement_views(spark):
    from tickweave.operators.statements import statement_views
    long = spark.createDataFrame([("A", "income", 1, "x", 1.0), ("A", "balance", 1, "y", 2.0), ("A", "balance", 2, "z", 3.0), ("A", None, 1, "x", 9.0),
                                  ("A", "other", 1, "x", 9.0)], "symbol string, statement string, period int, item string, value double")
    views = statement_views(long, {"income": ["x"], "balance": ["y", "z"], "cashflow": ["w"]})
    assert [tuple(r) for r in views["income"].collect()] == [("A", 1, 1.0)]
    assert sorted(tuple(r) for r in views["balance"].collect()) == [("A", 1, 2.0, None), ("A", 2, None, 3.0)]
    assert views["cashflow"].columns == ["symbol", "period", "w"] and views["cashflow"].count() == 0
