"""Every catalog query against its DuckDB twin (the driver's gate, run locally on sf0.001),
with doubles compared bit for bit after the catalog's rounding."""

import re

import pytest

import __spark_entry__ as E
import oracle_harness as H
from conftest import SF_SMALL

# the training-data queries have their own tests, beside their own folder
OWN = re.compile(r"op\d+_|pipeline$")
ORACLE = {k: v for k, v in E.oracle_sql().items() if not OWN.match(k)}
QUERIES = {k: v for k, v in E.queries().items() if not OWN.match(k)}


@pytest.fixture(scope="module")
def con():
    return H.duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, name):
    H.EXACT = True
    r = H.compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert r["ok"], r.get("why")
    assert "type_diff" not in r, r["type_diff"]
    assert r["rows"][0] > 0, "the fixture should reach this operator"


def test_every_query_has_a_callable_and_names_are_distinct():
    assert set(ORACLE) <= set(QUERIES)
    rows_only = set(QUERIES) - set(ORACLE)
    # only the pooled (iteratively fitted) model has no SQL twin
    assert rows_only == {"m1_fit_pooled", "m2_predict_test_pooled", "m5_actual_vs_predicted",
                         "m3_forecast_pooled", "e3_signal_pooled"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 10
    assert df.columns == ["symbol", "last_date", "last_close", "last_forecast", "mape", "mae", "last_rsi",
                          "change_pct", "rsi_used", "risk_score", "action", "strike"]
