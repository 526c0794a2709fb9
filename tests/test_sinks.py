"""Sinks: CSV partitioned by symbol with a header and empty missing values; settings JSON."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tickweave.functions.indicators import add_indicators
from tickweave.sources.bars import daily_bars
from tickweave.sources.sinks import export_csv, export_settings_json, settings_json


def test_export_csv_layout(spark, scratch):
    df = add_indicators(daily_bars(spark, SF_SMALL)).select("symbol", "date", "close", "ma200")
    path = os.path.join(scratch, "csv")
    export_csv(df, path)
    parts = sorted(d for d in os.listdir(path) if d.startswith("symbol="))
    assert len(parts) == 10
    first = next(f for f in os.listdir(os.path.join(path, parts[0])) if f.endswith(".csv"))
    lines = open(os.path.join(path, parts[0], first)).read().splitlines()
    assert lines[0] == "date,close,ma200"
    assert lines[1].endswith(",")  # MA200 is missing on the first rows: an empty field, not "null"


def test_settings_json_with_alerts(spark, scratch):
    favs = spark.createDataFrame([(1, ["B", "A"]), (2, ["C"])], "user_id long, favorites array<string>")
    alerts = spark.createDataFrame([(1, "B", 10.5), (1, "A", 3.0)], "user_id long, symbol string, price double")
    s = {r.user_id: json.loads(r.settings_json) for r in settings_json(favs, alerts).collect()}
    assert s[1] == {"favorites": ["B", "A"], "alerts": [{"stock": "A", "price": 3.0}, {"stock": "B", "price": 10.5}],
                    "model_config": {"epochs": 20, "batch_size": 32}}
    assert s[2]["alerts"] == []
    path = os.path.join(scratch, "json")
    export_settings_json(settings_json(favs, alerts), path)
    lines = [l for f in os.listdir(path) if f.startswith("part-") for l in open(os.path.join(path, f))]
    assert len(lines) == 2 and all(json.loads(l)["model_config"]["epochs"] == 20 for l in lines)


def test_export_csv_deals_rows_by_symbol(spark, scratch):
    """A frame dealt at random: one file a symbol, in date order, no row lost."""
    df = daily_bars(spark, SF_SMALL).select("symbol", "date", "close").repartition(7)
    path = os.path.join(scratch, "csv")
    export_csv(df, path)
    files = [[f for f in os.listdir(os.path.join(path, d)) if f.endswith(".csv")] for d in os.listdir(path) if d.startswith("symbol=")]
    assert len(files) == 10 and all(len(f) == 1 for f in files)
    back = spark.read.option("header", True).schema("date date, close double, symbol string").csv(path)
    assert back.select("symbol", "date", "close").exceptAll(df).count() == 0 and back.count() == df.count()
    one = next(d for d in os.listdir(path) if d.startswith("symbol="))
    dates = [line.split(",")[0] for f in os.listdir(os.path.join(path, one)) if f.endswith(".csv")
             for line in open(os.path.join(path, one, f)).read().splitlines()[1:]]
    assert dates == sorted(dates) and len(dates) > 1
