import os

from conftest import SF_SMALL


def test_cli_lists_and_runs_a_tab(spark, scratch, capsys):
    from tickweave.cli import TABS, main
    from tickweave.plans.catalog import QUERIES
    assert all(q in QUERIES for qs in TABS.values() for q in qs)
    assert main(["list"]) == 0
    assert "portfolio:" in capsys.readouterr().out
    assert main(["tab", "flows", "--sf-dir", SF_SMALL, "--out", scratch, "--format", "csv"]) == 0
    assert sorted(os.listdir(scratch)) == ["a6_net_flow", "a6_net_flow_total"]
    assert spark.read.option("header", True).csv(os.path.join(scratch, "a6_net_flow_total")).count() == 5
    assert main(["run", "nope"]) == 2
