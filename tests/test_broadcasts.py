"""What is sent whole to the driver: rows by date or strategy, never those by name and date."""

import os

import pytest

import __spark_entry__ as entry
from tidepanel.operators import features, portfolio, returns
from tidepanel.plans import backtest_queries, research_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["weights_bench_masked", "drift_equity"])
def test_rows_of_names_and_dates_are_merged(spark, monkeypatch, name):
    """Written tables of few bytes are taken for small: at 60 times sf0.1 masks of 3.5 million rows were broadcast."""
    plans = []
    for module in (features, portfolio, returns, backtest_queries, research_queries):
        real = module.settled
        monkeypatch.setattr(module, "settled", lambda frame, label, real=real: plans.append(frame) or real(frame, label))
    plans.append(entry.queries()[name](spark, SF))
    lines = [line for frame in plans for line in frame._jdf.queryExecution().executedPlan().toString().split("\n")]
    assert any("SortMergeJoin" in line for line in lines)
    assert not [line for line in lines if "BroadcastHashJoin" in line and "ticker" in line]
