"""Registered queries that SQL can't express, beside plain versions of what they compose."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from tidepanel.functions.unitroot import adf_p_value
from tidepanel.operators import ffd, model
from tidepanel.sources import tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def series(spark):
    rows = tables.month_panel(spark, SF).select("t", "ticker", "close").toPandas().pivot(index="t", columns="ticker", values="close").sort_index().ffill()
    return {k: np.log(rows[k].dropna().to_numpy(float)) for k in rows.columns}, rows


def filtered(x, d):
    w = np.array(ffd.taps(d, 1e-5, 60))
    return np.array([x[i - len(w) + 1 : i + 1] @ w[::-1] if i >= len(w) - 1 else np.nan for i in range(len(x))])


def test_searched_chain(spark):
    logs, wide = series(spark)
    found = {k: model.smallest_order(x) for k, x in logs.items()}
    for k, d in found.items():  # no smaller order on the first grid rejects a unit root
        for step in np.arange(0, d - 0.05, 0.05):
            left = filtered(logs[k], step)
            left = left[~np.isnan(left)]
            assert len(left) < 10 or adf_p_value(left) >= 0.05
    d = float(np.median(list(found.values())))
    got = {(r["t"], r["ticker"]): r for r in entry.queries()["ffd_scores_searched"](spark, SF).collect()}
    assert all(r["d"] == pytest.approx(d) for r in got.values()) and len(got) == wide.size
    for k in wide.columns:
        level = filtered(np.log(wide[k].to_numpy(float)), d)
        for t in range(len(level)):
            for m, name in ((0, "ffd1"), (3, "ffd3"), (12, "ffd12")):
                wanted = level[t] - (level[t - m] if m and t >= m else 0.0 if not m else np.nan)
                value = got[t, k][name]
                assert (value is None) == bool(np.isnan(wanted)) and (value is None or value == pytest.approx(wanted, abs=1e-9))


def test_searched_rolling_scores(spark):
    logs, wide = series(spark)
    got = {(r["t"], r["ticker"]): r for r in entry.queries()["ffd_scores_rolling_searched"](spark, SF).collect()}
    assert len(got) == wide.size
    for k in wide.columns:
        d = model.smallest_order(logs[k])
        level = filtered(np.log(wide[k].to_numpy(float)), d)
        for t in range(len(level)):
            r = got[t, k]
            assert r["d"] == pytest.approx(d)
            for m in (1, 3, 6, 9, 12):
                known = [x for x in level[max(0, t - m + 1) : t + 1] if not np.isnan(x)]
                wanted = np.mean(known) if len(known) >= max(1, m // 2) else None
                assert (r[f"ffd{m}"] is None) == (wanted is None) and (wanted is None or r[f"ffd{m}"] == pytest.approx(wanted, abs=1e-8))


def test_learned_comparison(spark):
    lines = {r["strategy"]: r for r in entry.queries()["compared_learned_scores"](spark, SF).collect()}
    assert lines.keys() == {"bench", "dpr", "ret", "srp"}
    assert all(r["max_dd"] <= 0 and np.isfinite(r["sharpe"]) for r in lines.values())


def test_expanding_weights(spark):
    rows = entry.queries()["model_weights_expanding"](spark, SF).collect()
    dates = {}
    for r in rows:
        dates.setdefault(r["t"], []).append(r["w"])
    assert min(dates) == 42 and all(abs(sum(w)) < 1e-12 and sum(map(abs, w)) == pytest.approx(2) for w in dates.values())
