"""Known answers of the engine, worked out by hand."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import drift, metrics, panel, universe, walkforward


def month_ends(n):
    out, y, m = [], 2000, 1
    for _ in range(n):
        y2, m2 = (y, m + 1) if m < 12 else (y + 1, 1)
        out.append(datetime.date(y2, m2, 1) - datetime.timedelta(days=1))
        y, m = y2, m2
    return out


def prices(spark, **series):
    dates = month_ends(len(next(iter(series.values()))))
    rows = [(t, dates[t], k, None if p is None else float(p)) for k, name in enumerate(series) for t, p in enumerate(series[name])]
    return spark.createDataFrame(rows, "t int, date date, ticker long, close double")


def weights(spark, rows):
    return spark.createDataFrame([("s", t, k, float(w)) for t, k, w in rows], "strategy string, t int, ticker long, w double")


def held(spark, px, w=1.0):
    fixed = spark.createDataFrame([(0, float(w))], "ticker long, w double")
    return drift.hold(px, fixed, "s")


def run(spark, px, w, **options):
    options = {"freq": 12, "lag": 0} | options
    curve = drift.backtest(w, px, **options).persist()
    return curve, metrics.metrics(curve, freq=options["freq"]).first()


def test_constant_growth(spark):
    px = prices(spark, a=[1.01**i for i in range(121)])
    curve, m = run(spark, px, held(spark, px))
    assert m["ann_vol"] == pytest.approx(0, abs=1e-9) and m["max_drawdown"] == pytest.approx(0, abs=1e-12)
    assert m["total_return"] == pytest.approx(1.01**120 - 1) and m["ann_return"] == pytest.approx(1.01**12 - 1)
    assert all(r["ret"] == pytest.approx(0.01) for r in metrics.with_returns(curve).where("i > 0").collect())


def test_drawdown(spark):
    px = prices(spark, a=[1, 1.5, 0.75, 0.9])
    assert run(spark, px, held(spark, px))[1]["max_drawdown"] == pytest.approx(-0.5)


def test_volatility(spark):
    path = [1.0]
    for i in range(120):
        path.append(path[-1] * (1.1 if i % 2 == 0 else 0.9))
    px = prices(spark, a=path)
    assert run(spark, px, held(spark, px))[1]["ann_vol"] == pytest.approx(0.1 * math.sqrt(120 / 119) * math.sqrt(12))


def test_exact_cost(spark):
    px = prices(spark, a=[1] * 5, b=[1] * 5)
    assert run(spark, px, weights(spark, [(0, 0, 1), (0, 1, 0)]), cost=0.01)[1]["total_return"] == pytest.approx(-0.01)


def test_short_multiplier(spark):
    px = prices(spark, a=[1] * 5)
    costs = [run(spark, px, weights(spark, [(0, 0, side)]), cost=0.01, short_mult=1.5)[0].agg({"cost_frac": "sum"}).first()[0] for side in (1, -1)]
    assert costs[1] / costs[0] == pytest.approx(1.5)


def test_borrow_fee(spark):
    px = prices(spark, a=[1] * 13)
    short = run(spark, px, held(spark, px, -1), borrow=0.12)[1]
    assert short["ann_borrow"] == pytest.approx(0.12) and short["total_return"] == pytest.approx(0.99**12 - 1)
    long = run(spark, px, held(spark, px, 1), borrow=0.12)[1]
    assert long["ann_borrow"] == 0 and long["total_return"] == pytest.approx(0)


@pytest.mark.parametrize(("signal", "lag", "total"), [(2, 0, 1.0), (3, 0, 0.0), (2, 1, 0.0)])
def test_timing(spark, signal, lag, total):
    px = prices(spark, a=[1, 1, 1, 2, 2])
    assert run(spark, px, weights(spark, [(signal, 0, 1)]), lag=lag)[1]["total_return"] == pytest.approx(total)


def test_tiers(spark):
    rows = [(0, datetime.date(2000, 1, 31), k, v) for k, v in enumerate([2e9, 5e7, 5e5, None])]
    rates = universe.tiered_costs(spark.createDataFrame(rows, "t int, date date, ticker long, dv double"), lookback=1)
    assert [r["rate"] for r in rates.orderBy("ticker").collect()] == [0.0005, 0.0025, 0.0150, 0.0150]


def test_walk_forward(spark):
    px = prices(spark, a=[1.01**i for i in range(60)], b=[1.005**i for i in range(60)])
    plan = walkforward.blocks(px, 24, 6)
    slices = walkforward.training_rows(px, plan, 24)
    assert [r["n"] for r in slices.groupBy("block").agg({"t": "count"}).withColumnRenamed("count(t)", "n").collect()] == [48] * 6
    native = walkforward.best_momentum(px, plan, 24, 6)
    user = walkforward.user_signal(slices, lambda wide: (wide.iloc[-1] / wide.iloc[0] == (wide.iloc[-1] / wide.iloc[0]).max()).astype(float))
    assert {(r["block"], r["ticker"]) for r in native.collect()} == {(r["block"], r["ticker"]) for r in user.where("w > 0").collect()}
    assert run(spark, px, walkforward.held_weights(px, plan, native, "s"))[1]["ann_return"] > 0


def test_signals_may_name_their_dates(spark):
    import pandas as pd

    px = prices(spark, a=[1.01**i for i in range(40)], b=[1.005**i for i in range(40)])
    plan = walkforward.blocks(px, 24, 6)

    def signal(wide):  # the first block names three dates, of which the second's months are its own; later ones hold name 1
        if wide.index[-1] == 23:
            return pd.DataFrame({0: [0.5, 0.7, 0.9], 1: [0.5, None, 0.1]}, index=[24, 26, 30])
        return pd.Series({1: 1.0})

    signals = walkforward.user_signal(walkforward.training_rows(px, plan, 24), signal)
    got = {(r["t"], r["ticker"]): r["w"] for r in walkforward.held_weights(px, plan, signals, "s").collect()}
    expected = {(24, 0): 0.5, (24, 1): 0.5, (26, 0): 0.7, (26, 1): 0.0} | {(t, k): float(k) for t in range(30, 40) for k in (0, 1)}
    assert got == expected


def test_weights_of_each_shape(spark):
    px = prices(spark, a=[1, 2, 3, 4], b=[1, 1, 1, 1])
    one = px.where("ticker = 0")
    dates = month_ends(4)
    both = spark.createDataFrame([(dates[1], 0, 0.5), (dates[2], 1, 0.25)], "date date, ticker long, w double")
    rows = lambda frame: [r["w"] for r in frame.orderBy("t", "ticker").collect()]
    assert rows(drift.shaped(both, px)) == [0, 0, 0.5, 0, 0, 0.25, 0, 0.25]
    assert rows(drift.shaped(both.where("w = 0.5").drop("date"), px)) == [0.5, 0] * 4
    assert rows(drift.shaped(both.drop("ticker"), one)) == [0, 0.5, 0.25, 0.25]
    with pytest.raises(ValueError):
        drift.shaped(both.drop("ticker"), px)
    with pytest.raises(ValueError):
        drift.shaped(both.select("w"), px)
    assert run(spark, px, both.where("w = 0.5").drop("date"))[0].count() == 4


def test_prices_are_checked(spark):
    px = prices(spark, a=[1, 2])
    assert panel.checked_prices(px).columns == ["date", "ticker", "close"]
    with pytest.raises(ValueError):
        panel.checked_prices(px.drop("close"))
    with pytest.raises(TypeError):
        panel.checked_prices(px.withColumn("date", F.col("date").cast("string")))


def stepped_through(targets, px, cost=0.0, borrow=0.0, *, freq=252, short_mult=1.5):
    """The same curve, one date after the other."""

    def follow(frame):
        wide = {c: frame.pivot(index="t", columns="ticker", values=c).sort_index().to_numpy(float) for c in ("ret", "tc", "bf", "target")}
        dates = frame.groupby("t").agg({"date": "first", "executes": "max"}).sort_index()
        w, equity, out = np.zeros(wide["ret"].shape[1]), 1.0, []
        for i, (t, row) in enumerate(dates.iterrows()):
            traded = cost_now = owed = 0.0
            if row["executes"]:
                goal = np.nan_to_num(wide["target"][i])
                change = np.abs(goal - w)
                traded, cost_now = change.sum(), min(drift.CAP, float((change * wide["tc"][i] * np.where(goal < 0, short_mult, 1.0)).sum()))
                w = goal
            if i:
                ret = np.nan_to_num(wide["ret"][i])
                factor = 1 + float(w @ ret)
                owed = min(drift.CAP, float((-np.minimum(w, 0) * wide["bf"][i]).sum() / freq))
                equity *= factor
                if factor > 0 and np.isfinite(factor):
                    w = w * (1 + ret) / factor
            equity *= (1 - cost_now) * (1 - owed)
            out.append((frame["strategy"].iloc[0], int(t), row["date"], equity, traded / 2, cost_now, owed))
        return pd.DataFrame(out, columns=["strategy", "t", "date", "equity", "turnover", "cost_frac", "borrow_frac"])

    schema = "strategy string, t int, date date, equity double, turnover double, cost_frac double, borrow_frac double"
    return drift._grid(targets, px, cost, borrow).groupBy("strategy").applyInPandas(follow, schema)


def test_closed_form_is_the_sequential_run(spark):
    rng = random.Random(4)
    series = {}
    for k in range(6):
        p, path = 10.0, []
        for t in range(40):
            p *= 1 + rng.uniform(-0.1, 0.1)
            path.append(None if (k == 2 and 10 < t < 14) or (k == 4 and t > 30) else p)
        series[f"n{k}"] = path
    px = prices(spark, **series)
    w = weights(spark, [(t, k, rng.uniform(-0.5, 0.5)) for t in range(0, 40, 4) for k in range(6)])
    rates = px.select("date", "ticker", ((px["ticker"] + 1) / 1000.0).alias("rate"))
    for lag in (0, 1):
        targets = drift.schedule(w, px, lag=lag)
        closed = drift.curve(drift.positions(targets, px, rates, 0.06), freq=12).orderBy("t").collect()
        stepped = stepped_through(targets, px, rates, 0.06, freq=12).orderBy("t").collect()
        for a, b in zip(closed, stepped, strict=True):
            assert all(a[c] == pytest.approx(b[c], abs=1e-10) for c in ("equity", "turnover", "cost_frac", "borrow_frac"))


def test_lost_portfolios_are_restarted(spark):
    """Books so short that they are lost again and again, between executions, at one, and at the panel's end."""
    rng = random.Random(11)
    paths = {f"n{k}": [round(rng.uniform(1, 4), 2) if rng.random() < 0.9 else None for _ in range(30)] for k in range(5)}
    px = prices(spark, **paths)
    rows = [(s, t, k, rng.uniform(-0.9, 0.5)) for s in ("a", "b", "c", "d") for t in range(0, 30, {"a": 1, "b": 4, "c": 11, "d": 29}[s]) for k in range(5)]
    rows += [("calm", 0, k, 0.1) for k in range(5)]
    w = spark.createDataFrame(rows, "strategy string, t int, ticker long, w double")
    rates = px.select("date", "ticker", ((px["ticker"] + 1) / 1000.0).alias("rate"))
    for lag in (0, 1):
        got = {(r["strategy"], r["t"]): r for r in drift.backtest(w, px, freq=12, lag=lag, cost=rates, borrow=0.06).collect()}
        wanted = stepped_through(drift.schedule(w, px, lag=lag), px, rates, 0.06, freq=12).collect()
        assert len(got) == len(wanted) and min(r["equity"] for r in wanted) < 0
        for r in wanted:
            assert all(got[r["strategy"], r["t"]][c] == pytest.approx(r[c], abs=1e-10, rel=1e-10) for c in ("equity", "turnover", "cost_frac", "borrow_frac"))


def test_wiped_out_portfolio_is_stepped(spark):
    px = prices(spark, a=[1, 1, 2.5, 2.5, 5])
    short = weights(spark, [(0, 0, -1)])
    both = short.unionByName(short.withColumn("strategy", F.lit("long")).withColumn("w", -short["w"]))
    curves = drift.backtest(both, px, freq=12, lag=0)
    last = curves.where("strategy = 's'").orderBy("t").collect()[-1]
    assert curves.where("strategy = 'long'").orderBy("t").collect()[-1]["equity"] == pytest.approx(5.0) and curves.count() == 10
    # the loss of 150 % turns the value negative and stops the drift: the short of 1 then loses 100 % more, of -0.5
    assert last["equity"] == pytest.approx((1 - 1.5) * (1 - 1.0))


def test_arguments(spark):
    px = prices(spark, a=[1, 2])
    with pytest.raises(ValueError):
        drift.schedule(held(spark, px), px, lag=-1)
    with pytest.raises(ValueError):
        universe.align_rates(px, -0.1)
    with pytest.raises(ValueError):
        walkforward.blocks(px, 0, 6)


def test_delisting(spark):
    px = prices(spark, a=[1, 2, None, None], b=[1, 2, 3, None], c=[None] * 4, d=[1, None, 3, 4])
    out = {(r["ticker"], r["t"]): r["close"] for r in panel.inject_delisting(px).collect()}
    assert out[0, 2] == pytest.approx(1.4) and out[0, 3] is None and out[1, 3] == pytest.approx(2.1)
    assert all(out[2, t] is None for t in range(4)) and out[3, 1] is None
