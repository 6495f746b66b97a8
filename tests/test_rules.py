"""One test for each rule of the panel operators that is easy to get wrong."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.boosting import boosted_probabilities
from tidepanel.functions.unitroot import adf_p_value
from tidepanel.operators import execution, features, ffd, metrics, panel, portfolio, ranks, returns, scoring, universe
from tidepanel.sources import files, scratch

D = [datetime.date(2000, 1, 1) + datetime.timedelta(days=31 * k) for k in range(60)]


def frame(spark, rows, columns):
    return spark.createDataFrame([(t, D[t], k, *v) for t, k, *v in rows], "t int, date date, ticker long, " + columns)


def test_gap_returns(spark):
    px = frame(spark, [(0, 0, 1.0), (1, 0, None), (2, 0, 3.0), (3, 0, None)], "close double")
    got = lambda fill: [r["ret"] for r in returns.simple_returns(px, fill=fill).orderBy("t").collect()]
    assert got("none") == [None, None, None, None]
    assert got("pad") == [None, 0.0, 2.0, 0.0]
    with pytest.raises(ValueError):
        returns.simple_returns(px, fill="x")


def test_product_skips_missing_and_pos_counts_all(spark):
    px = frame(spark, [(t, 0, None if t % 2 else 0.1) for t in range(30)], "ret double")
    row = features.dynamics(features.momentum(px)).where("t = 20").first()
    assert row["mom3"] == pytest.approx(1.1 - 1) and row["pos"] == pytest.approx(6 / 11)
    empty = features.momentum(frame(spark, [(t, 0, None) for t in range(30)], "ret double")).where("t = 25").first()
    assert empty["mom6"] == 0.0 and empty["mom1"] is None


def test_percent_rank_of_ties(spark):
    rows = frame(spark, [(0, k, v) for k, v in enumerate([1.0, 2.0, 2.0, 3.0, None])], "x double")
    from tidepanel.operators import ranks

    got = [r["p"] for r in ranks.percent_rank_ties(rows, "x", "p").orderBy("ticker").collect()]
    assert got == [0.25, 0.625, 0.625, 1.0, None]


def test_deciles_of_thirteen(spark):
    rows = frame(spark, [(0, k, float(k)) for k in range(13)], "ret double")
    labels = [r["label"] for r in features.decile_labels(rows).orderBy("ret").collect()]
    assert [labels.count(k) for k in range(9, -1, -1)] == [2, 1, 1, 2, 1, 1, 2, 1, 1, 1]


def test_missing_size_is_in_the_middle(spark):
    rows = frame(spark, [(t, k, None if k == 0 else float(k)) for t in range(2) for k in range(4)], "dv double")
    assert features.size_decile(rows).where("t = 1 and ticker = 0").first()["size_decile"] == 5


@pytest.mark.parametrize(("n", "k"), [(20, 2), (100, 6)])
def test_tail_count(spark, n, k):
    rows = spark.createDataFrame([("s", float(i)) for i in range(n)], "strategy string, x double")
    assert metrics.tail_mean(rows, "x", "m").first()["m"] == pytest.approx(sum(range(k)) / k)


def test_asof_takes_whole_rows(spark):
    px = frame(spark, [(t, k, 1.0) for t in range(4) for k in range(2)], "close double")
    w = spark.createDataFrame([(D[0], 0, 0.3), (D[0], 1, 0.4), (D[2], 0, 0.5)], "date date, ticker long, w double")
    got = {(r["t"], r["ticker"]): r["w"] for r in panel.asof_weights(w, px).collect()}
    assert got[1, 1] == 0.4 and got[2, 1] == 0 and got[3, 0] == 0.5


def test_rates(spark):
    px = frame(spark, [(t, k, 1.0) for t in range(3) for k in range(2)], "close double")
    rates = spark.createDataFrame([(D[1], 0, 0.1), (D[1], 1, None)], "date date, ticker long, rate double")
    got = {(r["t"], r["ticker"]): r["rate"] for r in universe.align_rates(px, rates).collect()}
    assert got == {(0, 0): 0.1, (1, 0): 0.1, (2, 0): 0.1, (0, 1): 0.1, (1, 1): 0.1, (2, 1): 0.1}


def test_eligibility_counts_rows(spark):
    px = frame(spark, [(t, 0, 10.0 if t >= 3 else None, 1e9) for t in range(20)], "close double, dv double")
    got = [r["eligible"] for r in universe.eligibility(px).orderBy("t").collect()]
    assert got == [False] * 14 + [True] * 6  # twelve prices from t = 14 on


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(1)
    px = [(t, k, float(x), 1.0) for t in range(26) for k, x in enumerate(rng.uniform(5, 6, 5))]
    later = [(t, k, p * (9 if t >= 22 else 1), v) for t, k, p, v in px]
    both = [features.feature_matrix(returns.simple_returns(frame(spark, rows, "close double, dv double"))).where("t <= 22").orderBy("t", "ticker").collect() for rows in (px, later)]
    assert both[0] == both[1] and both[0]


def test_constant_signal_and_short_series(spark):
    rows = frame(spark, [(t, 0, 1.0) for t in range(5)] + [(0, 1, 1.0), (1, 1, 2.0)] + [(t, 2, float((-1) ** t)) for t in range(9)], "signal double")
    assert {r["ticker"]: r["phi"] for r in execution.acf1(rows, ["ticker"]).collect()} == {0: 0.0, 1: 0.5, 2: 0.01}


def test_policy_parameters():
    policy = execution.Policy()
    assert policy.a == pytest.approx(0.499833, abs=1e-6) and policy.fraction == pytest.approx(0.249917, abs=1e-6)
    aim = policy.aim(np.array([1.0, 2.0]), 0.65, np.diag([2.0, 4.0]))
    assert aim == pytest.approx(np.array([0.5, 0.5]) * policy.aim_weight(0.65))


@pytest.mark.parametrize("span", [3, 128])
def test_policies_step_by_step(spark, monkeypatch, span):
    monkeypatch.setattr(execution, "SPAN", span)
    monkeypatch.setattr(execution, "CELLS", 40)
    rng = np.random.default_rng(3)
    wide = rng.standard_normal((11, 17)) * (rng.random((11, 17)) > 0.4)
    wide[:2] = 0  # nothing to hold at first
    rows = spark.createDataFrame([(t, k, float(wide[t, k])) for t in range(11) for k in range(17) if wide[t, k] or t == 0], "t int, ticker long, w double").repartition(3)
    phi = spark.createDataFrame([(4, 0.3), (6, None), (9, 0.9), (99, 0.1)], "t int, phi double")
    decay = [0.65] * 4 + [0.3] * 5 + [0.9] * 2
    policies = {"slow": execution.Policy(cost=10.0), "fast": execution.Policy(cost=0.5, gross=1.5), "base": execution.Policy()}
    got = {(r["run"], r["t"], r["ticker"]): r["w"] for r in execution.run_policies(rows, policies, phi).collect()}
    days = sorted({t for _, t, _ in got})
    assert days == [0, *range(2, 11)] and len(got) == 3 * len(days) * 17
    for name, policy in policies.items():
        held = np.zeros(17)
        for t in days:
            held = (1 - policy.fraction) * held + policy.fraction * policy.aim_weight(decay[t]) * wide[t]
            if np.abs(held).sum() > 0:
                held *= policy.gross / np.abs(held).sum()
            assert [got[name, t, k] for k in range(17)] == pytest.approx(held.tolist(), abs=1e-12)
    assert execution.run_policies(rows.limit(0), policies, 0.65).count() == 0


def test_shorts_only_among_shortable(spark):
    rows = frame(spark, [(0, k, float(k)) for k in range(30)], "signal double")
    masks = spark.createDataFrame([(0, k, k in (7, 9)) for k in range(30)], "t int, ticker long, shortable boolean")
    got = {r["ticker"]: r["w"] for r in portfolio.long_short(rows, shortable=masks).collect() if r["w"]}
    assert got == {7: -1 / 3, 9: -1 / 3, 27: 1 / 3, 28: 1 / 3, 29: 1 / 3}
    assert portfolio.long_short(rows.where("ticker < 10")).count() == 0


def test_taps():
    assert ffd.taps(0) == [1.0] and ffd.taps(1) == [1.0, -1.0]
    assert len(ffd.taps(0.4, 1e-5)) == 60 and len(ffd.taps(0.99, 1e-5)) == 33
    with pytest.raises(ValueError):
        ffd.taps(2.5)


def test_scores(spark):
    probs = spark.createDataFrame([(0, 0, [1.0] + [0.0] * 9), (0, 1, [0.1] * 10)], "t int, ticker long, p array<double>")
    stats = spark.createDataFrame([(k, 0.05 - 0.01 * k, 0.04) for k in range(10)], "k int, mu double, sigma2 double")
    a, b = scoring.with_scores(probs, stats).orderBy("ticker").collect()
    assert a["dpr"] == 5 and a["ret_score"] == pytest.approx(0.05) and a["srp"] == pytest.approx(0.25)
    assert b["dpr"] == pytest.approx(0) and b["ret_score"] == pytest.approx(0.005)
    members = spark.createDataFrame([(0, 0, [0.2, 0.8]), (0, 0, [0.4, 0.6])], "t int, ticker long, p array<double>")
    assert scoring.ensemble_mean(members).first()["p"] == pytest.approx([0.3, 0.7])


def test_boosting_learns_and_sums_to_one():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 4))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0)
    p = boosted_probabilities(x[:400], y[:400], x[400:500], y[400:500], x[500:], seed=1, classes=4, trees=30)
    assert p.sum(1) == pytest.approx(np.ones(100)) and (p.argmax(1) == y[500:]).mean() > 0.9


def test_unit_root():
    rng = np.random.default_rng(5)
    noise = rng.standard_normal(300)
    assert adf_p_value(noise) < 0.01 and adf_p_value(np.cumsum(noise)) > 0.1
    slow = [0.0]
    for e in noise:
        slow.append(0.5 * slow[-1] + e)
    assert adf_p_value(np.array(slow)) < 0.01


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.csv").write_text("date,open,high,low,close,volume,Name\n2020-01-02,1,2,0.5,1.5,100,AA\n")
    assert files.read_archive(spark, str(tmp_path / "a.csv")).first()[1:] == ("AA", 1.5, 100.0)
    (tmp_path / "v" / "ticker=BB").mkdir(parents=True)
    (tmp_path / "v" / "ticker=BB" / "x.json").write_text('{"date": "2020-01-31T00:00:00+00:00", "adjClose": 2.0, "adjVolume": 5}\n{"date": "2020-02-29T00:00:00Z"}\n')
    got = files.read_vendor(spark, str(tmp_path / "v"))
    assert [tuple(r) for r in got.collect()] == [("BB", datetime.date(2020, 1, 31), 2.0, 5.0)]
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("m.csv", "ticker,exchange,assetType,startDate,endDate\nAA,NYSE,Stock,2000-01-01,\nCC,NYSE,Stock,2000-01-01,2001-01-01\nDD,OTC,Stock,,\n")
    universe_rows = panel.filter_universe(files.read_metadata(spark, str(tmp_path / "m.zip")), ["NYSE"], "Stock", datetime.date(2010, 1, 1))
    assert [r[0] for r in universe_rows.collect()] == ["AA"]
    files.write_checkpoint(got, str(tmp_path / "c"))
    left = files.remaining(spark.createDataFrame([("BB",), ("EE",)], "ticker string"), files.read_checkpoint(spark, str(tmp_path / "c")))
    assert [r[0] for r in left.collect()] == ["EE"]


def test_performance(spark):
    rows = spark.createDataFrame([(0, 0.1), (1, -0.5), (2, 0.2)], "t int, r double")
    got = metrics.performance(rows, "r").first()
    r = np.array([0.1, -0.5, 0.2])
    assert got["ann"] == pytest.approx(r.mean() * 12) and got["max_dd"] == pytest.approx(-0.5)
    assert got["sharpe"] == pytest.approx(r.mean() * 12 / (r.std() * math.sqrt(12)))


def test_comparison_keeps_to_the_masks_and_adjusts_the_learned_weights(spark):
    from pyspark.sql import functions as F

    from tidepanel.plans.backtest_queries import compared_weights
    from tidepanel.plans.panel_queries import FLOORS

    rng = np.random.default_rng(5)
    price = 2000 * np.exp(np.cumsum(rng.normal(0, 0.05, (56, 30)), 0))
    first = datetime.date(2000, 1, 1)
    rows = [(t, first + datetime.timedelta(days=31 * t), k, float(max(price[t, k], 1000.0)), 1.0, (1e5, 2.5e5, 1e6)[k % 3]) for t in range(56) for k in range(30)]
    panel = spark.createDataFrame(rows, "t int, date date, ticker long, close double, volume double, dv double").cache()
    weights = compared_weights(panel, seeds=1, trees=3).cache()
    for name in ("momentum", "model"):
        held = weights.where((F.col("strategy") == name) & (F.col("w") != 0))
        got = {(r["t"], r["ticker"]): r["w"] for r in held.collect()}
        assert min(t for t, _ in got) == 42 and max(t for t, _ in got) == 54
        assert all(k % 3 for _, k in got) and all(k % 3 == 2 for (_, k), w in got.items() if w < 0)
        assert {t for t, _ in got} == set(range(42, 55)) and all(sum(w < 0 for (u, _), w in got.items() if u == t) == 2 for t in range(42, 55))
    learned = weights.where("strategy = 'model'")
    phi = execution.acf1(learned.select("t", "ticker", F.col("w").alias("signal")), ["ticker"]).agg(F.avg("phi")).first()[0]
    expected = execution.run_policies(learned, {"adjusted": execution.Policy()}, phi)
    both = weights.where("strategy = 'adjusted'").select("t", "ticker", "w").join(expected.withColumnRenamed("w", "e"), ["t", "ticker"], "full")
    assert both.where("w is null or e is null or abs(w - e) > 1e-12").isEmpty() and not both.isEmpty()
    assert universe.eligibility(panel, **FLOORS).where("eligible and t > 20").select("ticker").distinct().count() == 20


def test_class_means_are_of_each_fold(spark):
    labels = spark.createDataFrame([(0, 3, 0.1), (0, 3, 0.3), (1, 3, 0.5)], "fold int, label int, ret double")
    stats = features.class_stats(labels, ("fold",))
    assert stats.count() == 20
    probs = spark.createDataFrame([(f, 0, f, [0.0] * 3 + [1.0] + [0.0] * 6) for f in (0, 1)], "fold int, t int, ticker long, p array<double>")
    assert [r["ret_score"] for r in scoring.with_scores(probs, stats, ("fold",)).orderBy("fold").collect()] == pytest.approx([0.2, 0.5])


def test_registered_ensemble_is_whole(spark, monkeypatch):
    from tidepanel.plans import backtest_queries

    asked = {}
    monkeypatch.setattr(backtest_queries, "month_panel", lambda *_: None)
    monkeypatch.setattr(backtest_queries, "model_returns", lambda *_: None)
    monkeypatch.setattr(backtest_queries, "settled", lambda *_: None)
    monkeypatch.setattr(backtest_queries.features, "feature_matrix", lambda *_: None)
    monkeypatch.setattr(backtest_queries.features, "decile_labels", lambda *_: None)
    monkeypatch.setattr(backtest_queries.model, "fit_predict", lambda *_, **options: asked.update(options))
    backtest_queries.ensemble_fit_predict(spark, "")
    assert (asked["seeds"], asked["trees"]) == (20, 300)


def test_long_work_on_few_bytes_is_spread(spark):
    """The filter by name is dear and its rows are small: the tasks are not coalesced, and have as many rows as a task may."""
    rows = spark.range(4000).select((F.col("id") % 40).cast("int").alias("t"), F.floor(F.col("id") / 40).alias("ticker"), (F.lit(5.0) + F.col("id") % 7).alias("close"))
    orders = rows.select("ticker").distinct().withColumn("d", (F.col("ticker") % 4 + 3) / 10.0)
    levels = ffd.level_by_ticker(rows, orders, 1e-5, 12)
    assert levels.rdd.getNumPartitions() > 1
    steps = levels.where("t >= 11").count()
    assert steps == levels.where("level is not null").count() == 2900


def test_spread_bounds_the_rows_of_a_part(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS", 100)
    assert scratch.spread(spark.range(4000), "id").rdd.getNumPartitions() == 40


def test_positions_leave_tasks_as_arrays():
    """Positions are not made into a Python number each, and a part is bounded by the cells of all its runs."""
    w, held = np.ones((3, 4)), np.zeros((3, 2))
    matrices = lambda frames, width: ((f, w, dict(zip("ab", held.T))) for f in frames)
    ones, each = np.ones(4), {"a": np.ones(4), "b": np.ones(4)}
    task = execution._block_paths(matrices, {"a": ones, "b": ones}, each, {"a": 0.5, "b": 0.5}, 4)
    (out,) = task([pd.DataFrame({"ticker": [1, 2, 3]})])
    assert all(isinstance(run, np.ndarray) for one in out["paths"] for run in one)
    assert out["paths"][0][0].tolist() == [1.0, 1.5, 1.75, 1.875]


def test_ranks_and_engine_bound_the_rows_of_a_task(spark, monkeypatch):
    """Windows over small rows are not coalesced into tasks of any number of rows."""
    monkeypatch.setattr(scratch, "ROWS", 500)
    rows = scratch.settled(spark.range(6000).select((F.col("id") % 20).cast("int").alias("t"), F.floor(F.col("id") / 20).alias("ticker"), ((F.col("id") * 7919) % 6007).cast("double").alias("v")), "rows")
    placed = ranks.placed(rows, "v", "place")
    assert placed.rdd.getNumPartitions() == 12
    assert placed.groupBy("t").agg(F.max("place").alias("m"), F.count_distinct("place").alias("n")).where("m != 300 or n != 300").isEmpty()
