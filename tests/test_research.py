"""Compositions on small tables."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import execution, model, panel, research, returns
from tidepanel.plans import research_queries
from tidepanel.sources import tables
from tidepanel.sources.scratch import settled

D = [datetime.date(2000, 1, 31) + datetime.timedelta(days=30 * k) for k in range(40)]


def test_aim_solves_for_the_covariance(spark):
    rng = np.random.default_rng(1)
    root = rng.standard_normal((5, 5))
    covariance = root @ root.T + np.eye(5)
    signals = rng.standard_normal((3, 5))
    rows = spark.createDataFrame([(t, k, float(signals[t, k])) for t in range(3) for k in range(5)], "t int, ticker long, signal double")
    held = spark.createDataFrame([(i, j, float(covariance[i, j])) for i in range(5) for j in range(5)], "ticker long, other long, value double")
    policy = execution.Policy(risk=2.0)
    got = {(r["t"], r["ticker"]): r["aim"] for r in research.aims(rows, 0.5, policy, held).collect()}
    for t in range(3):
        assert [got[t, k] for k in range(5)] == pytest.approx(policy.aim(signals[t], 0.5, covariance))
    assert research.aims(rows, 0.5, policy).where("t = 1 and ticker = 2").first()["aim"] == pytest.approx(float(policy.aim(signals[1], 0.5)[2]))


def test_aim_solves_for_factors(spark):
    rng = np.random.default_rng(2)
    own, loads, signals = rng.uniform(1, 4, 7), rng.standard_normal((7, 3)), rng.standard_normal((2, 7))
    own_rows = spark.createDataFrame([(k, float(own[k])) for k in range(7)], "ticker long, value double")
    load_rows = spark.createDataFrame([(k, f"f{j}", float(loads[k, j])) for k in range(7) for j in range(3)], "ticker long, factor string, load double")
    covariance, policy = research.Factors(own_rows, load_rows), execution.Policy(risk=2.0)
    held = [(t, k) for t in range(2) for k in range(7) if t == 0 or k not in (2, 5)]  # a date's own names only
    rows = spark.createDataFrame([(t, k, float(signals[t, k])) for t, k in held], "t int, ticker long, signal double")
    aim = research.aims(rows, 0.5, policy, covariance)
    got = {(r["t"], r["ticker"]): r["aim"] for r in aim.collect()}
    image = {(r["t"], r["ticker"]): r["image"] for r in covariance.times(aim).collect()}
    assert got.keys() == image.keys() == set(held)
    for t in range(2):
        there = [k for s, k in held if s == t]
        whole = np.diag(own[there]) + loads[there] @ loads[there].T
        assert [got[t, k] for k in there] == pytest.approx(policy.aim(signals[t, there], 0.5, whole))
        assert [image[t, k] * policy.risk for k in there] == pytest.approx(signals[t, there] * policy.aim_weight(0.5))


def test_factor_aims_make_no_pairs_of_names(spark):
    """Of 100,000 names there would be 10 thousand million pairs."""
    rows = spark.range(200_000).select((F.col("id") % 2).cast("int").alias("t"), F.floor(F.col("id") / 2).alias("ticker"), ((F.col("id") * 7919) % 101 / 50.0 - 1).alias("signal"))
    covariance = research_queries.factor_covariance(rows)
    aim = research.aims(rows, 0.65, execution.Policy(), covariance).cache()
    off = covariance.times(aim).join(rows, ["t", "ticker"]).agg(F.count(F.lit(1)), F.max(F.abs(F.col("image") - F.col("signal") * execution.Policy().aim_weight(0.65)))).first()
    assert off[0] == 200_000 and off[1] < 1e-10


def test_broad_universe(spark):
    rows = [(D[k], "AA", 10.0 + k, 5.0) for k in range(30)] + [(D[k], "BB", 20.0, 5.0) for k in range(20)] + [(D[k], "CC", 1.0, 1.0) for k in range(3)]
    out = research.broad_universe(spark.createDataFrame(rows, "date date, ticker string, close double, volume double"))
    assert {r[0] for r in out.select("ticker").distinct().collect()} == {"AA", "BB"}
    last = out.where("ticker = 'BB' and close is not null").orderBy(F.desc("t")).first()
    assert last["close"] == pytest.approx(14.0)


def test_weights_of_one_day_keep_the_last(spark):
    days = spark.createDataFrame([(D[1],), (D[3],)], "date date")
    weights = spark.createDataFrame([(D[0], 1, 0.1), (D[1], 1, 0.2), (D[2], 1, 0.3), (D[3], 1, 0.4)], "date date, ticker long, w double")
    assert {(r["date"], r["w"]) for r in research.to_daily(weights, days).collect()} == {(D[1], 0.3), (D[3], 0.4)}


def grid(spark, names, months):
    return spark.range(names).withColumnRenamed("id", "ticker").crossJoin(spark.range(months).select(F.col("id").cast("int").alias("t")))


def test_expanding_weights_by_each_score(spark):
    panel = research.simulated_universe(grid(spark, 12, 46), seed=3).select("t", F.date_add(F.lit(D[0]), F.col("t") * 31).alias("date"), "ticker", "close", F.lit(10.0).alias("volume"), (F.col("close") * 10).alias("dv")).cache()
    held = {s: {(r["t"], r["ticker"]): r["w"] for r in model.model_weights(panel, min_train=18, last=10_000, min_names=2, seeds=1, trees=2, score=s).collect()} for s in ("srp",)}
    assert all(min(t for t, _ in h) == 36 and any(h.values()) for h in held.values())


def test_simulated_expectations_decay(spark):
    wide = research.simulated_universe(grid(spark, 200, 60)).toPandas().pivot(index="t", columns="ticker", values="expected").to_numpy()
    x, y = wide[:-1].ravel(), wide[1:].ravel()
    assert np.corrcoef(x, y)[0, 1] == pytest.approx(0.65, abs=0.03) and wide.std() == pytest.approx(0.005, rel=0.05)


@pytest.mark.parametrize("phi", [0.65, 0.05, 0.99])
def test_simulated_expectations_of_long_panels(spark, phi):
    """3,000 months: powers of phi over the whole panel would overflow."""
    rows = {(r["ticker"], r["t"]): r["expected"] for r in research.simulated_universe(grid(spark, 2, 3_000), phi=phi).collect()}
    shocks = grid(spark, 2, 3_000).select("t", "ticker", research._normal(0, "a", F.col("ticker"), F.col("t")).alias("s")).toPandas().pivot(index="t", columns="ticker", values="s").to_numpy() * 0.005
    held = shocks[0].copy()
    for t in range(3_000):
        held = phi * held + np.sqrt(1 - phi * phi) * shocks[t] if t else held
        assert [rows[k, t] for k in range(2)] == pytest.approx(held, abs=1e-9)


def test_a_panel_scans_its_lines_once(spark, tmp_path):
    lines = spark.createDataFrame([(k % 3, datetime.datetime(2000, 1 + k % 5, 3), 10.0, 5.0) for k in range(40)], "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = tables.month_panel(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "lineitem" not in plan and tables.month_panel(spark, str(tmp_path)).count() == 15


def test_edges_and_lines(spark):
    rows = spark.createDataFrame([(k,) for k in range(9)], "x long")
    assert sorted((r["place"], r["x"]) for r in research.edges(rows, ["x"], 2).collect()) == [("head", 0), ("head", 1), ("tail", 7), ("tail", 8)]


def test_panels_shuffle_facts_only(spark):
    """Cells are made after the one shuffle, by ticker; a path through them needs no other before it is written."""
    facts = spark.createDataFrame([(k, D[0] if k == 0 else D[(k * 7) % 5 + 1], float(k)) for k in range(50)], "ticker long, date date, close double")
    plan = returns.simple_returns(panel.densify(settled(facts, "facts")), fill="pad")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_panels_of_odd_facts(spark):
    """Facts of one cell twice, names or dates that are missing, names with one fact only."""
    rows = [("a", D[1], 1.0), ("a", D[1], 2.0), ("a", D[3], None), ("b", D[0], 3.0), ("c", D[4], 4.0), (None, D[2], 5.0), (None, D[2], 6.0), ("d", None, 7.0), ("d", None, 8.0), ("a", None, 9.0)]
    facts = settled(spark.createDataFrame(rows, "ticker string, date date, close double"), "odd")
    got = [tuple(r) for r in panel.densify(facts).select("t", "date", "ticker", "close").collect()]
    grid = facts.select("ticker").distinct().crossJoin(panel.calendar(facts))
    wanted = [tuple(r) for r in grid.join(facts, ["ticker", "date"], "left").select("t", "date", "ticker", "close").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted)) and len(got) == 31
