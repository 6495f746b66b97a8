"""Ranks and quantiles of a date's names beside pandas, in one range and in many; what a task holds is bounded."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import features, portfolio, ranks
from tidepanel.sources.scratch import settled


def sample_rows():
    rng = random.Random(1)
    rows = [(t, k, rng.choice([None, 1.0, 2.0, rng.random(), rng.random() * 3, -1.0 if t == 2 else rng.random()])) for t, n in enumerate((0, 1, 700, 300, 5)) for k in range(n)]
    rows += [(9, k, 7.5) for k in range(400)]  # all alike
    rows += [(11, k, None) for k in range(300)] + [(12, k, 10.0 ** rng.randint(-300, 300)) for k in range(500)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return settled(spark.createDataFrame(sample_rows(), "t int, ticker long, v double").repartition(3), "rank-rows")


@pytest.fixture(params=["one range", "many ranges"])
def size(request, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE", 100_000 if request.param == "one range" else 50)
    monkeypatch.setattr(ranks, "FEW", 100_000 if request.param == "one range" else 40)
    return request.param


@pytest.mark.parametrize("descending", [False, True])
def test_places(frame, size, descending):
    got = ranks.placed(frame, "v", "p", descending=descending, among=F.col("ticker") % 3 != 0).toPandas()
    held = pd.DataFrame(sample_rows(), columns=["t", "ticker", "v"])
    wanted = held[held.v.notna() & (held.ticker % 3 != 0)].assign(key=lambda f: -f.v if descending else f.v).sort_values(["t", "key", "ticker"])
    wanted["p"] = wanted.groupby("t").cumcount() + 1
    both = got.merge(wanted[["t", "ticker", "p"]], on=["t", "ticker"], how="left")
    assert len(got) == len(held) and both.p_x.fillna(-1).tolist() == both.p_y.fillna(-1).tolist()


def test_percent_ranks(frame, size):
    got = ranks.percent_rank_ties(frame, "v", "p").toPandas()
    held = pd.DataFrame(sample_rows(), columns=["t", "ticker", "v"])
    held["p"] = held.groupby("t").v.rank(pct=True)
    both = got.merge(held[["t", "ticker", "p"]], on=["t", "ticker"])
    assert np.allclose(both.p_x.astype(float), both.p_y, atol=1e-12, equal_nan=True)


def test_quantiles(frame, size):
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = ranks.quantiles(frame, "v", shares, list("abcde")).toPandas().set_index("t")
    for t, group in pd.DataFrame(sample_rows(), columns=["t", "ticker", "v"]).groupby("t"):
        known = group.v.dropna()
        row = [np.nan if x is None else x for x in got.loc[t]]
        assert np.allclose(row, np.quantile(known, shares) if len(known) else [np.nan] * 5, rtol=1e-12, equal_nan=True)
    assert ranks.quantiles(frame.limit(0), "v", [0.5], ["m"]).count() == 0


def test_a_range_is_bounded(spark, monkeypatch):
    """One date holds all rows and a third of them tie: no range, so no task's group, holds more than a few times RANGE rows."""
    monkeypatch.setattr(ranks, "RANGE", 100)
    seen = []
    real = ranks._inside
    monkeypatch.setattr(ranks, "_inside", lambda ranged, *rest: seen.append(ranged) or real(ranged, *rest))
    rng = random.Random(2)
    held = settled(spark.createDataFrame([(0, k, 0.5 if k % 3 == 0 else rng.random()) for k in range(10_000)], "t int, ticker long, v double"), "hot")
    assert ranks.placed(held, "v", "p").agg(F.sum("p")).first()[0] == 10_000 * 10_001 // 2
    assert ranks.percent_rank_ties(held, "v", "p").count() == 10_000
    for ranged in seen:
        assert ranged.groupBy("t", "_range").count().agg(F.max("count")).first()[0] < 500


def test_no_window_holds_a_whole_date(frame):
    signals = frame.select("t", F.lit(None).cast("date").alias("date"), "ticker", F.col("v").alias("signal"))
    scored = frame.select("t", "ticker", F.col("v").alias("score"), F.col("v").alias("fwd"))
    for out in (features.decile_labels(frame.withColumnRenamed("v", "ret")), portfolio.long_short(signals), portfolio.guarded(signals), portfolio.spread_returns(scored)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        specs = re.findall(r"windowspecdefinition\(([^)]*)", plan)
        assert specs and all("_range" in s for s in specs)


def test_few_quantiles_compare_a_row_with_few_cuts(spark, monkeypatch):
    """Two tails of 60,000 rows, a third of them ties: cuts lie around the wanted rows, so each round has a few an interval; many shares still have even ones."""
    monkeypatch.setattr(ranks, "FEW", 500)
    held = settled(spark.range(60_000).select(F.lit(1).alias("t"), F.col("id").alias("ticker"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(((F.col("id") * 7919) % 60_013) / 60_013.0 - 0.5).alias("v")), "tails")
    seen = []
    real = ranks.settled
    monkeypatch.setattr(ranks, "settled", lambda frame, name: seen.append((name, real(frame, name))) or seen[-1][1])
    values = held.toPandas().v
    for shares in ([0.01, 0.99], [k / 40 for k in range(41)]):
        seen.clear()
        got = ranks.quantiles(held, "v", shares, [f"q{k}" for k in range(len(shares))]).first()
        assert np.allclose(list(got)[1:], np.quantile(values, shares), rtol=1e-12)
        if len(shares) == 2:
            rounds = [frame.agg(F.max(F.size("cuts"))).first()[0] for name, frame in seen if name == "cuts"]
            assert 0 < len(rounds) <= 4 and max(rounds) <= 8
