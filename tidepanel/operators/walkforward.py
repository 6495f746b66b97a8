"""Walk-forward blocks: a signal of each training slice is held over the test slice after it."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio


def blocks(panel: DataFrame, train: int, test: int) -> DataFrame:
    """``block, start, stop``: test slices of ``test`` rows after at least ``train`` rows; one row a block."""
    if train <= 0 or test <= 0:
        raise ValueError("train and test must be positive")
    last = panel.agg(F.max("t").alias("_last")).where(F.col("_last").isNotNull())
    starts = last.select("_last", F.posexplode(F.sequence(F.lit(train), F.greatest(F.col("_last"), F.lit(train)), F.lit(test))).alias("block", "start")).where("start <= _last")
    return starts.select("block", F.col("start").cast("int").alias("start"), F.least(F.col("start") + test - 1, F.col("_last")).cast("int").alias("stop"))


def training_rows(panel: DataFrame, plan: DataFrame, train: int) -> DataFrame:
    """The panel's rows of each block's training slice; a row is in at most train / test + 1 of them."""
    return panel.join(F.broadcast(plan), (F.col("t") >= F.col("start") - train) & (F.col("t") < F.col("start")))  # one row a block


def by_panes(panel: DataFrame, plan: DataFrame, train: int, test: int, partial: dict[str, Column], merged: dict[str, Column]) -> DataFrame:
    """``block, ticker`` and ``merged`` over each block's training slice, from ``partial`` aggregates of panes.

    Slices begin and end at multiples of the pane's width, the largest that divides ``train`` and ``test``. So rows are
    aggregated once, and only panes, a row each and name, go to every block that holds them.
    """
    width = math.gcd(train, test)
    panes = panel.groupBy("ticker", F.floor(F.col("t") / width).alias("_pane")).agg(*[c.alias(name) for name, c in partial.items()])
    inside = (F.col("_pane") * width >= F.col("start") - train) & (F.col("_pane") * width < F.col("start"))
    return panes.join(F.broadcast(plan), inside).groupBy("block", "ticker").agg(*[c.alias(name) for name, c in merged.items()])  # one row a block


def best_momentum(panel: DataFrame, plan: DataFrame, train: int, test: int) -> DataFrame:
    """``block, ticker, w``: weight 1 for each name whose price grew most over the training slice."""
    priced = F.col("close").isNotNull()
    ends = {"_first": F.min(F.when(priced, F.struct("t", "close"))), "_last": F.max(F.when(priced, F.struct("t", "close")))}
    whole = {"_first": F.min("_first"), "_last": F.max("_last")}
    edge = by_panes(panel, plan, train, test, ends, whole).withColumn("_g", ratio(F.col("_last.close"), F.col("_first.close")))
    return edge.where(F.col("_g").isNotNull()).withColumn("_m", F.max("_g").over(W.partitionBy("block"))).where("_g = _m").select("block", "ticker", F.lit(1.0).alias("w"))


def user_signal(slices: DataFrame, signal: Callable[[pd.DataFrame], pd.Series | pd.DataFrame]) -> DataFrame:
    """``block, t, ticker, w`` from a function of the training slice as a frame of ``t`` by ticker; a block is a group.

    A series by ticker holds for the block's whole test slice: ``t`` is null. A frame of ``t`` by ticker names its own dates.
    """
    kind = slices.schema["ticker"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="t", columns="ticker", values="close").sort_index()
        held = signal(wide)
        if isinstance(held, pd.DataFrame):
            out = held.rename_axis(index="t", columns="ticker").reset_index().melt(id_vars="t", var_name="ticker", value_name="w")
        else:
            out = held.rename("w").rename_axis("ticker").reset_index().assign(t=None)
        out["t"] = out["t"].astype("Int32")
        return out.assign(block=frame["block"].iloc[0])[["block", "t", "ticker", "w"]].fillna({"w": 0.0})

    return slices.groupBy("block").applyInPandas(run, f"block int, t int, ticker {kind}, w double")


def held_weights(panel: DataFrame, plan: DataFrame, signals: DataFrame, strategy: str) -> DataFrame:
    """``strategy, t, ticker, w`` on each test date, or on the dates that ``signals`` name in ``t``; of blocks that give the same date weights the last counts; names without a signal have 0."""
    signals = signals if "t" in signals.columns else signals.withColumn("t", F.lit(None).cast("int"))
    given = signals.select("block", F.col("t").alias("_on")).distinct().join(plan, "block", "right")  # one row a block, or a date it names
    whole = given.where(F.col("_on").isNull()).select("block", F.explode(F.sequence("start", "stop")).alias("t"), "_on")
    dates = whole.union(given.where(F.col("_on").isNotNull()).select("block", F.col("_on").alias("t"), "_on"))
    dates = dates.groupBy("t").agg(F.max_by("_on", "block").alias("_on"), F.max("block").alias("block"))
    grid = panel.select("t", "ticker").join(F.broadcast(dates), "t")  # one row a date
    own = signals.select("block", F.col("t").alias("_on"), "ticker", "w")
    joined = grid.alias("g").join(own.alias("s"), (F.col("g.block") == F.col("s.block")) & (F.col("g.ticker") == F.col("s.ticker")) & F.col("g._on").eqNullSafe(F.col("s._on")), "left")
    return joined.select(F.lit(strategy).alias("strategy"), "g.t", "g.ticker", F.coalesce("s.w", F.lit(0.0)).alias("w"))
