"""The backtest engine: executed targets drift with returns, and pay for trades and for borrowed names.

Between two executions holdings only grow with their returns, so a segment has a closed form: with growth G of a name
since the execution and V = 1 + sum w (G - 1), its weight is w G / V and the portfolio's return V / V before. So the
engine is windows by ticker and sums by date, without a loop over dates. It holds while V stays positive. At a date
where it doesn't, a portfolio is lost: its weights don't drift, and go on from there. :func:`restarted` begins a new
segment after each such date, of the weights before it, round by round until no segment has one inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import bounded, merged, settled
from .panel import asof_weights, checked_prices
from .returns import simple_returns
from .universe import align_rates

CAP = 0.999


def schedule(weights: DataFrame, panel: DataFrame, *, lag: int = 1, signal_dates: DataFrame | None = None) -> DataFrame:
    """``strategy, t, ticker, target``: signals of t executed at t + lag + 1 if that is within the panel; names without a price there get 0.

    ``weights(strategy, t, ticker, w)`` holds all names of a date that matter; ``signal_dates(t)`` restricts the dates.
    """
    if lag < 0:
        raise ValueError("lag must not be negative")
    rows = weights if signal_dates is None else weights.join(F.broadcast(signal_dates.select("t").distinct()), "t", "left_semi")  # one row a date
    moved = rows.select("strategy", (F.col("t") + lag + 1).cast("int").alias("t"), "ticker", "w")
    priced = moved.join(merged(panel.select("t", "ticker", "close")), ["t", "ticker"])
    return priced.select("strategy", "t", "ticker", F.when(F.col("close").isNotNull(), F.coalesce("w", F.lit(0.0))).otherwise(F.lit(0.0)).alias("target"))


def _grid(targets: DataFrame, panel: DataFrame, cost, borrow) -> DataFrame:
    """The panel for each strategy, with returns, rates, targets, whether a segment begins at the date, and whether the date executes.

    A target whose ``restart`` is true begins a segment without being executed.
    """
    frame = simple_returns(panel.select("t", "date", "ticker", "close"))
    frame = frame.join(merged(align_rates(panel, cost).select("t", "ticker", F.col("rate").alias("tc"))), ["t", "ticker"])
    frame = frame.join(merged(align_rates(panel, borrow).select("t", "ticker", F.col("rate").alias("bf"))), ["t", "ticker"])
    again = F.col("restart") if "restart" in targets.columns else F.lit(False)
    begun = targets.groupBy("strategy", "t").agg(F.max((~again).cast("int")).alias("executes")).withColumn("starts", F.lit(1))
    names = targets.select("strategy").distinct()
    frame = frame.crossJoin(F.broadcast(names)).join(F.broadcast(begun), ["strategy", "t"], "left")  # a row a strategy, and a row a strategy and date
    frame = frame.join(merged(targets.select("strategy", "t", "ticker", "target")), ["strategy", "t", "ticker"], "left")
    return frame.withColumns({"executes": F.coalesce("executes", F.lit(0)), "starts": F.coalesce("starts", F.lit(0))})


def positions(targets: DataFrame, panel: DataFrame, cost: DataFrame | float = 0.0, borrow: DataFrame | float = 0.0) -> DataFrame:
    """``strategy, t, date, ticker, before, held, after``: weights before the date's execution, after it, and after its return; and the date's ``v``, ``v0`` and segment."""
    by_name = W.partitionBy("strategy", "ticker").orderBy("t")
    frame = bounded(settled(_grid(targets, panel, cost, borrow), "grid"), "strategy", "ticker")
    frame = frame.withColumn("seg", F.sum("starts").over(by_name.rowsBetween(W.unboundedPreceding, 0)))
    segment = W.partitionBy("strategy", "ticker", "seg").orderBy("t")
    start = F.first(F.coalesce("target", F.lit(0.0))).over(segment.rowsBetween(W.unboundedPreceding, 0))
    growth = F.product(1 + F.coalesce("ret", F.lit(0.0))).over(segment.rowsBetween(W.unboundedPreceding, 0))
    frame = frame.withColumns({"w0": F.when(F.col("seg") > 0, start).otherwise(F.lit(0.0)), "g": growth}).withColumn("g0", F.coalesce(F.lag("g").over(segment), F.lit(1.0)))
    frame = frame.withColumns({"_grown": F.lag(F.col("w0") * F.col("g")).over(by_name), "_entered": F.lag(F.col("w0") * F.col("g0")).over(by_name)})
    frame = settled(frame, "paths")  # for the sums by date, and for the rows
    sums = frame.groupBy("strategy", "t").agg((1 + F.sum(F.col("w0") * (F.col("g") - 1))).alias("v"), (1 + F.sum(F.col("w0") * (F.col("g0") - 1))).alias("v0"))
    by_date = W.partitionBy("strategy").orderBy("t")
    sums = sums.withColumns({"_v": F.lag("v").over(by_date), "_v0": F.lag("v0").over(by_date)})
    frame = frame.join(F.broadcast(settled(sums, "values")), ["strategy", "t"])  # a row a strategy and date
    held = F.col("w0") * F.col("g0") / F.col("v0")
    after = F.when(F.col("v") > 0, F.col("w0") * F.col("g") / F.col("v")).otherwise(held)
    before = F.when(F.col("_v") > 0, F.col("_grown") / F.col("_v")).otherwise(F.col("_entered") / F.col("_v0"))
    return frame.withColumns({"held": held, "after": after, "before": F.coalesce(before, F.lit(0.0))})


def restarted(targets: DataFrame, panel: DataFrame, cost: DataFrame | float = 0.0, borrow: DataFrame | float = 0.0) -> DataFrame:
    """:func:`positions` of strategies that may be lost: each round begins a new segment after the first date of a segment at which the value isn't positive."""
    now = settled(targets.select("strategy", "t", "ticker", "target", F.lit(False).alias("restart")), "targets")
    ends = panel.agg(F.max("t").alias("_end"))
    while True:
        held = positions(now, panel, cost, borrow)
        dates = held.groupBy("strategy", "t").agg(F.max("seg").alias("seg"), F.max("v").alias("v"))
        lost = dates.where("v <= 0 and seg > 0").groupBy("strategy", "seg").agg(F.min("t").alias("t"))
        begun = now.select("strategy", (F.col("t") - 1).alias("t")).distinct()
        lost = lost.join(begun, ["strategy", "t"], "left_anti").crossJoin(F.broadcast(ends)).where(F.col("t") < F.col("_end"))  # a single row
        lost = settled(lost.select("strategy", "t"), "lost")
        if lost.isEmpty():
            return held
        frozen = held.join(F.broadcast(lost), ["strategy", "t"]).select("strategy", (F.col("t") + 1).alias("t"), "ticker", F.col("after").alias("target"), F.lit(True).alias("restart"))  # a row a strategy and segment
        now = settled(now.unionByName(frozen), "targets")


def curve(held: DataFrame, *, freq: float = 252, short_mult: float = 1.5) -> DataFrame:
    """``strategy, t, date, equity, turnover, cost_frac, borrow_frac`` (turnover one way) from :func:`positions`; ``lowest`` is a value since the execution, not positive where the form fails."""
    change = F.abs(F.col("held") - F.col("before"))
    penalty = F.when(F.col("held") < 0, F.lit(short_mult)).otherwise(F.lit(1.0))
    owed = F.when((F.col("held") < 0) & (F.col("t") > 0), -F.col("held") * F.col("bf") / freq).otherwise(F.lit(0.0))
    sums = held.groupBy("strategy", "t", "date").agg(
        F.max("v").alias("v"), F.max("v0").alias("v0"), F.max("executes").alias("executes"),
        F.sum(F.when(F.col("executes") == 1, change).otherwise(F.lit(0.0))).alias("traded"),
        F.sum(F.when(F.col("executes") == 1, change * F.col("tc") * penalty).otherwise(F.lit(0.0))).alias("cost"), F.sum(owed).alias("owed"),
    )
    factors = sums.withColumns({"cost_frac": F.least(F.col("cost"), F.lit(CAP)), "borrow_frac": F.least(F.col("owed"), F.lit(CAP))})
    step = F.when(F.col("t") > 0, F.col("v") / F.col("v0")).otherwise(F.lit(1.0)) * (1 - F.col("cost_frac")) * (1 - F.col("borrow_frac"))
    equity = F.product(step).over(W.partitionBy("strategy").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return factors.withColumn("equity", equity).select("strategy", "t", "date", "equity", (F.col("traded") / 2).alias("turnover"), "cost_frac", "borrow_frac", F.least("v", "v0").alias("lowest"))


def backtest(weights: DataFrame, panel: DataFrame, *, freq: float = 252, lag: int = 1, signal_dates: DataFrame | None = None, cost: DataFrame | float = 0.0, borrow: DataFrame | float = 0.0, short_mult: float = 1.5) -> DataFrame:
    """The curve of each strategy of ``weights(strategy, t, ticker, w)``. Without a strategy and ``t``, :func:`shaped` gives them. Strategies that are ever wiped out are restarted, the others are one closed form."""
    checked_prices(panel)
    weights = weights if {"strategy", "t"} <= set(weights.columns) else shaped(weights, panel)
    targets = schedule(weights, panel, lag=lag, signal_dates=signal_dates)
    curves = settled(curve(positions(targets, panel, cost, borrow), freq=freq, short_mult=short_mult), "curves")  # a row a strategy and date
    lost = settled(curves.where("lowest <= 0").select("strategy").distinct(), "lost")
    if lost.isEmpty():
        return curves.drop("lowest")
    again = curve(restarted(targets.join(F.broadcast(lost), "strategy", "left_semi"), panel, cost, borrow), freq=freq, short_mult=short_mult)  # a row a strategy
    return curves.join(F.broadcast(lost), "strategy", "left_anti").unionByName(again).drop("lowest")


def shaped(weights: DataFrame, panel: DataFrame, strategy: str = "weights") -> DataFrame:
    """``strategy, t, ticker, w`` at every date of the panel from weights by date and ticker, by ticker alone, or, for a panel of one name, by date alone."""
    given = {"date", "ticker"} & set(weights.columns)
    if given == {"ticker"}:
        return hold(panel, weights, strategy)
    if given == {"date"}:
        names = panel.select("ticker").distinct()
        if names.limit(2).count() != 1:
            raise ValueError("weights by date alone need a panel of one name")
        weights = weights.crossJoin(F.broadcast(names))  # a single row
    elif not given:
        raise ValueError("weights need a date, a ticker or both")
    return asof_weights(weights, panel).select(F.lit(strategy).alias("strategy"), "t", "ticker", "w")


def hold(panel: DataFrame, fixed: DataFrame, strategy: str) -> DataFrame:
    """Weights by ticker, the same at every date of the panel; a name without one has 0."""
    grid = panel.select("t", "ticker").join(fixed.select("ticker", "w"), "ticker", "left")
    return grid.select(F.lit(strategy).alias("strategy"), "t", "ticker", F.coalesce("w", F.lit(0.0)).alias("w"))
