"""Who may be traded, and at what cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clipped, rows
from ..sources.scratch import merged, settled
from . import ranks

#: Least trailing dollar volume and one-way cost, or annual borrow fee, from liquid to illiquid.
COST_TIERS = ((1e9, 0.0005), (1e8, 0.0010), (1e7, 0.0025), (1e6, 0.0060), (0.0, 0.0150))
BORROW_TIERS = ((1e9, 0.0025), (1e8, 0.0100), (1e7, 0.0500), (1e6, 0.2500), (0.0, 0.5000))


def tiered(volume: Column, tiers: Sequence[tuple[float, float]], lookback: int = 3) -> Column:
    """The rate of the tier that the trailing mean of dollar volume reaches; without volume, the worst."""
    mean = F.avg(volume).over(rows(-(lookback - 1), 0))
    ordered = sorted(tiers, reverse=True)
    rate = F.lit(ordered[-1][1])
    for least, value in reversed(ordered):
        rate = F.when(mean >= least, value).otherwise(rate)
    return rate


def tiered_costs(panel: DataFrame, tiers: Sequence[tuple[float, float]] = COST_TIERS, lookback: int = 3, name: str = "rate") -> DataFrame:
    return panel.select("t", "date", "ticker", tiered(F.col("dv"), tiers, lookback).alias(name))


def align_rates(panel: DataFrame, rates: DataFrame | float) -> DataFrame:
    """``t, date, ticker, rate``: a scalar everywhere, or rates carried forward by ticker, missing ones at the worst rate of all."""
    grid = panel.select("t", "date", "ticker")
    if not isinstance(rates, DataFrame):
        if rates < 0:
            raise ValueError("a rate can't be negative")
        return grid.withColumn("rate", F.lit(float(rates)))
    worst = rates.agg(F.max("rate").alias("_worst"))
    known = grid.join(merged(rates.select("date", "ticker", "rate")), ["date", "ticker"], "left").crossJoin(F.broadcast(worst))  # a single row
    filled = F.coalesce(F.last("rate", ignorenulls=True).over(rows(None, 0)), F.col("_worst"))
    return known.select("t", "date", "ticker", filled.alias("rate"))


def eligibility(panel: DataFrame, *, min_price: float = 5.0, min_coverage: float = 0.70, window: int = 36, min_history: int = 12, min_percent: float = 0.0, min_volume: float = 5e6, short_min_volume: float = 25e6) -> DataFrame:
    """``t, date, ticker, eligible, shortable``, from rows up to t only."""
    span = rows(-(window - 1), 0)
    valid, good = F.col("close").isNotNull().cast("int"), F.coalesce(F.col("close") > min_price, F.lit(False)).cast("int")
    enough = F.count(F.lit(1)).over(span) >= min_history  # counts rows, with or without a price
    counted = panel.withColumns({"_valid": F.when(enough, F.sum(valid).over(span)), "_good": F.when(enough, F.sum(good).over(span)), "_dv": F.avg("dv").over(rows(-2, 0))})
    coverage = F.col("_good") / F.greatest(F.col("_valid"), F.lit(1))
    base = (coverage >= min_coverage) & (F.col("close") > min_price) & (F.col("_valid") >= min_history)
    if min_percent > 0:
        counted = ranks.percent_rank_ties(settled(counted, "counted"), "_dv", "_share")
        base = base & (F.col("_share") >= min_percent)
    if min_volume > 0:
        base = base & (F.col("_dv") >= min_volume)
    short = base & (F.col("_dv") >= short_min_volume)
    return counted.select("t", "date", "ticker", F.coalesce(base, F.lit(False)).alias("eligible"), F.coalesce(short, F.lit(False)).alias("shortable"))


def cost_coefficients(panel: DataFrame, base_bps: float = 10.0, exponent: float = -0.5) -> DataFrame:
    """``cost``: a coefficient that falls with dollar volume relative to the month's median; missing ones at the highest of all."""
    panel = settled(panel.select("t", "date", "ticker", "dv"), "volumes")
    medians = ranks.quantiles(panel, "dv", (0.5,), ("_median",))
    relative = clipped(F.col("dv") / F.col("_median"), 0.01, float("inf"))
    priced = panel.join(F.broadcast(medians), "t").withColumn("cost", F.pow(relative, F.lit(exponent)) * (base_bps / 1e4))  # one row a date
    worst = priced.agg(F.max("cost").alias("_worst"))
    return priced.crossJoin(F.broadcast(worst)).select("t", "date", "ticker", F.coalesce("cost", "_worst").alias("cost"))
