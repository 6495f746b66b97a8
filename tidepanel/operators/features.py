"""Features at month t from rows up to t - 1, for all months in one pass of windows by ticker and one by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, compounded, ratio, rows
from ..sources.scratch import merged, settled
from . import ranks

#: Momentum windows in months.
MOMENTUM = (1, 3, 6, 9, 12, 18)
#: The first month at which all windows are full.
FIRST = max(MOMENTUM) + 1


def momentum(returns: DataFrame) -> DataFrame:
    """``mom1`` is last month's return; ``mom{m}`` compounds the m - 1 months before it."""
    out = {f"mom{m}": F.lag("ret", 1).over(by_ticker()) if m == 1 else compounded(F.col("ret"), -m, -2) for m in MOMENTUM}
    return returns.withColumns(out)


def dynamics(returns: DataFrame) -> DataFrame:
    """``accel``: recent half-year against the one before; ``vol``: deviation of 11 months; ``pos``: share of up months in them, missing ones not up."""
    span = rows(-12, -2)
    up = F.sum(F.when(F.col("ret") > 0, 1).otherwise(0)).over(span) / F.count(F.lit(1)).over(span)
    return returns.withColumns({"accel": compounded(F.col("ret"), -6, -2) - compounded(F.col("ret"), -12, -7), "vol": F.stddev_samp("ret").over(span), "pos": up})


def size_decile(panel: DataFrame) -> DataFrame:
    """``size_decile`` 1 to 10 by last month's size; a missing size is in the middle, 5."""
    lagged = settled(panel.withColumn("_size", F.lag("dv", 1).over(by_ticker())), "sizes")
    ranked = ranks.percent_rank_ties(lagged, "_size", "_share")
    return ranked.withColumn("size_decile", (F.floor(F.coalesce("_share", F.lit(0.5)) * 9.999) + 1).cast("int")).drop("_size", "_share")


def standardised(frame: DataFrame, names: list[str]) -> DataFrame:
    """``z{name}`` across tickers, the sample deviation raised by 1e-10, and ``m{name}``, the cross-section's mean, for each name."""
    frame = settled(frame, "raw")  # for the months' figures, and for the rows
    figures = frame.groupBy("t").agg(*[F.avg(n).alias(f"m{n}") for n in names], *[F.stddev_samp(n).alias(f"_s{n}") for n in names])
    joined = frame.join(F.broadcast(figures), "t")  # one row a date
    return joined.withColumns({f"z{n}": (F.col(n) - F.col(f"m{n}")) / (F.col(f"_s{n}") + 1e-10) for n in names}).drop(*[f"_s{n}" for n in names])


def feature_names(ffd: tuple[int, ...] = ()) -> list[str]:
    raw = [f"mom{m}" for m in MOMENTUM] + ["accel", "vol", "pos"] + [f"ffd{m}" for m in ffd]
    return [f"{p}{n}" for n in raw for p in "zm"] + [f"size_{s}" for s in range(1, 11)]


def feature_matrix(returns: DataFrame, ffd: DataFrame | None = None, *, first: int = FIRST) -> DataFrame:
    """``t, date, ticker`` and :func:`feature_names` for rows from ``first`` on in which nothing is missing."""
    frame = size_decile(dynamics(momentum(returns)))
    windows: tuple[int, ...] = ()
    if ffd is not None:
        windows = tuple(sorted(int(c[3:]) for c in ffd.columns if c.startswith("ffd")))
        frame = settled(frame, "dynamics").join(merged(ffd.select("t", "ticker", *[f"ffd{m}" for m in windows])), ["t", "ticker"], "left")
        frame = settled(frame.withColumns({f"ffd{m}": F.lag(f"ffd{m}", 1).over(by_ticker()) for m in windows}), "lagged")
    raw = [f"mom{m}" for m in MOMENTUM] + ["accel", "vol", "pos"] + [f"ffd{m}" for m in windows]
    frame = standardised(frame.where(F.col("t") >= first), raw)
    dummies = {f"size_{s}": (F.col("size_decile") == s).cast("double") for s in range(1, 11)}
    names = feature_names(windows)
    return frame.withColumns(dummies).select("t", "date", "ticker", *names).dropna(subset=names)


def price_momentum(panel: DataFrame, lookback: int = 12, skip: int = 1) -> DataFrame:
    """``signal``: the price ratio over ``lookback`` months, skipping the last ``skip``, standardised; null where the cross-section has no spread."""
    raw = panel.withColumn("_raw", ratio(F.lag("close", skip).over(by_ticker()), F.lag("close", skip + lookback).over(by_ticker())) - 1)
    raw = settled(raw, "momentum")
    figures = raw.groupBy("t").agg(F.avg("_raw").alias("_mean"), F.stddev_samp("_raw").alias("_spread"))
    joined = raw.join(F.broadcast(figures), "t")  # one row a date
    return joined.withColumn("signal", ratio(F.col("_raw") - F.col("_mean"), F.col("_spread"))).drop("_raw", "_mean", "_spread")


def decile_labels(returns: DataFrame) -> DataFrame:
    """``t, ticker, ret, label`` of the rows with a return: 0 for the best tenth of the month, 9 for the worst; ties by ticker."""
    known = settled(returns.where(F.col("ret").isNotNull()).select("t", "ticker", "ret"), "known")
    ranked = ranks.with_sizes(ranks.placed(known, "ret", "_place"), "_size")
    tenth = F.floor((F.col("_place") - 1) * 10 / F.col("_size"))
    return ranked.select("t", "ticker", "ret", (9 - F.least(tenth, F.lit(9))).cast("int").alias("label"))


def class_stats(labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, k, mu, sigma2`` of each of the ten labels; a label without rows has 0 and 1e-4."""
    spark = labels.sparkSession
    own = labels.groupBy(*by, F.col("label").alias("k")).agg(F.avg("ret").alias("mu"), F.var_samp("ret").alias("sigma2"))
    grid = spark.range(10).select(F.col("id").cast("int").alias("k"))
    if by:
        grid = labels.select(*by).distinct().crossJoin(F.broadcast(grid))  # ten rows
    return grid.join(own, [*by, "k"], "left").select(*by, "k", F.coalesce("mu", F.lit(0.0)).alias("mu"), F.coalesce("sigma2", F.lit(1e-4)).alias("sigma2"))
