"""Weights from signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_ticker
from ..sources.scratch import merged, settled
from . import ranks


def long_short(signals: DataFrame, q: float = 0.10, *, min_names: int = 20, short: bool = True, shortable: DataFrame | None = None) -> DataFrame:
    """``t, date, ticker, w``: +1/n for the n best of a date, then -1/n for the n worst, n a share ``q`` of all with a signal.

    Dates with fewer than ``min_names`` signals are left out. With ``shortable(t, ticker, shortable)``, only such names
    are sold, n being unchanged. Ties go to the smaller ticker. A name that is both is sold.
    """
    known = signals.where(F.col("signal").isNotNull()).select("t", "date", "ticker", "signal")
    may = F.lit(True)
    if shortable is not None:
        known, may = known.join(merged(shortable.select("t", "ticker", F.col("shortable").alias("_may"))), ["t", "ticker"], "left"), F.coalesce("_may", F.lit(False))
    known = settled(known.withColumn("_may", may), "known")
    ranked = both_ends(ranks.with_sizes(known, "_size").where(F.col("_size") >= min_names), "signal", F.col("_may"))
    n = F.greatest(F.lit(1), F.floor(F.col("_size") * q))
    weight = F.when(F.lit(short) & (F.col("_worst") <= n), -1 / n).when(F.col("_best") <= n, 1 / n).otherwise(F.lit(0.0))
    return ranked.select("t", "date", "ticker", weight.alias("w"))


def both_ends(frame: DataFrame, value: str, may: Column | None = None) -> DataFrame:
    """``frame`` with ``_best`` and ``_worst``: places from either end, the latter among ``may``; ties go to the smaller ticker at both."""
    largest = ranks.most_rows(frame)
    ranked = ranks.placed(frame, value, "_best", descending=True, largest=largest)
    return ranks.placed(ranked if largest <= ranks.RANGE else settled(ranked, "best"), value, "_worst", among=may, largest=largest)


def guarded(signals: DataFrame, q: float = 0.05) -> DataFrame:
    """As :func:`long_short`, but n is a share of all names, with or without a signal, and a date needs 2n signals."""
    sized = ranks.with_sizes(ranks.with_sizes(settled(signals.select("t", "date", "ticker", "signal"), "signals"), "_all"), "_valid", F.col("signal"))
    n = F.greatest(F.lit(1), F.floor(F.col("_all") * q))
    ranked = both_ends(sized.where(F.col("_valid") >= 2 * n), "signal")
    weight = F.when(F.col("_worst") <= n, -1 / n).when(F.col("_best") <= n, 1 / n).otherwise(F.lit(0.0))
    return ranked.select("t", "date", "ticker", weight.alias("w"))


def spread_returns(scored: DataFrame, q: float = 0.10) -> DataFrame:
    """``t, long_short, long_leg`` from ``scored(t, ticker, score, fwd)``: mean returns of the best share, less that of the worst."""
    known = settled(scored.where(F.col("score").isNotNull() & F.col("fwd").isNotNull()).select("t", "ticker", "score", "fwd"), "scored")
    ranked = ranks.with_sizes(both_ends(known, "score"), "_size")
    n = F.greatest(F.lit(1), F.floor(F.col("_size") * q))
    top, bottom = F.avg(F.when(F.col("_best") <= n, F.col("fwd"))), F.avg(F.when(F.col("_worst") <= n, F.col("fwd")))
    return ranked.groupBy("t").agg((top - bottom).alias("long_short"), top.alias("long_leg"))


def turnover_detail(weights: DataFrame) -> DataFrame:
    """``t, turnover``: the sum of all changes of weights from one date to the next, not halved; from the second date on."""
    change = F.abs(F.col("w") - F.lag("w").over(by_ticker()))
    return weights.withColumn("_c", change).groupBy("t").agg(F.sum("_c").alias("turnover")).where(F.col("turnover").isNotNull())
