"""Compositions: from archives to panels, from monthly weights to a daily engine, simulated names, and comparisons of scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import rows
from ..sources.scratch import merged, settled
from . import drift, execution, metrics, portfolio, ranks, scoring
from .panel import asof_dates, densify, inject_delisting, min_history, month_end_last
from .returns import clip_returns, model_returns, simple_returns, size_proxy


def archive_panel(daily: DataFrame, *, clip: float = 0.5) -> DataFrame:
    """``t, date, ticker, close, volume, ret, dv`` from daily ``(date, ticker, close, volume)``: month ends, returns within ``clip``, and size."""
    months = settled(month_end_last(daily, ["close", "volume"]), "months")  # for names, calendar and cells
    return size_proxy(clip_returns(simple_returns(densify(months)), -clip, clip))


def broad_universe(records: DataFrame, *, least: int = 12, delist_return: float = -0.30) -> DataFrame:
    """The panel of vendor records: names with enough months, one price after the last of those that stop, size, and returns for models."""
    months = settled(month_end_last(records, ["close", "volume"]), "months")
    panel = inject_delisting(min_history(densify(months), least), delist_return)
    return model_returns(size_proxy(panel))


def to_daily(weights: DataFrame, days: DataFrame) -> DataFrame:
    """``date, ticker, w``: weights moved to the last of ``days`` not after their date; of dates that fall on one day the last counts, and those before the first day go."""
    marks = asof_dates(weights.select("date").distinct(), days.select("date").distinct()).where("mark is not null")
    kept = marks.groupBy("mark").agg(F.max("date").alias("date"))
    return weights.join(F.broadcast(kept), "date").select(F.col("mark").alias("date"), "ticker", "w")  # one row a day


def run_daily(weights: DataFrame, daily: DataFrame, **options) -> DataFrame:
    """The engine on a dense daily panel for ``weights(date, ticker, w)`` of other dates; every name of the panel has a weight on each date of weights."""
    moved = to_daily(weights, daily)
    dates = daily.select("date", "ticker", "t").join(F.broadcast(moved.select("date").distinct()), "date", "left_semi")  # one row a day
    dense = dates.join(merged(moved), ["date", "ticker"], "left").select(F.lit("daily").alias("strategy"), "t", "ticker", F.coalesce("w", F.lit(0.0)).alias("w"))
    return drift.backtest(dense, daily, **options)


def run_trimmed(weights: DataFrame, panel: DataFrame, **options) -> DataFrame:
    """The engine from the first date of weights on, its ordinals counted from there; rates given as tables keep their dates."""
    first = F.broadcast(weights.agg(F.min("t").alias("_first")))  # a single row
    later = lambda frame: frame.crossJoin(first).where(F.col("t") >= F.col("_first")).withColumn("t", (F.col("t") - F.col("_first")).cast("int")).drop("_first")
    known = weights.join(F.broadcast(panel.select("t").distinct()), "t", "left_semi")
    return drift.backtest(later(known), settled(later(panel), "trimmed"), **options)


def compared_scores(probs: DataFrame, stats: DataFrame, bench: DataFrame, q: float = 0.10) -> DataFrame:
    """``strategy, ann, sharpe, max_dd`` of the spread by bench, dpr, ret and srp.

    ``probs(t, ticker, p)``, ``stats(k, mu, sigma2)``, ``bench(t, ticker, signal, fwd)`` with the return that a score of t is for.
    """
    scored = scoring.with_scores(probs, stats).select("t", "ticker", "dpr", F.col("ret_score").alias("ret"), "srp")
    wide = settled(scored.join(merged(bench.select("t", "ticker", F.col("signal").alias("bench"), "fwd")), ["t", "ticker"]), "scores")
    out = None
    for name in ("bench", "dpr", "ret", "srp"):
        spread = portfolio.spread_returns(wide.select("t", "ticker", F.col(name).alias("score"), "fwd"), q)
        line = metrics.performance(spread, "long_short").select(F.lit(name).alias("strategy"), "ann", "sharpe", "max_dd")
        out = line if out is None else out.unionByName(line)
    return out


@dataclass(frozen=True)
class Factors:
    """A covariance of names by common factors: ``own(ticker, value)``, each name's own variance, and ``loads(ticker, factor, load)`` on uncorrelated factors of variance 1."""

    own: DataFrame
    loads: DataFrame

    def times(self, right: DataFrame) -> DataFrame:
        """``t, ticker, image``: the covariance times ``right(t, ticker, aim)`` at each ``t``, among the names that ``t`` has."""
        moved = right.join(self.loads, "ticker")
        sums = moved.groupBy("t", "factor").agg(F.sum(F.col("load") * F.col("aim")).alias("_sum"))
        common = moved.join(F.broadcast(sums), ["t", "factor"]).groupBy("t", "ticker").agg(F.sum(F.col("load") * F.col("_sum")).alias("_common"))  # a row a date and factor
        both = right.join(self.own, "ticker").join(common, ["t", "ticker"], "left")
        return both.select("t", "ticker", (F.col("value") * F.col("aim") + F.coalesce("_common", F.lit(0.0))).alias("image"))

    def solved(self, right: DataFrame) -> DataFrame:
        """``t, ticker, aim`` whose image is ``right(t, ticker, aim)``; null for a name without an own variance.

        With the own variances divided out, what is left at a date is a system as large as there are factors, so the work
        grows with names times factors squared, and no pairs of names are made.
        """
        rows = settled(right.join(self.own, "ticker", "left").select("t", "ticker", (F.col("aim") / F.col("value")).alias("_aim"), (1 / F.col("value")).alias("_inverse")), "divided")
        loads = settled(self.loads.select("ticker", "factor", "load"), "loads")
        pairs = loads.join(loads.select("ticker", F.col("factor").alias("other"), F.col("load").alias("_other")), "ticker")
        square = rows.join(pairs, "ticker").groupBy("t", "factor", "other").agg(F.sum(F.col("load") * F.col("_other") * F.col("_inverse")).alias("v"))
        exposed = rows.join(loads, "ticker")
        sums = exposed.groupBy("t", "factor").agg(F.sum(F.col("load") * F.col("_aim")).alias("v"))
        kind = loads.schema["factor"].dataType
        entries = square.unionByName(sums.withColumn("other", F.lit(None).cast(kind)))
        found = settled(entries.groupBy("t").applyInPandas(_small_system, f"t int, factor {kind.simpleString()}, y double"), "systems")
        common = exposed.join(F.broadcast(found), ["t", "factor"]).groupBy("t", "ticker").agg(F.sum(F.col("load") * F.col("y")).alias("_common"))  # a row a date and factor
        out = rows.join(common, ["t", "ticker"], "left")
        return out.select("t", "ticker", (F.col("_aim") - F.coalesce("_common", F.lit(0.0)) * F.col("_inverse")).alias("aim"))


def _small_system(frame: pd.DataFrame) -> pd.DataFrame:
    """Solves one date's system of factors: the unit matrix and ``v`` of pairs, against ``v`` of the rows without ``other``."""
    right = frame[frame["other"].isna()].set_index("factor")["v"].sort_index()
    square = frame[frame["other"].notna()].pivot(index="factor", columns="other", values="v").reindex(index=right.index, columns=right.index).fillna(0.0)
    y = np.linalg.solve(np.eye(len(right)) + square.to_numpy(float), right.fillna(0.0).to_numpy(float))
    return pd.DataFrame({"t": frame["t"].iloc[0], "factor": right.index, "y": y})


def aims(signals: DataFrame, phi: float, policy: execution.Policy, covariance: DataFrame | Factors | None = None) -> DataFrame:
    """``t, ticker, aim`` for ``signals(t, ticker, signal)``: discounted, and with a covariance, ``(ticker, other, value)`` or :class:`Factors`, the mean-variance solution among a date's names."""
    scaled = signals.select("t", "ticker", (F.coalesce("signal", F.lit(0.0)) * policy.aim_weight(phi) / policy.risk).alias("aim"))
    if isinstance(covariance, Factors):
        return covariance.solved(scaled)
    return scaled if covariance is None else solved(covariance, scaled)


def solved(matrix: DataFrame, right: DataFrame, *, tolerance: float = 1e-13, rounds: int = 1_000) -> DataFrame:
    """``t, ticker, aim`` with ``matrix(ticker, other, value)``, symmetric and positive, times it being ``right(t, ticker, aim)`` at each ``t``, among the names that ``t`` has.

    Conjugate gradients, all dates at once: a round is a join with the matrix and a sum, so the matrix may have any size and
    stay as sparse as it is. It ends when the residual's norm is ``tolerance`` of the right side's at every date; if it
    isn't after ``rounds``, that is an error.
    """
    matrix = settled(matrix.where("value != 0").select(F.col("ticker").alias("_row"), F.col("other").alias("ticker"), "value"), "matrix")
    state = right.select("t", "ticker", F.lit(0.0).alias("x"), F.col("aim").alias("r"), F.col("aim").alias("p"))
    state = settled(state, "state")
    norms = settled(state.groupBy("t").agg(F.sum(F.col("r") * F.col("r")).alias("rr")), "norms")  # a row a date, as all tables that are broadcast here
    limit = settled(norms.select("t", (F.col("rr") * tolerance**2).alias("_limit")), "limits")
    open_ = lambda norms: norms.join(F.broadcast(limit), "t").where((F.col("rr") > F.col("_limit")) & (F.col("rr") > 0)).select("t")
    for _ in range(rounds):
        left = settled(open_(norms), "open")
        if left.isEmpty():
            return state.select("t", "ticker", F.col("x").alias("aim"))
        moving = state.where("p != 0").join(F.broadcast(left), "t", "left_semi")
        image = moving.select("t", "ticker", "p").join(matrix, "ticker").groupBy("t", F.col("_row").alias("ticker")).agg(F.sum(F.col("value") * F.col("p")).alias("q"))
        state = settled(state.join(image, ["t", "ticker"], "left").withColumn("q", F.coalesce("q", F.lit(0.0))), "image")
        steps = state.groupBy("t").agg(F.sum(F.col("p") * F.col("q")).alias("pq")).join(F.broadcast(norms), "t").join(F.broadcast(left), "t")
        steps = settled(steps.select("t", (F.col("rr") / F.col("pq")).alias("_step"), F.col("rr").alias("_before")), "steps")
        step = F.coalesce("_step", F.lit(0.0))
        state = state.join(F.broadcast(steps), "t", "left").withColumns({"x": F.col("x") + step * F.col("p"), "r": F.col("r") - step * F.col("q")})
        state = settled(state.drop("q", "_step"), "moved")
        norms = settled(state.groupBy("t").agg(F.sum(F.col("r") * F.col("r")).alias("rr")), "norms")
        turn = F.coalesce(F.col("rr") / F.col("_before"), F.lit(0.0))
        state = state.join(F.broadcast(norms), "t").withColumn("p", F.col("r") + turn * F.col("p")).select("t", "ticker", "x", "r", "p")
    raise ArithmeticError(f"conjugate gradients did not end in {rounds} rounds; is the matrix symmetric and positive?")


def _normal(seed: int, stream: str, *ids: Column) -> Column:
    """A normal number from a digest of the ids: the same in every run, whatever the partitions."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[i.cast("string") for i in ids]).cast("binary"))
    part = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    return F.sqrt(-2 * F.log(part(1))) * F.cos(2 * math.pi * part(9))


def simulated_universe(grid: DataFrame, *, seed: int = 0, phi: float = 0.65, alpha: float = 0.005, noise: float = 0.06, market: float = 0.04, drift_rate: float = 0.005) -> DataFrame:
    """``t, ticker, expected, ret, close`` for the names and months of ``grid(t, ticker)``: an expected return that is an AR(1) series, a common and an own shock; prices from 100.

    The series is summed in spans short enough that powers of ``phi`` stay within 1e12; what lies two spans back counts below 1e-12.
    """
    span = max(1, math.ceil(math.log(1e-12) / math.log(phi)))
    scale = alpha * math.sqrt(1 - phi * phi)
    shock = F.when(F.col("t") == 0, F.lit(alpha)).otherwise(F.lit(scale)) * _normal(seed, "a", F.col("ticker"), F.col("t"))
    within = (F.col("t") % span).cast("double")
    grid = grid.select("t", "ticker").withColumns({"_span": F.floor(F.col("t") / span), "_s": shock * F.pow(F.lit(phi), -within)})
    by_span = W.partitionBy("ticker", "_span").orderBy("t")
    grid = grid.withColumn("_own", F.sum("_s").over(by_span.rowsBetween(W.unboundedPreceding, 0)) * F.pow(F.lit(phi), within))
    ends = grid.groupBy("ticker", "_span").agg(F.max_by("_own", "t").alias("_end"))
    ends = ends.select("ticker", (F.col("_span") + 1).alias("_span"), "_end")
    grid = grid.join(ends, ["ticker", "_span"], "left")
    expected = F.col("_own") + F.coalesce("_end", F.lit(0.0)) * F.pow(F.lit(phi), within + 1)
    ret = drift_rate + F.col("expected") + market * _normal(seed, "m", F.col("t")) + noise * _normal(seed, "n", F.col("ticker"), F.col("t"))
    grid = grid.withColumn("expected", expected).withColumn("ret", F.greatest(ret, F.lit(-0.95)))
    return grid.select("t", "ticker", "expected", "ret", (100 * F.product(1 + F.col("ret")).over(rows(None, 0))).alias("close"))


def distribution(frame: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, sample deviation, least, quartiles and largest of a column."""
    frame = settled(frame.select(F.lit(0).alias("t"), "ticker", value), "values")
    names = ("q25", "q50", "q75")
    whole = frame.groupBy("t").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("largest"))
    return whole.join(ranks.quantiles(frame, value, (0.25, 0.5, 0.75), names), "t").select("n", "mean", "std", "least", *names, "largest")


def edges(frame: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first and the last ``n`` rows in an order, ``place`` telling which."""
    first = frame.orderBy(*order).limit(n).withColumn("place", F.lit("head"))
    return first.unionByName(frame.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("place", F.lit("tail")))


def yearly_table(curve: DataFrame, strategies: list[str]) -> DataFrame:
    """``year`` and a column for each strategy: its return of the year."""
    return metrics.yearly(curve).groupBy("year").pivot("strategy", strategies).agg(F.first("ret"))


def metric_line(figures: DataFrame) -> DataFrame:
    """``strategy, line``: the main figures of each strategy in one line of text."""
    parts = (("ann_return", "Return %.2f%%", 100.0), ("ann_vol", "vol %.2f%%", 100.0), ("sharpe", "Sharpe %.2f", 1.0), ("max_drawdown", "drawdown %.2f%%", 100.0), ("ann_turnover", "turnover %.0f%%", 100.0))
    return figures.select("strategy", F.concat_ws(", ", *[F.format_string(form, F.col(c) * scale) for c, form, scale in parts]).alias("line"))
