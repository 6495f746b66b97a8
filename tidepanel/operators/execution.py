"""Partial adjustment towards an aim portfolio, and the decay of signals that governs it."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import dot
from ..sources.scratch import settled

#: Dates whose scales are found together; and cells of positions, of all runs, that a task holds at a time.
SPAN, CELLS = 128, 500_000


@dataclass(frozen=True)
class Policy:
    """Parameters: risk aversion, cost multiplier, discount rate, gross exposure; and what follows from them."""

    risk: float = 1.0
    cost: float = 2.0
    discount: float = 0.001
    gross: float = 2.0

    @property
    def a(self) -> float:
        b = self.risk + self.cost * self.discount
        return (math.sqrt(b * b + 4 * self.risk * self.cost * (1 - self.discount)) - b) / (2 * (1 - self.discount) * self.cost)

    @property
    def fraction(self) -> float:
        """The share of the way to the aim that is traded at once."""
        return min(max(self.a / self.cost, 0.0), 1.0)

    def aim_weight(self, phi: float) -> float:
        return 1.0 / (1.0 + phi * self.a / self.risk)

    def aim(self, inputs: np.ndarray, phi: float, covariance: np.ndarray | None = None) -> np.ndarray:
        """The aim for an array of signals: discounted, and with a covariance the mean-variance solution."""
        scaled = inputs * self.aim_weight(phi)
        return scaled / self.risk if covariance is None else np.linalg.solve(self.risk * covariance, scaled)


def parameters(decay: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """``decay(phi, ...)`` once for each policy, with ``risk, cost, discount, gross``, the derived ``a`` and ``fraction``, and the aim's weight at each ``phi``."""
    rows = [(p.risk, p.cost, p.discount, p.gross, p.a, p.fraction) for p in policies]
    table = decay.sparkSession.createDataFrame(rows, "risk double, cost double, discount double, gross double, a double, fraction double")
    return decay.crossJoin(F.broadcast(table)).withColumn("aim_weight", 1 / (1 + F.col("phi") * F.col("a") / F.col("risk")))  # a row a policy


def _decay(n: Column, c0: Column, c1: Column) -> Column:
    """The decay of a series of ``n`` known values from its variance and lag-1 autocovariance."""
    return F.when(n < 3, F.lit(0.5)).when(c0 < 1e-15, F.lit(0.0)).otherwise(F.greatest(F.lit(0.01), F.least(F.lit(0.99), c1 / c0)))


def acf1(signals: DataFrame, by: list[str]) -> DataFrame:
    """``by, phi``: the lag-1 autocovariance over the variance of each series ``(by, t, signal)``, each a mean over its own terms.

    Fewer than three values give 0.5, no variance gives 0; else it is kept within 0.01 and 0.99.
    """
    whole = W.partitionBy(*by)
    known = signals.where(F.col("signal").isNotNull()).withColumn("_x", F.col("signal") - F.avg("signal").over(whole))
    known = known.withColumn("_xx", F.col("_x") * F.lag("_x").over(whole.orderBy("t")))
    sums = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("_x") * F.col("_x")).alias("_c0"), F.avg("_xx").alias("_c1"))
    everyone = signals.select(*by).distinct().join(sums, by, "left")
    return everyone.select(*by, _decay(F.coalesce("_n", F.lit(0)), F.col("_c0"), F.col("_c1")).alias("phi"))


def rolling_acf1(signals: DataFrame, window: int = 24) -> DataFrame:
    """``t, phi``: the mean over tickers of :func:`acf1` in the ``window`` dates up to t. ``signals`` is dense in ``t``.

    Rows are shuffled once, by ticker. Each gathers the known values of its own window, at most ``window`` of them, so
    both covariances are taken about the window's mean and lose no digits.
    """
    dates = W.partitionBy("ticker").orderBy("t")
    span = dates.rangeBetween(-(window - 1), 0)
    own = signals.select("t", F.collect_list("signal").over(span).alias("_v"), F.avg("signal").over(span).alias("_mean"), F.min("t").over(dates).alias("_first"))
    own = own.where(F.col("t") - F.col("_first") >= window - 1).withColumn("_n", F.size("_v"))
    centred = own.select("t", "_n", F.transform("_v", lambda x: x - F.col("_mean")).alias("_v"))
    c0 = dot(F.col("_v"), F.col("_v")) / F.col("_n")
    c1 = dot(F.slice("_v", F.lit(2), F.col("_n") - 1), F.slice("_v", F.lit(1), F.col("_n") - 1)) / (F.col("_n") - 1)
    taken = centred.select("t", "_n", F.when(F.col("_n") >= 3, c0).alias("_c0"), F.when(F.col("_n") >= 3, c1).alias("_c1"))
    return taken.groupBy("t").agg(F.avg(_decay(F.col("_n"), F.col("_c0"), F.col("_c1"))).alias("phi"))


def _paths(w: np.ndarray, held: np.ndarray, scales: np.ndarray, pull: np.ndarray, stay: float) -> Iterator[np.ndarray]:
    """Positions before scaling, of one date of a block after the other, from what was ``held`` before it."""
    for t in range(w.shape[1]):
        wanted = stay * held + pull[t] * w[:, t]
        yield wanted
        held = wanted * scales[t]


def _signed_sums(w: np.ndarray, held: np.ndarray, scales: np.ndarray, pull: np.ndarray, stay: float) -> np.ndarray:
    """For each date of a block, the sums over names of their position's sign times what they ``held`` before it and times each date's target."""
    signs = np.sign(np.stack(list(_paths(w, held, scales, pull, stay)), axis=1))
    return signs.T @ np.column_stack([stay * held, w * pull])


def _solved(sums: np.ndarray, stay: float, gross: float) -> np.ndarray:
    """The scale of each date, given the signs: every gross exposure is a sum of ``sums``, weighted by the scales before it."""
    n = len(sums)
    scales, weights = np.ones(n), np.zeros(n + 1)
    weights[0] = 1.0
    for i in range(n):
        weights[i + 1] = 1.0
        size = sums[i] @ weights
        scales[i] = gross / size if size > 0 else 1.0
        weights *= stay * scales[i]
    return scales


def run_policies(targets: DataFrame, policies: dict[str, Policy], phi: DataFrame | float) -> DataFrame:
    """``run, t, ticker, w``: positions of each policy that follow the dense ``targets(t, ticker, w)`` from zero.

    Each step goes the policy's fraction towards the discounted target and is scaled to the gross exposure. ``phi`` is a
    number, or ``(t, phi)`` where dates without one keep the last known, at first 0.65.

    Only one scale a run and date ties names together. Given each position's sign, all gross exposures are sums over
    names that don't depend on the scales, so these follow one from the other; with them come new signs, and so on until
    the scales stay. A date's scale is right once those before it are, so this ends, mostly after a few turns. Rows are
    spread by ticker and by blocks of ``SPAN`` dates; what a name holds at a block's start is written, so that each block is
    gone through once. To the driver come dates, and for a block a square of sums a run.
    """
    kind = targets.schema["ticker"].dataType.simpleString()
    targets = settled(targets.select("t", "ticker", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w")), "targets")
    dates = settled(targets.select("t").distinct().withColumn("_at", (F.row_number().over(W.orderBy("t")) - 1).cast("int")), "dates")  # a row a date
    days = np.array([r["t"] for r in dates.orderBy("t").collect()], np.int64)
    moves = targets.join(F.broadcast(dates), "t").select("ticker", (F.col("_at") / SPAN).cast("int").alias("block"), (F.col("_at") % SPAN).alias("at"), "w")
    series = settled(moves.groupBy("block", "ticker").agg(F.collect_list("at").alias("at"), F.collect_list("w").alias("ws")), "series")  # a row a block and ticker
    known = {r["t"]: r["phi"] for r in phi.select("t", "phi").collect()} if isinstance(phi, DataFrame) else dict.fromkeys(days[:1].tolist(), float(phi))
    decay, last = [], 0.65
    for t in days.tolist():
        value = known.get(t)
        last = last if value is None or math.isnan(value) else value
        decay.append(last)
    names = list(policies)
    stay = {name: 1 - p.fraction for name, p in policies.items()}
    pull = {name: np.array([p.fraction * p.aim_weight(x) for x in decay]) for name, p in policies.items()}

    def matrices(frames: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, dict[str, np.ndarray]]]:
        many = max(1, CELLS // max(1, width * len(names)))
        for frame in frames:
            for first in range(0, len(frame), many):
                part = frame.iloc[first : first + many]
                w, held = np.zeros((len(part), width)), np.zeros((len(part), len(names)))
                for row, (at, ws, before) in enumerate(zip(part["at"], part["ws"], part["held"], strict=True)):
                    if at is not None:
                        w[row, at] = ws
                    if before is not None:
                        held[row] = before
                yield part, w, dict(zip(names, held.T))

    state, out = None, []
    for a in range(0, len(days), SPAN):
        width = min(SPAN, len(days) - a)
        part = series.where(F.col("block") == a // SPAN).drop("block")
        part = part.withColumn("held", F.lit(None).cast("array<double>")) if state is None else part.join(state, "ticker", "full")
        part = settled(part, "block") if state is not None else part
        own = {name: p[a : a + width] for name, p in pull.items()}
        scales = {name: np.ones(width) for name in names}
        open_runs = set(names)
        while open_runs:
            found = part.mapInPandas(_block_sums(matrices, {n: scales[n] for n in open_runs}, own, stay, width), "run string, i int, j int, v double").groupBy("run", "i", "j").agg(F.sum("v").alias("v")).collect()
            squares = {name: np.zeros((width, width + 1)) for name in open_runs}
            for r in found:
                squares[r["run"]][r["i"], r["j"]] = r["v"]
            for name, square in squares.items():
                new = _solved(square, stay[name], policies[name].gross)
                if np.allclose(new, scales[name], rtol=1e-12, atol=0):
                    open_runs.discard(name)
                scales[name] = new
        gone = settled(part.mapInPandas(_block_paths(matrices, scales, own, stay, width), f"ticker {kind}, held array<double>, paths array<array<double>>"), "paths")
        state = gone.select("ticker", "held")
        out.append(gone.select(F.posexplode("paths").alias("_run", "_path"), "ticker").select("_run", "ticker", F.posexplode("_path").alias("_at", "w")).withColumn("_at", F.col("_at") + a))
    if not out:
        return targets.sparkSession.createDataFrame([], f"run string, t int, ticker {kind}, w double")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    run = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_run") + 1)
    return whole.join(F.broadcast(dates), "_at").select(run.alias("run"), F.col("t").cast("int").alias("t"), "ticker", "w")


def _block_sums(matrices, scales: dict[str, np.ndarray], pull: dict[str, np.ndarray], stay: dict[str, float], width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {name: np.zeros((width, width + 1)) for name in scales}
        for _, w, held in matrices(frames, width):
            for name in scales:
                total[name] += _signed_sums(w, held[name], scales[name], pull[name], stay[name])
        i, j = np.tril_indices(width, 1, width + 1)
        for name, sums in total.items():
            yield pd.DataFrame({"run": name, "i": i, "j": j, "v": sums[i, j]})

    return run


def _block_paths(matrices, scales: dict[str, np.ndarray], pull: dict[str, np.ndarray], stay: dict[str, float], width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, w, held in matrices(frames, width):
            paths = np.stack([np.stack(list(_paths(w, held[n], scales[n], pull[n], stay[n])), axis=1) * scales[n] for n in scales], axis=1)
            yield pd.DataFrame({"ticker": part["ticker"].to_numpy(), "held": list(paths[:, :, -1]), "paths": [list(one) for one in paths]})

    return run
