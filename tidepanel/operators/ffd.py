"""Fractional differentiation of log prices: taps, the causal filter, and scores from its level."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, forward_fill, rows
from ..sources.scratch import settled, spread


def taps(d: float, threshold: float = 1e-4, max_lags: int = 60) -> list[float]:
    """The filter's weights, up to the first below ``threshold`` in size."""
    if not 0 <= d <= 2:
        raise ValueError("d must lie in [0, 2]")
    lags = np.arange(1, max_lags)
    weights = np.concatenate([[1.0], np.cumprod((lags - 1 - d) / lags)])
    small = np.flatnonzero(np.abs(weights[1:]) < threshold)
    return weights[: 1 + small[0] if len(small) else max_lags].tolist()


def tap_table(orders: DataFrame, threshold: float = 1e-4, max_lags: int = 60) -> DataFrame:
    """``d, k, w`` of each of ``orders(d)``, as a running product."""
    by = W.partitionBy("d").orderBy("k")
    grid = orders.where(F.col("d").between(0, 2)).select("d").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max_lags - 1))))
    factor = F.when(F.col("k") == 0, F.lit(1.0)).otherwise((F.col("k") - 1 - F.col("d")) / F.col("k"))
    weights = grid.withColumn("w", F.product(factor).over(by.rowsBetween(W.unboundedPreceding, 0)))
    ended = F.max((F.abs("w") < threshold).cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0))
    return weights.withColumn("_ended", ended).where("_ended = 0").select("d", "k", "w")


def log_price(panel: DataFrame) -> DataFrame:
    """``x``: the log of the price carried forward; null before a name's first price."""
    return panel.withColumn("x", F.log(forward_fill(F.col("close"))))


def level(panel: DataFrame, d: float, threshold: float = 1e-5, max_lags: int = 60) -> DataFrame:
    """``level``: the filter of order ``d`` on the log price; null until all taps have a price."""
    weights = taps(d, threshold, max_lags)
    total = F.col("x") * weights[0]
    for k, w in enumerate(weights[1:], 1):
        total = total + F.lag("x", k).over(by_ticker()) * w
    return log_price(panel).withColumn("level", total).drop("x")


def level_by_ticker(panel: DataFrame, orders: DataFrame, threshold: float = 1e-5, max_lags: int = 60) -> DataFrame:
    """``level`` with each ticker's own ``d`` from ``orders(ticker, d)``; tickers without one take the median."""
    orders = settled(orders.select("ticker", "d"), "orders")
    middle = orders.agg(F.median("d").alias("_middle"))
    known = log_price(spread(settled(panel, "panel"), "ticker")).join(orders, "ticker", "left").crossJoin(F.broadcast(middle))  # a single row
    known = known.withColumn("_d", F.coalesce("d", "_middle"))
    steps = F.sequence(F.lit(1), F.lit(max_lags - 1))
    state = F.struct(F.array(F.lit(1.0)).alias("w"), F.lit(False).alias("ended"))

    def extend(s, k):
        nxt = -F.element_at(s["w"], -1) * (F.col("_d") - k + 1) / k
        stop = s["ended"] | (F.abs(nxt) < threshold)
        return F.struct(F.when(stop, s["w"]).otherwise(F.concat(s["w"], F.array(nxt))).alias("w"), stop.alias("ended"))

    each = orders.select(F.col("d").alias("_d")).unionByName(middle.select(F.col("_middle").alias("_d"))).distinct()
    each = settled(each.withColumn("_w", F.aggregate(steps, state, extend)["w"]), "taps")  # once an order, not once a row
    known = known.join(F.broadcast(each), "_d", "left")  # a row an order
    total = F.col("x") * F.get("_w", F.lit(0))
    for k in range(1, max_lags):
        total = total + F.when(F.size("_w") > k, F.lag("x", k).over(by_ticker()) * F.get("_w", F.lit(k))).otherwise(F.lit(0.0))
    return known.withColumn("level", total).drop("x", "_middle", "_d", "_w", "d")


def rolling_scores(levels: DataFrame, windows: Sequence[int] = (1, 3, 6, 9, 12)) -> DataFrame:
    """``ffd{m}``: the level itself for 1, else its mean over m rows, of which half must be there."""
    out = {"ffd1": F.col("level")} if 1 in windows else {}
    for m in windows:
        if m > 1:
            span = rows(-(m - 1), 0)
            out[f"ffd{m}"] = F.when(F.count("level").over(span) >= max(1, m // 2), F.avg("level").over(span))
    return levels.withColumns(out)


def slope_scores(levels: DataFrame, windows: Sequence[int] = (1, 3, 12)) -> DataFrame:
    """``ffd{m}``: the level for 1, else its change over m rows."""
    return levels.withColumns({f"ffd{m}": F.col("level") if m == 1 else F.col("level") - F.lag("level", m).over(by_ticker()) for m in windows})
