"""Returns and their cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, clipped, forward_fill, ratio, rows
from ..sources.scratch import settled
from . import ranks


def simple_returns(panel: DataFrame, *, fill: str = "none") -> DataFrame:
    """``ret`` beside the panel's columns. ``none``: null at a gap and after it; ``pad``: prices are carried over gaps first, so the first month back has the whole jump and a name that ended returns 0."""
    if fill not in ("none", "pad"):
        raise ValueError(f"fill must be none or pad, not {fill!r}")
    if fill == "none":
        return panel.withColumn("ret", ratio(F.col("close"), F.lag("close").over(by_ticker())) - 1)
    before = F.last("close", ignorenulls=True).over(rows(None, -1))  # in one pass with the price itself
    return panel.withColumns({"_p": forward_fill(F.col("close")), "_before": before}).withColumn("ret", ratio(F.col("_p"), F.col("_before")) - 1).drop("_p", "_before")


def winsorised(returns: DataFrame, tail: float = 0.01) -> DataFrame:
    """``ret`` within the cross-section's exact quantiles ``tail`` and ``1 - tail`` of its month."""
    returns = settled(returns, "returns")
    bounds = ranks.quantiles(returns, "ret", (tail, 1 - tail), ("_low", "_high"))
    joined = returns.join(F.broadcast(bounds), "t")  # one row a date
    return joined.withColumn("ret", clipped(F.col("ret"), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def model_returns(panel: DataFrame, top: float = 3.0) -> DataFrame:
    """Padded returns, those above ``top`` dropped, the rest winsorised."""
    padded = simple_returns(panel, fill="pad")
    return winsorised(padded.withColumn("ret", F.when(F.col("ret") <= top, F.col("ret"))))


def clip_returns(returns: DataFrame, low: float, high: float) -> DataFrame:
    return returns.withColumn("ret", clipped(F.col("ret"), low, high))


def pnl_prices(panel: DataFrame, low: float = -0.95, high: float = 3.0) -> DataFrame:
    """``close`` replaced by a path rebuilt from padded, clipped and winsorised returns; gaps stay gaps."""
    cleaned = winsorised(clip_returns(simple_returns(panel, fill="pad"), low, high))
    path: Column = F.product(1 + F.coalesce("ret", F.lit(0.0))).over(rows(None, 0))
    return cleaned.withColumn("close", F.when(F.col("close").isNotNull(), path)).drop("ret")


def size_proxy(panel: DataFrame) -> DataFrame:
    """``dv``: price times volume, carried forward over gaps."""
    return panel.withColumn("dv", forward_fill(F.col("close") * F.col("volume")))
