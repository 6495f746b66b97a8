"""From class probabilities to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot

CLASSES = 10


def dpr(p: Column) -> Column:
    """The best five classes against the worst five, weighted 5 to 1 from the ends."""
    weights = [5.0, 4.0, 3.0, 2.0, 1.0, -1.0, -2.0, -3.0, -4.0, -5.0]
    return dot(p, F.array(*[F.lit(w) for w in weights]))


def with_scores(probs: DataFrame, stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``dpr``, expected return ``ret_score`` and its ratio to the mixture's deviation ``srp`` beside ``p``; ``stats`` are for each ``by``, or for all."""
    arrays = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "mu", "sigma2"))).alias("_s"))  # ten rows each
    joined = probs.join(F.broadcast(arrays), [*by]) if by else probs.crossJoin(F.broadcast(arrays))
    mu, sigma2 = F.transform("_s", lambda s: s["mu"]), F.transform("_s", lambda s: s["sigma2"])
    expected = dot(F.col("p"), mu)
    second = dot(F.col("p"), F.zip_with(mu, sigma2, lambda m, v: v + m * m))
    spread = F.sqrt(F.greatest(second - expected * expected, F.lit(1e-12)))
    return joined.withColumns({"dpr": dpr(F.col("p")), "ret_score": expected, "srp": expected / spread}).drop("_s")


def ensemble_mean(members: DataFrame) -> DataFrame:
    """``t, ticker, p``: the mean over an ensemble's members of each class's probability."""
    each = members.select("t", "ticker", F.posexplode("p").alias("k", "q")).groupBy("t", "ticker", "k").agg(F.avg("q").alias("q"))
    return each.groupBy("t", "ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda s: s["q"]).alias("p"))
