"""Shaping of panels: densifying, sampling, filling, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import by_ticker, forward_fill, rows
from ..sources.scratch import merged, settled, spread


def calendar(facts: DataFrame) -> DataFrame:
    """``t, date`` for each distinct date: as long as the calendar, so the one window without partition is small."""
    return facts.select("date").distinct().withColumn("t", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))


_KINDS = {"date": (T.DateType,), "ticker": (T.StringType, T.IntegralType), "close": (T.NumericType,)}


def check_columns(facts: DataFrame, names: Sequence[str]) -> None:
    """An error if one of ``names``, of date, ticker and close, is missing, or isn't a date, a name and a number."""
    for name in names:
        if name not in facts.columns:
            raise ValueError(f"prices have no column {name!r}, only {facts.columns}")
        if not isinstance(facts.schema[name].dataType, _KINDS[name]):
            raise TypeError(f"{name} of prices is {facts.schema[name].dataType.simpleString()}")


def checked_prices(facts: DataFrame) -> DataFrame:
    """``date, ticker, close`` of ``facts``, after :func:`check_columns`."""
    check_columns(facts, ("date", "ticker", "close"))
    return facts.select("date", "ticker", F.col("close").cast("double").alias("close"))


def densify(facts: DataFrame) -> DataFrame:
    """Every ticker at every date, with its ordinal ``t``; cells without a fact are null.

    Facts, and not cells, are shuffled, by ticker: each is followed by the empty cells up to the ticker's next one, and its
    last brings those before its first. What comes out lies by ticker, so windows across time need no shuffle of their own.
    """
    check_columns(facts, ("date", "ticker"))
    dates = settled(calendar(facts), "calendar")
    length = dates.count()
    cells = length * facts.agg(F.approx_count_distinct("ticker")).first()[0]  # only balances the work
    marked = facts.join(F.broadcast(dates.select("t", F.col("date").alias("_date"))), F.col("date").eqNullSafe(F.col("_date"))).drop("_date")  # one row a date
    marked = spread(marked, "ticker", count=cells).withColumns({"_next": F.lead("t").over(by_ticker()), "_first": F.first("t").over(rows(None, 0))})
    known = F.col("ticker").isNotNull() & F.col("date").isNotNull()  # others are cells without a fact, each once
    last = F.col("_next").isNull() | (F.col("_next") != F.col("t"))  # of the facts of a cell, which are one where they are unique
    begin = F.when(last & (F.col("t") == F.col("_first")), F.lit(0)).otherwise(F.col("t"))
    end = F.greatest("t", F.coalesce("_next", F.lit(length)) - 1)
    values = [c for c in facts.columns if c not in ("ticker", "date")]
    spans = marked.where(known | last).select("ticker", "t", known.alias("_known"), *values, F.explode(F.sequence(begin, end)).alias("_t"))
    fact = F.col("_known") & (F.col("t") == F.col("_t"))
    filled = spans.select(F.col("_t").alias("t"), "ticker", *[F.when(fact, F.col(c)).alias(c) for c in values])
    return filled.join(F.broadcast(dates), "t").select("t", "date", "ticker", *values)  # one row a date


def month_end_last(daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The last value that is not null of each column in each month, dated at the month's end."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns]
    return daily.groupBy("ticker", F.last_day("date").alias("date")).agg(*last)


def pivot_last(facts: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """One value per date and ticker: that of the last row in ``order``."""
    return facts.groupBy("ticker", "date").agg(F.max_by(value, F.struct(*order)).alias(value))


def fill_forward(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    return panel.withColumns({c: forward_fill(F.col(c)) for c in columns})


def asof_dates(dates: DataFrame, marks: DataFrame) -> DataFrame:
    """``date, mark``: for each date the latest mark not after it; null before the first. Both tables are as long as a calendar."""
    both = dates.select("date", F.lit(None).cast("date").alias("mark"), F.lit(1).alias("asked")).unionByName(marks.select("date", F.col("date").alias("mark"), F.lit(0).alias("asked")))
    latest = F.last("mark", ignorenulls=True).over(W.orderBy("date", "asked").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("mark", latest).where("asked = 1").select("date", "mark")


def asof_weights(weights: DataFrame, panel: DataFrame) -> DataFrame:
    """``t, date, ticker, w``: whole rows of weights carried forward to the panel's dates; a name absent from the row has 0."""
    dates = panel.select("date").distinct()
    marks = asof_dates(dates, weights.select("date").distinct())
    grid = panel.select("t", "date", "ticker").join(F.broadcast(marks), "date")  # one row a date
    own = weights.select(F.col("date").alias("mark"), "ticker", "w")
    return grid.join(merged(own), ["mark", "ticker"], "left").select("t", "date", "ticker", F.coalesce("w", F.lit(0.0)).alias("w"))


def asof_join(asked: DataFrame, known: DataFrame, values: Sequence[str], *, key: str = "ticker", at: str = "date", spans: int = 64) -> DataFrame:
    """``asked`` with ``values`` of the latest row of ``known`` with the same ``key`` not after the row's ``at``; null before the first. Keys have dates of their own, no panel is needed.

    Time is cut into ``spans`` of about as many rows, so a key's rows lie in several tasks. The last values of each key
    and span, a row each, are carried to the spans after it; inside a span both tables are merged in order of time. Of
    rows of ``known`` with equal key and time one counts, in no fixed order: make them unique first.
    """
    own = F.struct(*values)
    parts = [asked.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(None).cast(T.StructType([known.schema[v] for v in values])).alias("_v"), F.struct(*asked.columns).alias("_row")),
             known.select(F.col(key).alias("_k"), F.col(at).alias("_at"), own.alias("_v"), F.lit(None).cast(asked.schema).alias("_row"))]
    both = settled(parts[0].unionByName(parts[1]), "asof")
    order = F.col("_at").cast("timestamp").cast("double")
    found = both.agg(F.percentile_approx(order, [k / spans for k in range(1, spans)], 10_000)).first()[0]  # spans - 1 numbers, which only balance the work
    cuts = F.array(*[F.lit(c) for c in sorted(set(found or []))]) if found else F.array().cast("array<double>")
    both = both.withColumn("_span", F.size(F.filter(cuts, lambda c: c < order)))
    lasts = both.where(F.col("_v").isNotNull()).groupBy("_k", "_span").agg(F.max_by("_v", "_at").alias("_last"))
    # at each span that a key has rows in, the last value of the spans before it
    begun = both.select("_k", "_span").distinct().join(lasts, ["_k", "_span"], "left")
    earlier = W.partitionBy("_k").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)  # a row a span
    begun = begun.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).where(F.col("_carried").isNotNull()).select("_k", "_span", "_carried")
    inside = W.partitionBy("_k", "_span").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    merged = both.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).where(F.col("_row").isNotNull())
    out = merged.join(begun, ["_k", "_span"], "left").withColumn("_own", F.coalesce("_own", "_carried"))
    return out.select("_row.*", *[F.col(f"_own.{v}").alias(v) for v in values])


def dedup_last(facts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``."""
    ranked = facts.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])))
    return ranked.where("_n = 1").drop("_n")


def min_history(panel: DataFrame, least: int = 12) -> DataFrame:
    """The rows of tickers with at least ``least`` prices."""
    enough = panel.groupBy("ticker").agg(F.count("close").alias("n")).where(F.col("n") >= least).select("ticker")
    return panel.join(enough, "ticker", "left_semi")


def inject_delisting(panel: DataFrame, delist_return: float = -0.30) -> DataFrame:
    """One price after the last one of each ticker that stops before the panel does."""
    whole = W.partitionBy("ticker")
    last = F.max(F.when(F.col("close").isNotNull(), F.col("t"))).over(whole)
    price = F.max_by("close", F.when(F.col("close").isNotNull(), F.col("t"))).over(whole)
    return panel.withColumns({"_last": last, "_price": price}).withColumn("close", F.when(F.col("t") == F.col("_last") + 1, F.col("_price") * (1 + delist_return)).otherwise(F.col("close"))).drop("_last", "_price")


def filter_universe(metadata: DataFrame, exchanges: Sequence[str], kind: str, since) -> DataFrame:
    """The distinct tickers of some exchanges and one kind that are alive, or ended at or after ``since``."""
    alive = F.col("endDate").isNull() | (F.col("endDate") >= F.lit(since))
    return metadata.where(F.col("exchange").isin(*exchanges) & (F.col("assetType") == kind) & alive).select("ticker").distinct()


def running(panel: DataFrame, value: str, name: str) -> DataFrame:
    return panel.withColumn(name, F.sum(value).over(rows(None, 0)))
