"""Ranks and exact quantiles across the names of a date, without a task that holds them all.

Ranks: a date's rows are divided into ranges of value (and name, so that ties can be divided too) by cuts from a hashed
sample. Rows are ranked inside their range, and what lies before a range comes from counts a range, ties at its borders
included. Cuts only balance the ranges; any cuts give the same ranks. Dates of up to RANGE rows are one range.

Quantiles: each wanted order statistic has an interval of values that holds it. In every round the intervals are cut by
values of a hashed sample, the rows of each part are counted, and the part with the wanted row becomes the interval,
until it is a single value or few rows are left, which are sorted. Where few rows of an interval are wanted, the cuts are
the sample's values a little below and above each, so that a row is compared with a few values only; where many are, the
cuts are spread evenly.

What is gathered about a date is bounded: KEYS rows for each of at most RANGES cuts, and one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import bounded, settled

#: Rows of a range, about, and ranges of a date at most; keys looked at for each cut.
RANGE, RANGES, KEYS = 100_000, 256, 16
#: Rows of an interval that are sorted in one place.
FEW = 10_000
#: Cuts of an interval, at most, that a row is compared with one by one.
FLAT = 8


def _sampled(sizes: Column, parts: Column, *columns: str) -> Column:
    """A hashed sample of about ``KEYS`` rows for each of ``parts``."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30) < KEYS * parts / sizes


def _picked(held: Column, parts: Column) -> Column:
    """Every so many of a sorted array, ``parts - 1`` of them at most, each once."""
    spot = lambda k: F.element_at(held, F.greatest(F.lit(1), (F.size(held) * k / parts).cast("int")))
    return F.when(parts > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), parts - 1), spot))).otherwise(F.slice(held, 1, 0))


def _around(held: Column, needs: Column, sizes: Column) -> Column:
    """The values of a sorted sample four deviations below and above the places where ``needs`` of ``sizes`` rows should be, sorted, each once."""
    m = F.size(held)

    def spots(need: Column) -> Column:
        share = need / sizes
        margin = 1 + 4 * F.sqrt(m * share * (1 - share))
        inside = lambda k: F.least(m, F.greatest(F.lit(1), k.cast("int")))
        return F.array(inside(F.floor(m * share - margin)), inside(F.ceil(m * share + margin)))

    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(needs, spots)), lambda k: F.element_at(held, k))))


def placed(frame: DataFrame, value: str, place: str, *, descending: bool = False, among: Column | None = None, average: bool = False, largest: int | None = None) -> DataFrame:
    """``frame`` with ``place``: 1 for the smallest (or largest) ``value`` of the row's ``t``, ties by ``ticker``; null without a value, and for rows outside ``among``.

    With ``average``, ties share the mean of their places. ``frame`` is read several times, so it should be a written table;
    ``largest`` spares one reading, the most rows that any ``t`` has.
    """
    key = -F.col(value) if descending else F.col(value)
    counted = F.col(value).isNotNull() if among is None else F.col(value).isNotNull() & F.coalesce(among, F.lit(False))
    rows = frame.withColumns({"_key": F.when(counted, key), "_name": F.col("ticker")})
    away = -1 - F.pmod(F.xxhash64("_name"), F.lit(RANGES)).cast("int")  # rows without a place lie in ranges of their own, spread by name
    if (most_rows(rows, "_key") if largest is None else largest) <= RANGE:
        cut = rows.withColumn("_range", F.when(F.col("_key").isNotNull(), F.lit(0)).otherwise(away))
        return _inside(cut, place, average, None).drop("_key", "_name", "_range")
    sizes = rows.groupBy("t").agg(F.count("_key").alias("_n")).withColumn("_parts", F.least(F.lit(RANGES), F.ceil(F.col("_n") / RANGE)).cast("int"))
    keyed = rows.where(F.col("_key").isNotNull()).select("t", F.struct("_key", "_name").alias("_at"))
    drawn = keyed.join(F.broadcast(sizes), "t").where(_sampled(F.col("_n"), F.col("_parts"), "t", "_at"))  # a row a date
    cuts = drawn.groupBy("t").agg(F.sort_array(F.collect_list("_at")).alias("_held"), F.max("_parts").alias("_parts"))
    cuts = settled(cuts.select("t", _picked(F.col("_held"), F.col("_parts")).alias("_cuts")), "cuts")
    at = F.struct("_key", "_name")
    before = F.size(F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda c: c < at))
    ranged = rows.join(F.broadcast(cuts), "t", "left")  # a row a date
    ranged = settled(ranged.withColumn("_range", F.when(F.col("_key").isNotNull(), before).otherwise(away)).drop("_cuts"), "ranged")
    held = ranged.where("_range >= 0")
    ends = held.groupBy("t", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_first"), F.max("_key").alias("_last"))
    if average:  # rows that tie with a range's smallest or largest key
        ends = settled(ends, "ends")
        tied = held.join(F.broadcast(ends.select("t", "_range", "_first", "_last")), ["t", "_range"])  # a row a range
        tied = tied.groupBy("t", "_range").agg(F.count_if(F.col("_key") == F.col("_first")).alias("_firsts"), F.count_if(F.col("_key") == F.col("_last")).alias("_lasts"))
        ends = ends.join(tied, ["t", "_range"])
    else:
        ends = ends.withColumns({"_firsts": F.lit(0), "_lasts": F.lit(0)})
    month = ends.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("_range", "_n", "_first", "_last", "_firsts", "_lasts"))).alias("_all"))
    total = lambda rows, of: F.aggregate(F.transform(rows, of), F.lit(0).cast("long"), lambda s, x: s + x)
    each = F.transform("_all", lambda own: F.struct(
        own["_range"].alias("_range"), own["_first"].alias("_first"), own["_last"].alias("_last"),
        total(F.filter("_all", lambda o: o["_range"] < own["_range"]), lambda o: o["_n"]).alias("_offset"),
        total(F.filter("_all", lambda o: (o["_range"] < own["_range"]) & (o["_last"] == own["_first"])), lambda o: o["_lasts"].cast("long")).alias("_earlier"),
        total(F.filter("_all", lambda o: (o["_range"] > own["_range"]) & (o["_first"] == own["_last"])), lambda o: o["_firsts"].cast("long")).alias("_later"),
    ))
    edges = settled(month.select("t", F.explode(each).alias("_e")).select("t", "_e.*"), "edges")
    return _inside(ranged, place, average, edges).drop("_key", "_name", "_range")


def _inside(ranged: DataFrame, place: str, average: bool, edges: DataFrame | None) -> DataFrame:
    """Places inside each range, with what ``edges`` tells of the date's other ranges added."""
    by = W.partitionBy("t", "_range")
    ranged = bounded(ranged, "t", "_range")
    known = F.col("_key").isNotNull()
    if not average:
        out = ranged.withColumn("_inner", F.row_number().over(by.orderBy("_key", "_name")))
        if edges is None:
            return out.withColumn(place, F.when(known, F.col("_inner").cast("long"))).drop("_inner")
        out = out.join(F.broadcast(edges.select("t", "_range", "_offset")), ["t", "_range"], "left")  # a row a range
        return out.withColumn(place, F.when(known, F.col("_inner") + F.col("_offset"))).drop("_inner", "_offset")
    out = ranged.withColumns({"_inner": F.rank().over(by.orderBy("_key")), "_ties": F.count(F.lit(1)).over(by.orderBy("_key").rangeBetween(0, 0))})
    if edges is None:
        return out.withColumn(place, F.when(known, F.col("_inner") + (F.col("_ties") - 1) / 2)).drop("_inner", "_ties")
    out = out.join(F.broadcast(edges), ["t", "_range"], "left")  # a row a range
    earlier = F.when(F.col("_key") == F.col("_first"), F.col("_earlier")).otherwise(F.lit(0))
    later = F.when(F.col("_key") == F.col("_last"), F.col("_later")).otherwise(F.lit(0))
    middle = F.col("_offset") + F.col("_inner") - earlier + (F.col("_ties") + earlier + later - 1) / 2
    return out.withColumn(place, F.when(known, middle)).drop("_inner", "_ties", "_first", "_last", "_offset", "_earlier", "_later")


def most_rows(frame: DataFrame, value: str = "t") -> int:
    """The most rows with a ``value`` that any ``t`` has."""
    return frame.groupBy("t").agg(F.count(value).alias("_n")).agg(F.max("_n")).first()[0] or 0


def with_sizes(frame: DataFrame, name: str, what: Column | None = None) -> DataFrame:
    """``frame`` with ``name``: how many rows of the row's ``t`` have ``what`` (None: all rows)."""
    sizes = frame.groupBy("t").agg((F.count(F.lit(1)) if what is None else F.count(what)).alias(name))
    return frame.join(F.broadcast(sizes), "t")  # a row a date


def percent_rank_ties(frame: DataFrame, value: str, name: str) -> DataFrame:
    """``frame`` with ``name``: the average place of ties divided by the number of values; null for null."""
    ranked = with_sizes(placed(frame, value, "_middle", average=True), "_filled", F.col(value))
    return ranked.withColumn(name, F.col("_middle") / F.col("_filled")).drop("_middle", "_filled")


def quantiles(frame: DataFrame, value: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``t`` and one column for each of ``shares``: the exact quantiles of ``value``, between neighbours in proportion; null for a ``t`` without values.

    ``frame`` is read several times, so it should be a written table.
    """
    rows = frame.where(F.col(value).isNotNull()).select("t", F.col(value).cast("double").alias("x"), "ticker")
    rank = lambda p: F.lit(float(p)) * F.greatest(F.col("n") - 1, F.lit(0))
    sizes = settled(frame.groupBy("t").agg(F.count(value).alias("n")), "sizes")  # a row a date
    if (sizes.agg(F.max("n")).first()[0] or 0) <= FEW:
        held = frame.groupBy("t").agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("xs")).withColumn("n", F.size("xs"))
        at = lambda k: F.try_element_at("xs", k.cast("int"))
        return held.select("t", *[_between(at, rank(p)).alias(name) for p, name in zip(shares, names)])
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(rank(p)) + 1, F.ceil(rank(p)) + 1) for p in shares])))
    wanted = sizes.where("n > 0").select("t", F.explode(places).alias("k"), F.col("n").alias("rows"))
    now = settled(wanted.select("t", "k", F.col("k").alias("need"), "rows", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("found")), "wanted")
    open_ = (F.col("rows") > FEW) & F.col("found").isNull()
    while not now.where(open_).isEmpty():
        now = settled(now.where(~open_).unionByName(_closer(rows, now.where(open_))), "wanted")
    # what is left of each interval, FEW rows at most, is sorted
    small = now.where(F.col("found").isNull())
    spans = small.select("t", "low", "high").distinct()
    held = _within(rows, spans).groupBy("t", "low", "high").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    last = small.join(held, (small["t"] == held["t"]) & small["low"].eqNullSafe(held["low"]) & small["high"].eqNullSafe(held["high"])).select(small["t"], "k", F.element_at("xs", F.col("need").cast("int")).alias("x"))
    found = now.where(F.col("found").isNotNull()).select("t", "k", F.col("found").alias("x")).unionByName(last)
    found = sizes.join(found.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("at")), "t", "left")
    at = lambda k: F.try_element_at("at", k.cast("long"))
    return found.select("t", *[_between(at, rank(p)).alias(name) for p, name in zip(shares, names)])


def _between(at, rank: Column) -> Column:
    """What lies at ``rank``, counted from 0, between the neighbours that ``at`` gives by their number."""
    low, high = at(F.floor(rank) + 1), at(F.ceil(rank) + 1)
    return low + (rank - F.floor(rank)) * (high - low)


def _within(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` of each of ``spans(t, low, high)``, open intervals, where null is no bound; a few rows a date."""
    inside = (F.col("low").isNull() | (F.col("x") > F.col("low"))) & (F.col("high").isNull() | (F.col("x") < F.col("high")))
    return rows.join(F.broadcast(spans), "t").where(inside)


def _closer(rows: DataFrame, now: DataFrame) -> DataFrame:
    """``now(t, k, need, rows, low, high, found)`` with each interval narrowed to the part that holds its row, or to that row's value."""
    same = lambda a, b: (a["t"] == b["t"]) & a["low"].eqNullSafe(b["low"]) & a["high"].eqNullSafe(b["high"])
    spans = now.groupBy("t", "low", "high").agg(F.max("rows").alias("rows"), F.collect_set("need").alias("needs"))
    spans = spans.withColumn("parts", F.least(F.lit(RANGES // 4), F.ceil(F.col("rows") / (FEW // 2))).cast("int"))
    spans = settled(spans.withColumn("few", 2 * F.size("needs") < F.col("parts")), "spans")
    drawn = _within(rows, spans.drop("needs")).where(_sampled(F.col("rows"), F.when(F.col("few"), F.lit(RANGES)).otherwise(F.col("parts")), "t", "ticker", "x"))
    held = drawn.groupBy("t", "low", "high").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    cuts = held.join(F.broadcast(spans), same(held, spans)).select(held["t"], held["low"], held["high"], F.when(F.col("few"), _around(F.col("xs"), F.col("needs"), F.col("rows"))).otherwise(_picked(F.col("xs"), F.col("parts"))).alias("cuts"))
    cuts = settled(cuts, "cuts")
    longest = cuts.agg(F.max(F.size("cuts"))).first()[0] or 0
    if longest <= FLAT:  # compiled; functions of arrays are not
        cut = lambda k: F.try_element_at("cuts", F.lit(k))
        side = lambda k: F.when(cut(k) < F.col("x"), 2).when(cut(k) == F.col("x"), 1).otherwise(0)
        part = sum((side(k) for k in range(1, longest + 1)), F.lit(0))
    else:
        part = 2 * F.size(F.filter("cuts", lambda c: c < F.col("x"))) + F.array_contains("cuts", F.col("x")).cast("int")
    # an even part lies between cuts, an odd one is a cut's own value
    counts = _within(rows, cuts).groupBy("t", "low", "high", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("t", "low", "high").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    counts = settled(counts.withColumn("upto", upto), "parts")
    joined = now.join(counts, same(now, counts)).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    joined = joined.select(now["t"], "k", "need", now["low"], now["high"], "part", "n", "upto")
    joined = joined.join(cuts, same(joined, cuts)).select(joined["t"], "k", "need", joined["low"].alias("from"), joined["high"].alias("to"), "part", "n", "upto", "cuts")
    half = F.floor(F.col("part") / 2).cast("int")
    single = F.col("part") % 2 == 1
    below, above = F.when(half >= 1, F.element_at("cuts", F.greatest(half, F.lit(1)))), F.when(half < F.size("cuts"), F.element_at("cuts", F.least(half + 1, F.size("cuts"))))
    return joined.select(
        "t", "k", (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"), F.col("n").alias("rows"),
        F.when(~single, F.coalesce(below, F.col("from"))).alias("low"), F.when(~single, F.coalesce(above, F.col("to"))).alias("high"), F.when(single, above).alias("found"),
    )
