"""Mixing sources to target weights.

Each row gets a hash-random key. Within a source, rows are ranged by that key and their token counts summed up; the
mix takes rows in that order up to the source's exact budget, after as many whole epochs as the budget holds.
The prefix sums are two-level: rows fall into about sqrt(n) ranges of the hash per source, ranges are summed (map-side
first), the sums accumulated per source, and rows accumulated inside their range. So a source with a third of all rows
is spread over as many tasks as it has ranges.

Defined results: null text has size 0 and takes 0; a null source is a source, the last; sources whose sizes are all 0
have target 0; a text of any length is counted whole; repeated rows count each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, materialize, small_side, unused, word_count

#: No target exceeds this many epochs of its source.
MAX_EPOCHS = 3
#: Up to so many sources their budgets are broadcast.
BROADCAST_SOURCES = 100_000


def running_sums(df: DataFrame, order: Sequence[str], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with a column of the sum over all earlier rows in ``order`` for each of ``sums`` (new name: column).

    Rows are range-partitioned and written once, so that ranges are fixed; partitions are summed, their few sums
    accumulated, and each partition accumulates its own rows.
    """
    ranged = materialize(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), name)
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return ranged.join(F.broadcast(parts), "_part").select(  # as many rows as shuffle partitions
        *df.columns, *[(F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()]
    )


def source_budgets(sizes: DataFrame, weights: Sequence[int], share: float = 1.0) -> DataFrame:
    """One row per source of ``sizes(_key, _size)``: its size, rows, number of hash ranges and target.

    Sources in code-point order weigh ``weights``, repeating; the total ``share`` of all sizes is dealt by weight, no
    target exceeding MAX_EPOCHS times its source; what is cut off is dealt again among the others.
    """
    totals = sizes.groupBy("_key").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(totals.withColumn("_one", F.lit(1)), ["_key"], {"_rank": "_one"}, "sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("_weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * MAX_EPOCHS)
    capped = capped.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    filled = materialize(running_sums(capped, ["_ratio", "_rank"], {"_caps_before": "_cap", "_weights_before": "_weight"}, "fill"), "filled")
    whole = filled.agg(F.floor(F.sum("source_size") * F.lit(float(share))).cast("long").alias("_total"), F.sum("_weight").alias("_all_weights"))
    filled = filled.crossJoin(F.broadcast(whole))  # a single row of sums
    left = (F.col("_total") - F.col("_caps_before")) * F.col("_weight").cast("double")
    full = F.col("_cap").cast("double") * (F.col("_all_weights") - F.col("_weights_before")) <= left
    filled = filled.withColumn("_full", full)
    level = filled.agg(
        F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).alias("_capped"),
        F.sum(F.when(~F.col("_full"), F.col("_weight")).otherwise(0)).alias("_open"),
    )
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_weight").cast("double") * (F.col("_total") - F.col("_capped")) / F.col("_open"))
    ranges = F.greatest(F.lit(1), F.ceil(F.sqrt("_n"))).cast("long")
    return filled.crossJoin(F.broadcast(level)).select("_key", "source_size", target.alias("target"), ranges.alias("_ranges"))


def _row_keys(text: str, source: str, row_id: str, seed: str) -> dict[str, Column]:
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(f"`{row_id}`").cast("string"), F.lit(""))).cast("binary"))
    return {
        "_key": F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`")), F.lit("t")),  # a null source comes after all others
        "_size": word_count(F.col(f"`{text}`")), "_hash": digest,
    }


def _dealt(docs: DataFrame, weights: Sequence[int], share: float, seed: str, text: str, source: str, row_id: str) -> DataFrame:
    """Each row's key, size, hash, its source's figures, and ``_part``: the words of the last, partial epoch."""
    keys = _row_keys(text, source, row_id, seed)
    sizes = materialize(docs.select(F.col(f"`{row_id}`").alias("doc_id"), *[c.alias(n) for n, c in keys.items()]), "sizes")
    budgets = small_side(materialize(source_budgets(sizes, weights, share), "budgets"), BROADCAST_SOURCES)
    spot = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    rows = sizes.join(budgets, "_key").withColumn("_range", F.shiftright(spot * F.col("_ranges"), 32))
    earlier = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = rows.groupBy("_key", "_range").agg(F.sum("_size").alias("_in"))
    ranges = ranges.select("_key", "_range", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_key", "_range").orderBy("_hash", "doc_id", "_size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(ranges, ["_key", "_range"])
    before = F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumns({"_at": before, "_epochs": epochs}).withColumn("_rest", budget - F.col("_epochs") * F.col("source_size"))
    return rows.withColumn("_part", F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_rest") - F.col("_at"))))


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, seed: str = "mix", text: str = "text", source: str = "source", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``.

    ``taken``: words the mix takes of this row, the last one at the cut in part, so that each source's sum is its
    target rounded down.
    """
    rows = _dealt(docs, weights, share, seed, text, source, row_id)
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_epochs") * F.col("_size") + F.col("_part")).alias("taken"))


def mix_rows(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.0, seed: str = "mix", text: str = "text", source: str = "source", row_id: str = "doc_id") -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it, whole, the row at the cut included; rows without words only in whole epochs.

    A source's rows are taken in the order of their hash, so a source's mix is its number of epochs and the last row
    taken once more: a table with a row a source, and texts are never shuffled.
    """
    rows = _dealt(docs, weights, share, seed, text, source, row_id)
    place = F.struct("_hash", "doc_id", "_size")
    cuts = rows.groupBy("_key").agg(F.max("_epochs").alias("_epochs"), F.max(F.when(F.col("_part") > 0, place)).alias("_cut"))
    mine, theirs, epochs, cut, copy = (unused(docs, f"_mix_{n}") for n in ("mine", "key", "epochs", "cut", "copy"))
    cuts = small_side(materialize(cuts.select(F.col("_key").alias(theirs), F.col("_epochs").alias(epochs), F.col("_cut").alias(cut)), "cuts"), BROADCAST_SOURCES)
    keys = _row_keys(text, source, row_id, seed)
    own = F.struct(keys["_hash"].alias("_hash"), F.col(f"`{row_id}`").alias("doc_id"), keys["_size"].alias("_size"))
    dealt = docs.withColumn(mine, F.struct(own.alias("place"), keys["_key"].alias("key")))
    dealt = dealt.join(cuts, F.col(mine)["key"] == F.col(theirs))
    once = F.coalesce((F.col(mine)["place"] <= F.col(cut)) & (F.col(mine)["place"]["_size"] > 0), F.lit(False)).cast("long")
    copies = F.col(epochs) + once
    return dealt.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>")))).select(*columns_of(docs))
