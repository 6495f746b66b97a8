"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import new_path as new_path
from ..sources.scratch import settled as materialize

#: The blank characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
#: A word, for regular expressions of Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more rows may be hot: it is broadcast, or split.
HOT = 1_000


def give_back() -> None:
    """Hands memory that a task has freed back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # not every C library keeps what is freed
        trim(0)


def in_arrow(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, drop: Callable[[], None] | None = None) -> DataFrame:
    """``frame.mapInArrow(run, schema)``; when a task ends, ``drop`` clears what its module keeps, and memory goes back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if drop is not None:
                drop()
            give_back()

    return frame.mapInArrow(task, schema)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else as it is, so that the join shuffles. It is read twice, so it should be a written table."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def hot_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``key, n`` for the keys with more than ``max(HOT, rows / 100,000)`` of the ``rows`` rows of ``df``: below 100,000 keys, so they can be broadcast."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT, rows // 100_000))
    return F.broadcast(materialize(counts, "hot"))


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hashed_sample(rows: DataFrame, group: str, row_id: str, most: int) -> DataFrame:
    """Up to ``most`` rows of each group, the first by a hash of their id, with their place ``k``.

    Rows are first thinned by their hash to about twice as many, by the group's size, so that the ranking gets as few
    rows of a large group as of a small one.
    """
    digest = F.md5(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary"))
    sizes = small_side(materialize(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")), "sizes"), 100_000)
    spot = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("double") / 2.0**32
    thinned = rows.withColumn("_digest", digest).join(sizes, group).where(spot * F.col("_rows") < 2.0 * most + 100)
    ranked = thinned.withColumn("k", F.row_number().over(W.partitionBy(group).orderBy("_digest", row_id)))
    return ranked.where(F.col("k") <= most).drop("_digest", "_rows")
