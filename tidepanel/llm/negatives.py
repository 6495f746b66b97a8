"""Hard negatives by distributed radix selection over integer scores.

A row's vector is scaled and rounded down to whole numbers, so its inner products are exact integers. Anchors meet all
rows in tiles, a block of rows by a group of anchors. Nothing of a tile's scores leaves its task but histograms: for
each window (an anchor and a range of scores) how many rows have which digit, the most significant first, up to the
digit that holds the wanted row inside the tile. Summed over tiles they locate the digit that holds the k-th row of all;
the next round looks inside that one, and once the score is a single number, into the digits of its ties' ids. When the
k-th row of every window is known, tiles send the rows up to it, and only these are ranked.

The same selection serves twice: an anchor's positives are the first rows of its label, in one window over all scores;
each positive then opens a window of scores for rows of other labels.

Defined results: rows with a null id, label or vector, with null or non-finite components, also once scaled, or with
another number of components than most take no part; zero vectors do. An anchor's other rows are those of other ids; of
rows that share an anchor's id the least label and vector asks; repeated rows are candidates each. Ties go to the
smaller id. Scores beyond 2^61 count as that. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_arrow, materialize

#: Rows of a block and anchors of a group at most, rows of a block at least where there are more tasks to be had, anchors scored at once.
BLOCK, GROUP, LEAST_BLOCK, TOGETHER = 32_768, 32_768, 2_048, 64
#: Bits of a digit.
DIGIT = 12
#: What scores may reach.
MOST = 1 << 61
#: Of each open window, what a tile has to know: its number, the range of scores and the first bits of ids that are left, by how many bits they lie
#: higher, the digit's shift, whether it is of ids, and how many rows are wanted.
ASKED = ("number", "low", "high", "prefix", "above", "shift", "by_id", "need")


def whole_numbers(vector: Column, scale: float) -> Column:
    """Each component times ``scale``, rounded down, as a double; beyond 2^52 doubles are whole, and too large for Spark's own floor."""
    return F.transform(vector.cast("array<double>"), lambda x: F.when(F.abs(x * scale) < float(1 << 52), F.floor(x * scale).cast("double")).otherwise(x * scale))


def _pack(kind: str):
    """All rows of a partition as one: their number, ids, labels and vectors as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if len(b)]
        if parts:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
            vectors = table.column("v").combine_chunks().flatten().to_numpy().astype(kind)
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(ids)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, labels, vectors)]], names=["block", "rows", "ids", "labels", "vectors"])

    return task


def _products(rows: np.ndarray, asked: np.ndarray, most: float) -> np.ndarray:
    """Exact integer inner products of each of ``asked`` with each of ``rows``; all partial sums stay below ``most``."""
    if most < 1 << 53:  # whole numbers that single or double precision holds
        return (asked @ rows.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in asked], object) @ np.array([[int(x) for x in r] for r in rows], object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _ordered(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers in the same order."""
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


def _first_bits(order: np.ndarray, shift: int) -> np.ndarray:
    return order >> np.uint64(shift) if shift < 64 else np.zeros(len(order), np.uint64)


def _digits(score: np.ndarray, order: np.ndarray, window: dict) -> np.ndarray:
    """The digits of the rows that a window has left, the smallest first, up to the one that holds the wanted row."""
    held = np.flatnonzero((score >= window["low"]) & (score <= window["high"]))
    if window["by_id"]:
        own = order[held]
        own = own[_first_bits(own, window["above"]) == np.uint64(window["prefix"] & 0xFFFFFFFFFFFFFFFF)]
        width = window["above"] - window["shift"]
        found = (_first_bits(own, window["shift"]) & np.uint64((1 << width) - 1)).astype(np.int64)
    else:
        found = (window["high"] - score[held]) >> window["shift"]
    if len(found) > window["need"]:
        found = found[found <= np.partition(found, window["need"] - 1)[window["need"] - 1]]
    return found


def _accepted(score: np.ndarray, ids: np.ndarray, order: np.ndarray, window: dict) -> np.ndarray:
    """The places of a tile's rows up to a window's k-th one, k at most."""
    tied = _first_bits(order, window["above"]) <= np.uint64(window["prefix"] & 0xFFFFFFFFFFFFFFFF)
    held = np.flatnonzero((score <= window["high"]) & ((score > window["low"]) | (score == window["low"]) & tied))
    return held[np.lexsort((ids[held], -score[held]))[: window["need"]]] if len(held) > window["need"] else held


def _tiles(same: bool, kind: str, most: float, gather: bool):
    columns = ["anchor", "number", "id", "score"] if gather else ["anchor", "number", "digit", "n"]

    def tile(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[np.ndarray] = []
        for row in index.itertuples():
            ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
            rows, order = np.frombuffer(row.vectors, kind).reshape(row.rows, -1), _ordered(ids)
            for a in range(0, len(asked), TOGETHER):
                part = asked.iloc[a : a + TOGETHER]
                scores = _products(rows, np.array([np.frombuffer(v, kind) for v in part["v"]]), most)
                for score, question in zip(scores, part.itertuples()):
                    mine = labels == question.label
                    may = np.flatnonzero(mine & (ids != question.anchor) if same else ~mine)
                    left, names, order_left = score[may], ids[may], order[may]
                    for values in zip(*(getattr(question, c).tolist() for c in ASKED)):
                        window = dict(zip(ASKED, values))
                        if gather:
                            held = _accepted(left, names, order_left, window)
                            found = np.stack([names[held], left[held]])
                        else:
                            found = np.stack(np.unique(_digits(left, order_left, window), return_counts=True))
                        whose = np.empty((2, found.shape[1]), np.int64)
                        whose[0], whose[1] = question.anchor, window["number"]
                        out.append(np.concatenate([whose, found]))
        return pd.DataFrame(np.concatenate(out, 1).T if out else np.zeros((0, 4), np.int64), columns=columns)

    return tile, ", ".join(f"{c} long" for c in columns)


class Tiles:
    """Blocks of rows and groups of anchors, written to the shared folder."""

    def __init__(self, rows: DataFrame, is_anchor: Column) -> None:
        spark = rows.sparkSession
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        n, most, low, high = rows.agg(F.count(F.lit(1)), F.max(norm), F.min("id"), F.max("id")).first()
        self.rows, self.most = n, float(most or 0) * 1.001 + 1
        self.kind = "float32" if self.most < 1 << 24 else "float64"
        self.bound = int(min(self.most, MOST))
        # ids share all but their last bits; of these, selection looks at the first digit first
        low, high = ((x or 0) + (1 << 63) for x in (low, high))
        self.bits = (low ^ high).bit_length()
        self.prefix = low >> self.bits
        self.blocks = max(1, -(-n // BLOCK), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_BLOCK)))
        self.index = materialize(in_arrow(rows.repartition(self.blocks), _pack(self.kind), "block int, rows int, ids binary, labels binary, vectors binary"), "blocks")
        own = rows.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("_a")).select(F.col("id").alias("anchor"), "_a.*")
        kind = self.kind

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = [np.asarray(v, kind).tobytes() for v in batch.column(2).to_pylist()]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["anchor", "label", "v"])

        self.anchors = materialize(in_arrow(own, packed, "anchor long, label long, v binary"), "anchors")
        self.groups = max(1, -(-self.anchors.count() // GROUP))

    def ask(self, windows: DataFrame, same: bool, gather: bool) -> DataFrame:
        """What all tiles answer for ``windows``: counts of digits, or the rows themselves."""
        lists = windows.groupBy("anchor").agg(*[F.collect_list(c).alias(c) for c in ASKED])
        asked = self.anchors.join(lists, "anchor").withColumn("grp", F.pmod(F.xxhash64("anchor"), F.lit(self.groups)).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        index = self.index.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        tile, schema = _tiles(same, self.kind, self.most, gather)
        return index.groupBy("block", "grp").cogroup(asked.groupBy("block", "grp")).applyInPandas(tile, schema)

    def select(self, windows: DataFrame, same: bool) -> DataFrame:
        """``anchor, number, rank, id, score``: the first ``wanted`` rows of each of ``windows(anchor, number, wanted, low, high)``."""
        signed = self.prefix - (1 << 64) if self.prefix >= 1 << 63 else self.prefix
        now = windows.where("low <= high").select(
            "anchor", "number", F.col("wanted").cast("long").alias("need"), "low", "high", F.lit(signed).cast("long").alias("prefix"), F.lit(self.bits).alias("above"),
            F.col("wanted").cast("long").alias("wanted"), F.col("high").alias("top"), F.lit(False).alias("over"),
        )
        now = materialize(_with_shift(now), "windows")
        while not now.where("not over").isEmpty():
            open_ = now.where("not over")
            counts = self.ask(open_, same, gather=False).groupBy("anchor", "number", "digit").agg(F.sum("n").alias("n"))
            by = W.partitionBy("anchor", "number")
            sums = counts.withColumn("upto", F.sum("n").over(by.orderBy("digit").rowsBetween(W.unboundedPreceding, 0)))
            seen = open_.join(sums, ["anchor", "number"], "left")
            here = (F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))
            seen = seen.groupBy("anchor", "number").agg(F.max(F.when(here, F.struct("digit", "upto", F.col("n").alias("inside")))).alias("_hit"))
            now = materialize(now.where("over").unionByName(_with_shift(_narrowed(open_.join(seen, ["anchor", "number"])))), "windows")
        final = now.withColumns({"high": F.col("top"), "need": F.col("wanted")})
        order = W.partitionBy("anchor", "number").orderBy(F.desc("score"), "id")
        found = self.ask(final, same, gather=True).join(final.select("anchor", "number", "wanted"), ["anchor", "number"])
        return found.withColumn("rank", F.row_number().over(order)).where("rank <= wanted").select("anchor", "number", "rank", "id", "score")


def _with_shift(windows: DataFrame) -> DataFrame:
    """``windows`` with the next digit: of scores while several are left, then of ids."""
    by_id = F.col("low") == F.col("high")
    bits = F.when(by_id, F.col("above")).otherwise(F.length(F.bin(F.col("high") - F.col("low"))))
    return windows.withColumns({"by_id": by_id, "shift": F.greatest(F.lit(0), bits - DIGIT).cast("int")})


def _narrowed(windows: DataFrame) -> DataFrame:
    """``windows`` with the digit ``_hit`` that holds the wanted row taken into what is left of them; without one, all their rows are wanted."""
    hit, digit, shift = F.col("_hit"), F.col("_hit.digit"), F.col("shift")
    step = lambda n: F.call_function("shiftleft", n, shift)
    high = F.when(F.col("by_id"), F.col("high")).otherwise(F.col("high") - step(digit))
    low = F.when(F.col("by_id"), F.col("low")).otherwise(F.greatest(F.col("low"), F.col("high") - step(digit + 1) + 1))
    prefix = F.when(F.col("by_id"), F.call_function("shiftleft", F.col("prefix"), F.col("above") - shift).bitwiseOR(digit)).otherwise(F.col("prefix"))
    above = F.when(F.col("by_id"), shift).otherwise(F.col("above"))
    need = F.col("need") - (F.col("_hit.upto") - F.col("_hit.inside"))
    kept = {"low": low, "high": high, "prefix": prefix, "above": above, "need": need}
    next_ = windows.withColumns({f"_{name}": F.when(hit.isNull(), F.col(name)).otherwise(value) for name, value in kept.items()})
    over = hit.isNull() | (F.col("_hit.inside") == F.col("_need")) | (F.col("_low") == F.col("_high")) & (F.col("_above") == 0)
    return next_.select("anchor", "number", *[F.col(f"_{name}").alias(name) for name in ("need", "low", "high", "prefix", "above")], "wanted", "top", over.alias("over"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: float = 256.0,
    vector: str = "embedding", label: str = "label", row_id: str = "vec_id",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    The first ``negatives`` rows of other labels, for each of an anchor's first ``positives`` rows of its own, whose score
    lies within ``band`` per cent of the positive's.
    """
    v = whole_numbers(F.col(f"`{vector}`"), scale)
    rows = vectors.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    sound = ~F.exists("v", lambda x: F.isnull(x) | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = materialize(rows, "vectors")
    usual = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size("v") == (usual[0] if usual else 0))
    tiles = Tiles(rows, F.col("_anchor"))
    whole = tiles.anchors.select("anchor", F.lit(0).cast("long").alias("number"), F.lit(positives).alias("wanted"), F.lit(-tiles.bound).cast("long").alias("low"), F.lit(tiles.bound).cast("long").alias("high"))
    first = materialize(tiles.select(whole, same=True).select("anchor", F.col("rank").cast("long").alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    rest = F.pmod("positive_score", F.lit(100))
    hundreds = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
    low, high = hundreds * band[0] + F.ceil(rest * band[0] / 100), hundreds * band[1] + F.floor(rest * band[1] / 100)
    windows = first.select("anchor", "number", F.lit(negatives).alias("wanted"), F.greatest(low, F.lit(-tiles.bound)).alias("low"), F.least(high, F.lit(tiles.bound)).alias("high"))
    found = tiles.select(windows, same=False).join(first, ["anchor", "number"])
    return found.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
