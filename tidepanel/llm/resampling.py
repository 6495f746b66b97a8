"""Importance resampling of documents towards a target's distribution of hashed words.

Features are runs of words, hashed to buckets. A bucket's gain is the log ratio of its smoothed rates in the target and
in the corpus; a document's weight is the sum over its features, taken from an array of gains. Gumbel noise from the
document's id turns the largest scores into a draw without replacement in proportion to the weights.

The draw: hash-sampled keys give cuts that divide the eligible documents into ranges of score, best first; exact counts
a range tell which ranges the draw reaches, and at which rank each begins. Only these ranges' rows are sorted, in runs by
partition, and a range's runs meet in one group, where a tournament tree merges them, stops after the last rank and
emits the ranks. Cuts only balance the work: any cuts give the same ranks.

Defined results: null is the empty text, with no features, weight 0 and no rank; a text of any length is read whole, in
memory of several times its length; ties in score go to the smaller id, rows without an id last; rows that are alike in
id and score share a draw in any order; the noise of a row without an id is that of the empty id; an empty table gives
an empty table; an empty target gives gains from the corpus alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize
from .shingles import slices, text_buffers

#: Buckets of features, words of a feature at most, words of a document that may be drawn at least.
BUCKETS, RUN, LEAST = 10_000, 1, 20
#: Documents of a range, about, and ranges at most; keys looked at for each cut.
RANGE, RANGES, KEYS = 1_024, 65_536, 16
#: Texts are hashed in slices of about so many bytes, and this many features at once; longer features one by one.
SLICE, FEATURES, LONG = 1 << 20, 1 << 20, 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32_slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of each slice of ``data``: all slices take a step at once, those that have ended drop out."""
    short = np.minimum(sizes, LONG + 1)
    order = np.argsort(-short.astype(np.int16), kind="stable")
    begins, left = starts[order], short[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(LONG, int(left.max(initial=0)))):
        m = int(np.searchsorted(-left, -k, "left"))  # slices longer than k
        state[:m] = _CRC[(state[:m] ^ data[begins[:m] + k]) & 255] ^ (state[:m] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = zlib.crc32(data[starts[k] : starts[k] + sizes[k]])
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, the text that it is from, and each text's number of words; features by length, then place."""
    n = len(offsets) - 1
    line = np.full(len(data) + n + 1, 32, np.uint8)
    if len(data):
        line[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _FOLD[data]
    word = _WORD[line]
    edge = word[1:] != word[:-1]
    places = np.flatnonzero(edge) + 1
    starts, ends = places[::2], places[1::2]
    owner = np.searchsorted(offsets[1:] + np.arange(1, n + 1), starts, "right")
    if run > 1:  # words with one space between
        keep = word.copy()
        keep[ends] = True
        kept = np.cumsum(keep) - keep
        line, starts, ends = np.where(word, line, 32)[keep], kept[starts], kept[ends]
    found, owners = [], []
    for size in range(1, run + 1):
        first = np.flatnonzero(owner[: len(owner) - size + 1] == owner[size - 1 :]) if size > 1 else np.arange(len(owner))
        for a in range(0, len(first), FEATURES):
            part = first[a : a + FEATURES]
            found.append(crc32_slices(line, starts[part], ends[part + size - 1] - starts[part]).astype(np.int64) % buckets)
            owners.append(owner[part])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found]), np.concatenate([empty, *owners]), np.bincount(owner, minlength=n)


def _counted(run: int, buckets: int, size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets, size):
                found, _, _ = feature_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], run, buckets)
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return task


def bucket_counts(texts: DataFrame, *, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends one row a bucket at most."""
    counted = in_arrow(texts.select(F.col(f"`{text}`").alias("text")), _counted(run, buckets, SLICE), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # as many rows as buckets at most
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """The thousandfold log ratio of each bucket's smoothed rate in the target and in the corpus, rounded down."""
    t, s = float(target.sum()) + len(target), float(corpus.sum()) + len(corpus)
    return np.array([math.floor(1000 * math.log((a + 1.0) * s / ((b + 1.0) * t))) for a, b in zip(target.tolist(), corpus.tolist())], np.int64)


def noise(seed: str, row_id: int | None) -> int:
    """Gumbel noise of a document, a thousandfold and rounded down, from a digest of the seed and its id."""
    h = int(hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(shared, run: int, seed: str, size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in slices(offsets, size):
                found, owner, words = feature_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], run, len(gain))
                weight = np.zeros(b - a, np.int64)
                np.add.at(weight, owner, gain[found])
                score = weight + np.array([noise(seed, i) for i in ids[a:b]], np.int64)
                yield pa.record_batch([batch.column(0).slice(a, b - a), *map(pa.array, (words, np.bincount(owner, minlength=b - a), weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return task


#: What orders documents: the largest score, then the smallest id, those without one last, then what may still differ.
KEY = ("up", "void", "id", "n_features")


def _keyed(scored: DataFrame) -> DataFrame:
    """``KEY`` and ``weight``; all columns are longs without nulls."""
    return scored.select((-F.col("score")).alias("up"), F.col("doc_id").isNull().cast("long").alias("void"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "n_features", "weight")


def _cuts(keyed: DataFrame, rows: int) -> list[tuple[int, ...]]:
    """The upper ends of ranges of about ``RANGE`` rows or, of many rows, of up to ``RANGES`` ranges; the last range has none."""
    ranges = min(RANGES, -(-rows // RANGE))
    if ranges < 2:
        return []
    place = F.pmod(F.xxhash64(*KEY), F.lit(1 << 30)) / float(1 << 30)
    drawn = sorted(tuple(r) for r in keyed.where(place < min(1.0, KEYS * ranges / rows)).select(*KEY).collect())  # about KEYS * RANGES rows at most
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def _range_of(batch: pa.RecordBatch, cuts: list[tuple[int, ...]], tops: np.ndarray) -> np.ndarray:
    """The range of each row: the number of cuts before its key."""
    up = batch.column(0).to_numpy()
    low, high = np.searchsorted(tops, up, "left"), np.searchsorted(tops, up, "right")
    tied = np.flatnonzero(low < high)
    if len(tied):
        keys = zip(*[batch.column(k).take(pa.array(tied)).to_pylist() for k in range(len(KEY))])
        low[tied] = [bisect_left(cuts, key, a, b) for key, a, b in zip(keys, low[tied].tolist(), high[tied].tolist())]
    return low


def _range_counts(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        tops, total = np.array([c[0] for c in cuts], np.int64), np.zeros(len(cuts) + 1, np.int64)
        for batch in batches:
            total += np.bincount(_range_of(batch, cuts, tops), minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], names=["range", "n"])

    return task


def _runs(shared):
    """Cuts the sorted rows of a partition into runs, one a range and batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        tops = np.array([c[0] for c in cuts], np.int64)
        for batch in batches:
            place = _range_of(batch, cuts, tops)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]]).astype(np.int32)
            if len(place):
                lists = [pa.ListArray.from_arrays(pa.array(edges), column) for column in batch.columns]
                yield pa.record_batch([pa.array(place[edges[:-1]].astype(np.int64)), *lists], names=["range", *KEY, "weight"])

    return task


class Tournament:
    """A tree of losers over sorted runs of keys: each step gives the run with the smallest head, one match a level."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        winners = [*([-1] * size), *range(len(runs)), *([-1] * (size - len(runs)))]  # -1: no run, loses always
        self.losers = [-1] * size
        for node in range(size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if size > 1 else (0 if runs else -1)

    def _before(self, a: int, b: int) -> bool:
        """Whether the head of run ``a`` comes before that of ``b``; a run that has ended has none."""
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        if b < 0 or self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or x == y and a < b

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Run and place in it, of one key after the other."""
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            now = self.winner
            yield now, self.at[now]
            self.at[now] += 1
            node = (self.size + now) // 2
            while node:
                if self._before(self.losers[node], now):
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


def _merged(begins, draws: int):
    """Merges the runs of one range; ranks go on from the range's first one, and end with the draw."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        held = [frame[c].tolist() for c in (*KEY, "weight")]
        runs = [list(zip(*(column[k].tolist() for column in held[:-1]))) for k in range(len(frame))]
        first = begins.value[int(frame["range"].iloc[0])]
        out, left = [], draws - first
        tree = Tournament(runs)
        for run, place in tree:
            if left <= 0:
                tree.at[run] = place  # the draw is complete; what remains has no rank
                break
            out.append((run, place, draws - left + 1))
            left -= 1
        out += [(run, place, None) for run, at in enumerate(tree.at) for place in range(at, len(runs[run]))]
        rows = [(runs[r][p], held[-1][r][p], rank) for r, p, rank in out]
        return pd.DataFrame({
            "doc_id": pd.array([None if k[1] else k[2] for k, _, _ in rows], "Int64"), "n_features": [k[3] for k, _, _ in rows], "weight": [w for _, w, _ in rows],
            "score": [-k[0] for k, _, _ in rows], "rank": pd.array([r for _, _, r in rows], "Int64"),
        })

    return merge


def resample(
    docs: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text", row_id: str = "doc_id", run: int = RUN, buckets: int = BUCKETS,
    least: int = LEAST, draw: tuple[int, int] = (10, 100), seed: str = "2024",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs``; of the rows with ``least`` words, the share ``draw`` gets a rank."""
    spark = docs.sparkSession
    corpus = docs.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    gain = spark.sparkContext.broadcast(gains(bucket_counts(target, text=target_text, run=run, buckets=buckets), bucket_counts(corpus, run=run, buckets=buckets)))
    scored = materialize(in_arrow(corpus, _scored(gain, run, seed, SLICE), "doc_id long, n_words long, n_features long, weight long, score long"), "scored")
    may = F.col("n_words") >= least
    rows = scored.where(may).count()
    draws = draw[0] * rows // draw[1]
    none = F.lit(None).cast("long").alias("rank")
    columns = ("doc_id", "n_features", "weight", "score")
    if not draws:
        return scored.select(*columns, none)
    keyed = _keyed(scored.where(may))
    cuts = _cuts(keyed, rows)
    shared = spark.sparkContext.broadcast(cuts)
    counts = in_arrow(keyed, _range_counts(shared), "range long, n long").groupBy("range").agg(F.sum("n").alias("n"))
    begins, total = {}, 0
    for place, n in sorted(counts.collect()):  # a row a range
        if total < draws:
            begins[place] = total
        total += n
    last = max(begins)
    inside = F.lit(True)
    if last < len(cuts):  # keys up to the upper end of the last range that the draw reaches
        inside = F.struct(*KEY) <= F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(KEY, cuts[last])])
    runs = in_arrow(keyed.where(inside).sortWithinPartitions(*KEY), _runs(shared), "range long, " + ", ".join(f"{c} array<long>" for c in (*KEY, "weight")))
    ranked = runs.groupBy("range").applyInPandas(_merged(spark.sparkContext.broadcast(begins), draws), "doc_id long, n_features long, weight long, score long, rank long")
    outside = keyed.where(~inside).select(F.when(F.col("void") == 0, F.col("id")).alias("doc_id"), "n_features", "weight", (-F.col("up")).alias("score"), none)
    return ranked.unionByName(outside).unionByName(scored.where(~may).select(*columns, none))


def drawn(docs: DataFrame, ranked: DataFrame, *, row_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id has a rank in ``ranked``, which :func:`resample` gave."""
    ids = ranked.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias(row_id)).distinct()
    return docs.join(ids, row_id, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
