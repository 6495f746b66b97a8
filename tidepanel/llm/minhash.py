"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round after round each shingle is hashed to one of T bins and a value; a bin keeps the smallest value of
the first round that reached it. Rounds T to 2T-1 place every shingle in one fixed bin each, so all bins fill. Two sets
agree in a bin with probability equal to their Jaccard similarity.

Bands of ROWS coordinates make buckets. The links between documents of a bucket are found exactly:

1. Documents with the same set are one class from the start, found by a 128-bit fingerprint, map-side first.
2. Each bucket's smallest class is compared with its others, on full sets. Components of these links are formed.
3. Buckets that still hold several components are joined to candidate groups, and within a group all sets are compared,
   block by block; a block task returns a spanning forest of its links, never all pairs.

So a large group of copies costs one comparison a member, and no bucket is capped.

Defined results: null and empty texts have no shingles and link with nothing; a text of fewer words than a shingle is
one shingle; a text of any length gives its whole set, held in one task; repeated rows share a class; rows without an id only follow others' classes; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, columns_of, hot_keys, in_arrow, materialize, small_side, unused
from .components import components
from .shingles import drop_powers, mix, shingle_sets, slices, text_buffers

#: Coordinates a band, and bands: a pair at similarity 0.8 shares no band with probability 2e-6.
ROWS, BANDS = 7, 56
#: Per cent of the union that two linked sets share at least.
THRESHOLD = 80
#: Texts are sketched in slices of about so many bytes.
SLICE = 1 << 20
#: Documents in a block of the exact comparison.
BLOCK = 256
#: Up to so many ids are broadcast to pick their texts from a scan; more are joined.
BROADCAST_IDS = 250_000
_U = np.uint64


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """The fast similarity sketches of non-empty sets of 64-bit numbers, as rows of 32-bit values."""
    filled = np.zeros((len(sets), bins), bool)
    out = np.zeros((len(sets), bins), np.uint32)
    active = np.arange(len(sets))
    for turn in range(2 * bins):
        members = [sets[i] for i in active]
        sizes = np.fromiter(map(len, members), np.int64, len(members))
        values = mix(np.concatenate(members) + _U((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        row = np.repeat(np.arange(len(active)), sizes)
        low = (values & _U(0xFFFFFFFF)).astype(np.int64)
        spot = ((values >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64) if turn < bins else np.int64(turn - bins)
        best = np.full(len(active) * bins, 1 << 32, np.int64)
        np.minimum.at(best, row * bins + spot, low)
        best = best.reshape(len(active), bins)
        new = (best < 1 << 32) & ~filled[active]
        rows, columns = np.nonzero(new)
        out[active[rows], columns] = best[rows, columns].astype(np.uint32)
        filled[active[rows], columns] = True
        active = active[~filled[active].all(1)]
        if not len(active):
            break
    return out


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of ``rows`` coordinates, the band's number included."""
    n, t = sketches.shape
    held = sketches.reshape(n, t // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64) + _U(1), held.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + held[:, :, j])
    return key.view(np.int64)


def _sketched(k: int, rows: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, SLICE):
                part = data[offsets[a] : offsets[b]]
                sets = list(shingle_sets(part, offsets[a : b + 1] - offsets[a], k))
                sizes = np.array([len(s) for s in sets], np.int64)
                first = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                second = np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                full = np.flatnonzero(sizes)
                keys = bands(sketch([sets[i] for i in full], rows * count), rows).ravel() if len(full) else np.zeros(0, np.int64)
                places = np.concatenate([[0], np.cumsum((sizes > 0) * count)]).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(first), pa.array(second), pa.ListArray.from_arrays(pa.array(places), pa.array(keys))],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, SLICE):
                sets = list(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k))
                places = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(places), pa.array(values))], names=["doc_id", "items"])

    return run


def sets_of(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``doc_id, items`` for the rows of ``texts(doc_id, text)`` whose id is in ``ids``."""
    return in_arrow(texts.join(small_side(ids, BROADCAST_IDS), "doc_id", "left_semi"), _sets(k), "doc_id long, items array<long>", drop_powers)


def verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets share ``threshold`` per cent of their union."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = materialize(sets_of(texts, ids, k), "sets")
    # the pairs of an ``a`` that has many are split, and its set goes to each part
    hot = hot_keys(pairs, "a", pairs.count()).select("a", F.ceil(F.col("n") / HOT).alias("_splits"))
    dealt = pairs.join(hot, "a", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("_splits")), F.lit(0).cast("long"))).drop("_splits")
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("_s")).join(hot, "a", "left")
    left = left.select("a", "_s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_splits", F.lit(1)).cast("long") - 1)).alias("_salt"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("_t"))
    both = dealt.join(left, ["a", "_salt"]).join(right, "b")
    common = F.size(F.array_intersect("_s", "_t"))
    return both.where(common * 100 >= (F.size("_s") + F.size("_t") - common) * threshold).select("a", "b").distinct()


def linked_pairs(sets: list[np.ndarray], threshold: int) -> np.ndarray:
    """All pairs of positions whose sets share ``threshold`` per cent of their union, by products of incidence slabs."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    items, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.float32)
    for low in range(0, len(items), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        slab = np.zeros((n, min(4096, len(items) - low)), np.float32)
        slab[row[a:b], column[a:b] - low] = 1
        common += slab @ slab.T
    common = common.astype(np.int64)
    return np.argwhere(np.triu(common * 100 >= (sizes[:, None] + sizes[None, :] - common) * threshold, 1))


def _block_links(threshold: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("doc_id")
        ids, sets = frame["doc_id"].to_numpy(), [np.asarray(s, np.int64) for s in frame["items"]]
        parent = list(range(len(ids)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        kept = []
        for x, y in linked_pairs(sets, threshold).tolist():
            if (r := root(x)) != (s := root(y)):
                parent[s] = r
                kept.append((ids[x], ids[y]))
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return run


def group_links(groups: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """A spanning forest of the exact links inside each of ``groups(node, component)``, by tasks of two blocks each."""
    groups = materialize(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "groups")
    sizes = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sizes, "grp").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumn("other", meets).select("doc_id", "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sets = materialize(sets_of(texts, groups.select("doc_id").distinct(), k), "sets")
    return members.join(sets, "doc_id").groupBy("grp", "i", "j").applyInPandas(_block_links(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: int = THRESHOLD, text: str = "text", row_id: str = "doc_id", rows: int = ROWS, count: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``; links are sets that share ``threshold`` per cent of their union."""
    texts = docs.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    drawn = materialize(in_arrow(texts, _sketched(k, rows, count), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>", drop_powers), "sketches")
    prints = ["n_shingles", "fp1", "fp2"]
    classes = drawn.where("n_shingles > 0").groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    classes = materialize(classes, "classes")
    members = drawn.select("doc_id", *prints).join(small_side(classes, BROADCAST_IDS), prints, "left")
    members = materialize(members.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members")
    copies = members.where("doc_id != rep").select("doc_id").distinct()
    single = drawn.join(small_side(copies, BROADCAST_IDS), "doc_id", "left_anti")

    spread = single.select("doc_id", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("band", "low")
    buckets = materialize(spread.join(shared, "band"), "buckets")
    pairs = materialize(buckets.where("doc_id != low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    links = materialize(verified(pairs, texts, k, threshold), "links")
    found = components(links)

    # buckets of three and more that hold several components: a pair of their members may be untested
    named = buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = named.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("n")).where("c1 < c2 and n > 2").select("band")
    left = buckets.join(mixed, "band", "left_semi").where("doc_id != low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    left = materialize(left, "left")
    if not left.isEmpty():
        stars = found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(stars.union(group_links(components(left), texts, k, threshold)))
    found = materialize(found, "components")
    out = members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    own = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select("doc_id", "n_shingles", component.alias("component_id"), own.alias("kept"))


def deduplicate(docs: DataFrame, *, k: int = 5, threshold: int = THRESHOLD, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id. Rows without an id stay.

    Rows that share an id are one document: they stay or go together, and of those with equal texts one stays.
    """
    judged = near_duplicates(docs, k=k, threshold=threshold, text=text, row_id=row_id)
    key, own = unused(docs, "_key"), F.col(f"`{row_id}`")
    gone = materialize(judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key)).distinct(), "gone")
    left = docs.join(small_side(gone, BROADCAST_IDS), own == F.col(key), "left_anti")
    twice = materialize(docs.where(own.isNotNull()).groupBy(own.alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "twice")
    if twice.isEmpty():
        return left
    twice = small_side(twice, BROADCAST_IDS)
    again = left.join(twice, own == F.col(key), "left_semi").withColumn(key, F.xxhash64(own, F.col(f"`{text}`"))).dropDuplicates([row_id, text] if not {".", "`"} & set(row_id + text) else [key])
    return left.join(twice, own == F.col(key), "left_anti").select(*columns_of(docs)).union(again.select(*columns_of(docs)))
