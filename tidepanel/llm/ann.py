"""Nearest neighbours by largest inner product, through collision-counting hashing.

Vectors get one coordinate more, so that the largest inner product is the smallest distance. Blocks of rows are indexed
by PROJECTIONS sorted arrays, one for each direction of random orthogonal bases. A query looks at a window around its
own place in each array; windows widen from round to round (virtual rehashing), and each round reads only what they gain
at either end, or, where they gain much, counts anew over all rows' ranks. Rows that lie in enough windows are verified
by their exact inner product. A query is done with a block when its k-th best verified row is nearer than the radius for
which the count's threshold holds; at the widest, every row is verified. The first radius comes from the k-th distances
of a sample of the block's own rows.

A task is a block and a group of queries, both of bounded size and about alike in bytes: so the index is shuffled once
for every GROUP queries. Each query's best rows of all blocks are then ranked together.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another length than most
take no part; ties go to the smaller id; a query's own id is no candidate; a repeated query id is asked
once; with fewer than k candidates all are returned; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Sorted arrays; rows of a block, half of what 16-bit ranks allow, and queries of a group, about; queries searched side by side.
PROJECTIONS, BLOCK, GROUP, TOGETHER = 64, 32_768, 32_768, 64
#: Half width of a window at radius r, in units of r / sqrt(dimensions); deviations by which the threshold lies below the expected count.
WIDTH, SLACK = 1.1, 0.9
#: Rows of a block whose k-th distances give the first radius, the share of the least of them, and the growth from round to round.
PROBES, FIRST, GROWTH = 32, 0.9, 1.08
#: The share of all entries that a round has to gain for a count over whole rank arrays instead, and the rows counted at once in it.
DENSE, STRIP = 0.25, 2048
_EXPECTED = 0.7287  # the share of a normal distribution within WIDTH deviations


def directions(dimensions: int, seed: int = 11) -> np.ndarray:
    """PROJECTIONS unit vectors as columns: random orthogonal bases, one after the other."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0] for _ in range(-(-PROJECTIONS // dimensions))]
    return np.concatenate(bases, 1)[:, :PROJECTIONS]


class Block:
    """The index of one block: ids, vectors, and for each direction the sorted projections and the rows in their order.

    ``touched`` counts the entries of sorted arrays that searches have read, ``verified`` the inner products taken.
    """

    touched = verified = 0
    ranks: np.ndarray | None = None

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, k: int) -> None:
        self.ids, self.vectors, self.longest = ids, vectors, longest
        self.axes = directions(vectors.shape[1] + 1)
        norms = (vectors**2).sum(1)
        extra = np.sqrt(np.maximum(0, longest**2 - norms))
        places = vectors @ self.axes[:-1] + extra[:, None] * self.axes[-1]
        order = np.argsort(places, 0, kind="stable")
        self.places = np.ascontiguousarray(np.take_along_axis(places, order, 0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.uint16))
        probes = np.linspace(0, len(ids) - 1, min(PROBES, len(ids))).astype(int)
        near = np.sort(vectors[probes] @ vectors.T, 1)[:, max(0, len(ids) - 1 - k)]
        length2 = norms[probes] + longest**2
        self.first = FIRST * float(np.sqrt(np.maximum(1 - 2 * near / length2, 1e-4).min()))

    def inside(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many of the windows [low, high) each row lies, from all rows' ranks: a row below a window wraps round."""
        if self.ranks is None:
            self.ranks = np.empty_like(self.order)
            np.put_along_axis(self.ranks, self.order.astype(np.int64), np.arange(len(self.ids), dtype=np.uint16)[None, :], 1)
        counts = np.empty(len(self.ids), np.uint8)
        first, size = low.astype(np.uint16)[:, None], (high - low).astype(np.uint16)[:, None]
        for at in range(0, len(counts), STRIP):
            within = (self.ranks[:, at : at + STRIP] - first) < size
            np.add.reduce(within.view(np.uint8), 0, dtype=np.uint8, out=counts[at : at + STRIP])
        self.touched += self.ranks.size
        return counts

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and inner products of its k best verified rows, best first."""
        m, n, count = len(self.places), len(self.ids), len(query_ids)
        at = queries @ self.axes[:-1]
        length2 = (queries**2).sum(1) + self.longest**2
        needed = max(1, int(np.floor(m * _EXPECTED - SLACK * np.sqrt(m * _EXPECTED * (1 - _EXPECTED)))))
        done = self.ids[None, :] == query_ids[:, None]
        seen = np.zeros((count, n), np.uint8)
        low = np.stack([np.searchsorted(p, at[:, j]) for j, p in enumerate(self.places)], 1)
        high = low.copy()
        found: list[list[np.ndarray]] = [[] for _ in query_ids]
        scores: list[list[np.ndarray]] = [[] for _ in query_ids]
        radius = self.first * np.sqrt(length2)
        room = np.empty_like(self.vectors)
        active = np.arange(count)
        while len(active):
            half = (WIDTH / np.sqrt(self.axes.shape[0])) * radius[active]
            left = np.stack([np.searchsorted(p, at[active, j] - half, "left") for j, p in enumerate(self.places)], 1)
            right = np.stack([np.searchsorted(p, at[active, j] + half, "right") for j, p in enumerate(self.places)], 1)
            going = []
            for row, q in enumerate(active.tolist()):
                a, b, c, d = left[row], low[q].copy(), high[q].copy(), right[row]
                low[q], high[q] = np.minimum(a, b), np.maximum(c, d)
                entries = int((b - low[q]).sum() + (high[q] - c).sum())
                if entries > DENSE * self.order.size:
                    seen[q] = self.inside(low[q], high[q])
                elif entries:
                    ends = zip(self.order, low[q].tolist(), b.tolist(), c.tolist(), high[q].tolist())
                    met = np.concatenate([x for o, a0, b0, c0, d0 in ends for x in (o[a0:b0], o[c0:d0])])
                    self.touched += entries
                    seen[q] += np.bincount(met, minlength=n).astype(np.uint8)
                fresh = np.flatnonzero((seen[q] >= needed) & ~done[q])
                if len(fresh):
                    self.verified += len(fresh)
                    done[q, fresh] = True
                    found[q].append(fresh)
                    scores[q].append(np.take(self.vectors, fresh, 0, out=room[: len(fresh)], mode="clip") @ queries[q])
                have = sum(map(len, found[q]))
                if done[q].all():
                    continue
                if have >= k and length2[q] - 2 * np.partition(np.concatenate(scores[q]), have - k)[have - k] <= radius[q] ** 2:
                    continue
                going.append(q)
            active = np.array(going, np.int64)
            radius[active] *= GROWTH
        return [self._best(queries[q], np.concatenate(found[q] or [np.zeros(0, np.int64)]), np.concatenate(scores[q] or [np.zeros(0)]), k) for q in range(count)]

    def _best(self, query: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(found) > k:  # a little more than k, for ties that rounding hides
            least = np.partition(scores, len(found) - k)[len(found) - k]
            found = found[scores >= least - 1e-9 * max(1.0, abs(least))]
        exact = (self.vectors[found] * query).sum(1)
        best = np.lexsort((self.ids[found], -exact))[:k]
        return self.ids[found][best], exact[best]


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _build(longest: float, k: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for a in range(0, len(frame), 2 * BLOCK - 1):  # more only if one id is repeated without end
            part = frame.iloc[a : a + 2 * BLOCK - 1]
            ids = part["vec_id"].to_numpy(np.int64)
            vectors = np.array(part["v"].tolist(), np.float64)
            block = Block(ids, vectors, longest, k)
            rows.append([int(part["block"].iloc[0]), len(ids), block.first, *[x.tobytes() for x in (ids, vectors, block.order, block.places)]])
        return pd.DataFrame(rows, columns=["block", "rows", "first", "p0", "p1", "p2", "p3"])

    return run


def _restored(row, longest: float) -> Block:
    block = Block.__new__(Block)
    block.longest = longest
    block.ids = np.frombuffer(row.p0, np.int64)
    block.vectors = np.frombuffer(row.p1, np.float64).reshape(row.rows, -1)
    block.first = row.first
    block.order = np.frombuffer(row.p2, np.uint16).reshape(-1, row.rows)
    block.places = np.frombuffer(row.p3, np.float64).reshape(-1, row.rows)
    block.axes = directions(block.vectors.shape[1] + 1)
    return block


def _search(longest: float, k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in index.itertuples():
            block = _restored(row, longest)
            for a in range(0, len(queries), TOGETHER):
                part = queries.iloc[a : a + TOGETHER]
                asked = part["vec_id"].to_numpy(np.int64)
                results = block.search(asked, np.array(part["v"].tolist(), np.float64), k)
                out += [pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores}) for q, (ids, scores) in zip(asked.tolist(), results)]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def build_index(vectors: DataFrame, rows: int, longest: float, k: int) -> DataFrame:
    """One row per block, written to the shared folder."""
    blocks = max(1, -(-rows // BLOCK))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return materialize(dealt.groupBy("block").applyInPandas(_build(longest, k), "block int, rows int, first double, p0 binary, p1 binary, p2 binary, p3 binary"), "index")


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest inner product for each row of ``vectors`` that ``is_query`` picks."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.where(F.col(row_id).isNotNull() & usable(v)).select(F.col(row_id).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("_query"))
    rows = materialize(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()  # the usual length; other vectors take no part
    rows = rows.where(F.size("v") == (common[0] if common else 0))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = rows.agg(F.sqrt(F.max(norm)), F.count(F.lit(1)), F.count(F.when(F.col("_query"), 1))).first()
    longest, n, asked = float(stats[0] or 0), stats[1], stats[2]
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-asked // GROUP))
    index = build_index(rows.select("vec_id", "v"), n, longest, k).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = rows.where("_query").select("vec_id", "v").dropDuplicates(["vec_id"]).withColumn("grp", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = index.groupBy("block", "grp").cogroup(queries.groupBy("block", "grp")).applyInPandas(_search(longest, k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
