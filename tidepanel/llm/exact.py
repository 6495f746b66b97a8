"""Exact copies of whole texts by distributed radix partitioning, from the most significant byte on. No digest decides.

A text is read as its length, eight bytes, and then its own bytes. All texts are one group at first. A round splits every
group by the next bytes of its texts: equal (group, bytes) is a class, counted map-side first. A class of one text, and
one whose texts have ended, is done; the others are the groups of the next round, whose digit is wider. So most texts
are done after the first round, and a text of n bytes after about log n of them.

Copies that lie together are told first, by the same splitting inside a task's batch, and go on as one representative
with all their ids. So a group of copies, however large, has one row a batch to shuffle; Spark's skew handling splits
what is still uneven in the join of texts to their classes, which has one row a class on the other side.

Defined results: null is the empty text, and equal to it; a text of any length is compared whole; of equal texts the row
of the largest id stays, rows without an id last, and of rows that share this id one; an empty table gives an empty
table; other columns are ignored by ``copies`` and kept as they are by ``deduplicate``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, materialize

#: Bytes of the first round after the length, and how much wider each round's digit is.
FIRST, WIDER = 24, 32
#: Copies are told first among texts of so many bytes together.
SLICE = 32 << 20

#: What a representative carries beside its row: its number, the ids of its copies with the largest first, that id, whether its text is null, the text.
_OWN = "_rep long, _ids array<long>, _top long, _void boolean, _bytes binary"


def radix_classes(texts: list[bytes], first: int = FIRST) -> list[list[int]]:
    """The places of equal texts, class by class, by splitting on length and then on ever wider runs of bytes."""
    done: list[list[int]] = []
    begun: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        begun.setdefault(len(t), []).append(k)
    open_, at, width = list(begun.values()), 0, first
    while open_:
        split: list[list[int]] = []
        for group in open_:
            if len(group) == 1 or len(texts[group[0]]) <= at:
                done.append(group)
                continue
            parts: dict[bytes, list[int]] = {}
            for k in group:
                parts.setdefault(texts[k][at : at + width], []).append(k)
            split += parts.values()
        open_, at, width = split, at + width, width * WIDER
    return done


def _first_of(ids: list[int | None], places: list[int]) -> list[int]:
    """Places by id, the largest first, those without one last."""
    return sorted(places, key=lambda k: (ids[k] is not None, ids[k] or 0), reverse=True)


def _representatives(text: int, row_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = pc.fill_null(batch.column(text).cast(pa.large_string()), "").cast(pa.large_binary())
            ids, sizes = batch.column(row_id).cast(pa.int64()).to_pylist(), pc.binary_length(column).to_pylist()
            a = 0
            while a < len(ids):
                b, size = a, 0
                while b < len(ids) and (b == a or size + sizes[b] <= SLICE):
                    size += sizes[b]
                    b += 1
                texts = column.slice(a, b - a).to_pylist()
                classes = [_first_of(ids, [a + k for k in group]) for group in radix_classes(texts)]
                heads = pa.array([c[0] for c in classes], pa.int64())
                held = [[ids[k] for k in c] for c in classes]
                own = [pa.array(range(number, number + len(classes)), pa.int64()), pa.array(held, pa.list_(pa.int64())), pa.array([h[0] for h in held], pa.int64()), pa.array([texts[c[0] - a] for c in classes], pa.binary())]
                number += len(classes)
                own.insert(3, batch.column(text).take(heads).is_null())
                kept = batch.take(heads)
                yield pa.record_batch([*kept.columns, *own], names=[*kept.schema.names, "_rep", "_ids", "_top", "_void", "_bytes"])
                a = b

    return task


def _settled_classes(docs: DataFrame, text: str, row_id: str, results: dict[str, Column]) -> DataFrame:
    """``results`` for each representative, once its class is done.

    They are expressions over the columns of ``docs``, named c0, c1 and so on but for the text, over ``_ids``, ``_void``
    and ``_bytes``, and over the class: ``_size`` (rows), ``_keep`` (the largest id), ``_own`` (whether this is the
    representative whose first row stays).
    """
    place, number = docs.columns.index(text), docs.columns.index(row_id)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    schema = T.StructType([*plain.schema.fields, *T.StructType.fromDDL(_OWN).fields])
    now = in_arrow(plain, _representatives(place, number), schema).drop(f"c{place}").withColumns({"_group": F.lit(0).cast("long"), "_length": F.octet_length("_bytes").cast("long")})
    carried, done, at, width = now.columns, None, 0, FIRST
    now = materialize(now, "copies")
    while True:
        key = ["_group", "_length", "_digit"] if at == 0 else ["_group", "_digit"]  # later groups have one length each
        split = now.withColumn("_digit", F.substring("_bytes", at + 1, width))
        head = F.max(F.struct("_top", (-F.col("_rep")).alias("_first"))).alias("_head")
        classes = split.groupBy(*key).agg(F.count(F.lit(1)).alias("_reps"), F.sum(F.size("_ids")).alias("_size"), head, F.min("_rep").alias("_class"))
        over = (F.col("_reps") == 1) | (F.col("_length") <= at + width)
        named = split.join(classes, key).withColumns({"_over": over, "_keep": F.col("_head._top"), "_own": F.col("_rep") == -F.col("_head._first")})
        ended = [F.when(F.col("_over"), c).alias(f"out_{name}") for name, c in results.items()]
        going = [F.when(~F.col("_over"), F.col("_class" if c == "_group" else c)).alias(c) for c in carried]
        table = materialize(named.select("_over", *ended, *going), "classes")
        out = table.where("_over").select(*[F.col(f"out_{name}").alias(name) for name in results])
        done = out if done is None else done.union(out)
        now, at, width = table.where("not _over").select(*carried), at + width, width * WIDER
        if now.isEmpty():
            return done


def copies(docs: DataFrame, *, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``: its class's row that stays, and how many rows it has."""
    rows = docs.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    results = {"ids": F.col("_ids"), "keep_id": F.col("_keep"), "group_size": F.col("_size"), "own": F.col("_own"), "text_sha256": F.sha2("_bytes", 256)}
    found = _settled_classes(rows, "text", "doc_id", results)
    each = found.select(F.posexplode("ids").alias("_at", "doc_id"), "keep_id", "group_size", "own", "text_sha256")
    return each.select("doc_id", "keep_id", "group_size", (F.col("own") & (F.col("_at") == 0)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, *, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class of equal texts: that of the largest id."""
    place = docs.columns.index(text)
    body = F.when(~F.col("_void"), F.col("_bytes").cast("string"))
    results = {f"c{k}": F.when(F.col("_own"), body if k == place else F.col(f"c{k}")) for k in range(len(docs.columns))} | {"own": F.col("_own")}
    return _settled_classes(docs, text, row_id, results).where("own").drop("own").toDF(*docs.columns)
