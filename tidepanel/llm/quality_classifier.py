"""Compression classifier for quality: one zstandard dictionary from good and one from bad labelled text.

A text is compressed in pieces with either dictionary; the difference of the two sizes per byte, averaged over the
whole text, is the only feature. A logistic curve, fitted on labelled texts that went into neither dictionary and
weighted to the classes' shares, makes it a probability.

Defined results: null and empty texts have feature 0 and get the curve's value there; rows without id are never held
out; a document with several labels counts with its lowest; without training texts of both classes every score is the
share of good ones (0.5 without any); repeated rows score alike; a text of any length is scored whole, piece by piece;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample
from .shingles import text_buffers

#: Labelled texts a class, chosen by hash: the first half for its dictionary, the rest for the curve.
SAMPLE = 2_000
#: Bytes of a dictionary, of a piece, and of a training text's share (its pieces evenly spread over the whole text).
DICTIONARY, PIECE, SHARE = 112_640, 1_024, 16_384
LEVEL = 3


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        return [make(self.good), make(self.bad)]

    def score(self, feature: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * feature + self.bias, -50, 50)))


def feature(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> float:
    good, bad = (sum(len(c.compress(p)) for p in pieces(text)) for c in compressors)
    return (bad - good) / max(1, len(text))


def _dictionary(frame: pd.DataFrame) -> pd.DataFrame:
    samples = []
    for text in frame.sort_values("k")["text"]:
        own = pieces(text.encode())
        samples += own[:: max(1, -(-len(own) * PIECE // SHARE))]
    samples = [s for s in samples if s]
    try:
        made = zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        made = b"".join(samples)[-DICTIONARY:]
    return pd.DataFrame({"quality": [int(frame["quality"].iloc[0])], "dictionary": [made]})


def _features(good: bytes, bad: bytes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = Model(good, bad, 0.0, 0.0).compressors()
        for frame in frames:
            yield pd.DataFrame({"quality": frame["quality"], "feature": [feature(t.encode(), both) for t in frame["text"]]})

    return run


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of one feature by Newton steps, with a small ridge."""
    scale = float(np.abs(x).std() or np.abs(x).max() or 1.0)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", row_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learns from ``labels(doc_id, quality)`` of the rows of ``docs``. The driver gets two dictionaries and ``sample`` numbers a class."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = docs.where(F.col(text).isNotNull()).select(F.col(row_id).alias("_id")).distinct().join(marks, "_id")
    chosen = hashed_sample(known, "quality", "_id", sample).persist()
    shares = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    texts = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "_id").persist()  # 2 * sample narrow rows
    made = {r["quality"]: bytes(r["dictionary"]) for r in texts.where(F.col("k") <= sample // 2).groupBy("quality").applyInPandas(_dictionary, "quality int, dictionary binary").collect()}
    good_share = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
    if len(made) == 2 and all(made.values()):
        rest = texts.where(F.col("k") > sample // 2).select("quality", "text").mapInPandas(_features(made[1], made[0]), "quality int, feature double").toPandas()
        if rest["quality"].nunique() < 2:
            rest = texts.select("quality", "text").mapInPandas(_features(made[1], made[0]), "quality int, feature double").toPandas()
        y = rest["quality"].to_numpy(float)
        weight = np.where(y == 1, good_share / max(1, y.sum()), (1 - good_share) / max(1, (1 - y).sum())) * len(y)
        model = Model(made[1], made[0], *_curve(rest["feature"].to_numpy(), y, weight))
    else:
        p = min(max(good_share, 1e-6), 1 - 1e-6)
        model = Model(b"", b"", 0.0, float(np.log(p / (1 - p))))
    texts.unpersist()
    chosen.unpersist()
    return model


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        both = model.compressors() if model.slope else None
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            held = data.tobytes()
            x = np.array([feature(held[a:b], both) if both else 0.0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], float)
            yield pa.record_batch([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, *, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, score`` for each row; the model (two dictionaries, 220 kB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scores(shared), "doc_id long, score double")
