"""Language identification by language-bitmask n-gram filters.

Training counts byte 4-grams per language; a gram belongs to every language in which it is about as frequent as where
it is most frequent. All memberships go into one bit-sliced Bloom filter: each slot is a mask with one bit a language,
and the AND of a gram's slots is the set of languages that may hold it. A text's grams are looked up at once; the hits
of each language, corrected for its share of false positives, decide.

Defined results: null texts and texts without a letter are ``und`` with score 0; with a letter but no hit, the most
frequent language of the sample with score 0; rows without id are never held out; repeated rows are judged alike; an
empty table gives an empty table; without training rows every text is ``und``; a text of any length is judged whole;
of languages with equal hits the one with more grams in the sample wins, then the first by name; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hashed_sample, in_arrow, materialize, small_side
from .shingles import mix, slices, text_buffers

#: Training texts a language, chosen by hash.
SAMPLE = 1_000
#: Slots of the filter (a power of two), and slots looked up for each gram.
SLOTS, HASHES = 1 << 20, 2
#: A gram belongs to the languages with at least this share of its highest rate, if it was seen this often.
SHARE, SEEN = 0.5, 3
#: Bits in a mask; more languages take further masks.
BITS = 62
#: Texts are looked at in slices of about so many bytes, with some 80 bytes of arrays for each.
SLICE = 1 << 19
#: Up to so many chosen ids are broadcast to pick their texts from a scan; more are joined.
BROADCAST_SAMPLE = 1_000_000
_U = np.uint64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams of the folded texts, two spaces around each, and the n + 1 places where each text's begin."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    buffer = np.full(len(data) + 2 * n + 3, 32, np.uint8)
    if len(data):
        buffer[np.arange(len(data)) + np.repeat(2 * np.arange(1, n + 1), sizes)] = _FOLD[data]
    wide = buffer.astype(np.uint32)
    gram = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    return gram, offsets + 2 * np.arange(n + 1)


def slots_of(gram: np.ndarray) -> list[np.ndarray]:
    h = mix(gram.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    return [((h >> _U(20 * k)) & _U(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    """``masks[w, slot]``: bit b of word w is set if a gram of language w * bits + b falls there."""

    languages: list[str]
    masks: np.ndarray
    bits: int

    def false_rates(self) -> np.ndarray:
        fill = [float(((self.masks[k // self.bits] >> np.int64(k % self.bits)) & 1).mean()) for k in range(len(self.languages))]
        return np.array(fill) ** HASHES

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the best language and its score, for each text."""
        gram, begins = grams(data, offsets)
        gram = gram[: begins[-1]] if len(begins) > 1 else gram[:0]
        n = len(begins) - 1
        total = np.diff(begins).astype(float)
        spots, hits, rates = slots_of(gram), np.zeros((n, len(self.languages))), self.false_rates()
        for w, masks in enumerate(self.masks):
            mask = masks[spots[0]]
            for s in spots[1:]:
                mask &= masks[s]
            for b in range(min(self.bits, len(self.languages) - w * self.bits)):
                ones = np.concatenate([[0], np.cumsum((mask >> np.int64(b)) & 1)])
                hits[:, w * self.bits + b] = ones[begins[1:]] - ones[begins[:-1]]
        own = np.maximum(0, (hits - total[:, None] * rates) / np.maximum(1e-9, 1 - rates))
        best, whole = own.argmax(1), own.sum(1)
        return best, np.where(whole > 0, own.max(1) / np.where(whole > 0, whole, 1), 0.0)


def held_out(row_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for a, b in slices(offsets, SLICE):
            gram, begins = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            names = np.asarray(batch.column(0).slice(a, b - a).to_pylist(), dtype=object)
            owner = np.repeat(np.arange(b - a), np.diff(begins))
            for name in sorted(set(names.tolist())):
                found, times = np.unique(gram[: begins[-1]][(names == name)[owner]], return_counts=True)
                yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "gram", "n"])


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram = np.asarray(batch.column("gram")).astype(np.uint32)
        for spots in slots_of(gram):
            yield pa.record_batch([pa.array(spots), batch.column("word"), batch.column("mask")], names=["slot", "word", "mask"])


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", row_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` texts of each language. What reaches the driver is the filter, of fixed size, and the list of languages."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(row_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    chosen = hashed_sample(rows.select("id", "lang"), "lang", "id", sample).select("id", "lang").distinct()
    texts = rows.join(small_side(materialize(chosen, "sample"), BROADCAST_SAMPLE), ["id", "lang"], "left_semi").select("lang", "text")
    counts = in_arrow(texts, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    seen = {r[0]: r[1] for r in totals.collect()}  # one row a language
    languages = sorted(seen, key=lambda k: (-seen[k], k))
    if not languages:
        counts.unpersist()
        return Model([], np.zeros((1, SLOTS), np.int64), BITS)
    place = docs.sparkSession.createDataFrame([(name, k // BITS, 1 << k % BITS, float(seen[name])) for k, name in enumerate(languages)], "lang string, word int, mask long, total double")
    rates = counts.join(F.broadcast(place), "lang").withColumn("rate", F.col("n") / F.col("total"))  # one row a language
    best = rates.withColumn("best", F.max("rate").over(W.partitionBy("gram"))).where((F.col("rate") >= SHARE * F.col("best")) & (F.col("n") >= SEEN))
    filled = in_arrow(best.select("gram", "word", "mask"), _slot_rows, "slot long, word int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    table = filled.toArrow()  # at most SLOTS rows a mask word
    counts.unpersist()
    masks = np.zeros((-(-len(languages) // BITS), SLOTS), np.int64)
    masks[np.asarray(table["word"]), np.asarray(table["slot"])] = np.asarray(table["mask"])
    return Model(languages, masks, BITS)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        names = np.array(known.languages or ["und"], dtype=object)
        for batch in batches:
            column = batch.column(1)
            data, offsets = text_buffers(column)
            for a, b in slices(offsets, SLICE):
                part, places = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ones = np.concatenate([[0], np.cumsum(_LETTER[part])])
                letter = ones[places[1:]] > ones[places[:-1]]
                for k in np.flatnonzero(~letter & (np.diff(places) > 0)):
                    letter[k] = any(map(str.isalpha, column[a + int(k)].as_py()))
                letter &= bool(known.languages)
                best, score = known.decide(part, places) if known.languages else (np.zeros(b - a, int), np.zeros(b - a))
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(np.where(letter, names[best], "und"), pa.string()), pa.array(np.where(letter, score, 0.0))],
                    names=["doc_id", "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, model: Model, *, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row; the model (8 MB a mask word) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return in_arrow(docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")), _predict(shared), "doc_id long, lang_pred string, score double")
