"""Resampling, exact dedup and hard negatives beside brute force, with odd rows, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import exact, negatives, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = ("lorem Ipsum " * 30_000).strip()
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "漢字 and ÉCOLE"), (5, LONG), (5, LONG), (None, "no id"), (None, None), (7, LONG + "x"), (8, "a"), (9, "a"), (9, "a"), (10, "A")]


def docs(spark, rows):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    for name in ("rank", "score", "weight", "_rep", "_ids", "_group", "c0", "n", "a.b", "Doc"):
        frame = frame.withColumn(name, F.lit(1))
    return frame


# exact copies


def copy_rows():
    rng = random.Random(3)
    rows, n = list(ODD), 100
    bodies = ["".join(rng.choices("abc é\n", k=k)) for k in (0, 1, 23, 24, 25, 40, 791, 792, 793, 30_000)] * 2
    bodies += ["x" * 24 + c for c in "abcab"] + ["y" * 800 + c for c in "abcab"] + ["z" * 26_000 + c for c in "abcab"] + ["a\0b", "a\0b", "a\0c", "\0", "\0\0"]
    for body in bodies * 3:
        rows.append((n, body))
        n += 1
    rng.shuffle(rows)
    return rows + [(5000 + k, "one hot text, again and again, of more than a few bytes") for k in range(400)]


def brute_copies(rows):
    classes = {}
    for i, t in rows:
        classes.setdefault(t or "", []).append(i)
    out = []
    for t, ids in classes.items():
        best = max((i for i in ids if i is not None), default=None)
        kept = ids.index(best)
        out += [(i, best, len(ids), k == kept, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return out


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_copies(spark, parts):
    rows = copy_rows()
    frame = docs(spark, rows).repartition(parts)
    got = [tuple(r) for r in exact.copies(frame).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert order(got) == order(brute_copies(rows))
    assert exact.copies(frame.limit(0)).count() == 0


def test_exact_deduplicate(spark):
    rows = copy_rows()
    frame = docs(spark, rows).repartition(5)
    out = exact.deduplicate(frame)
    assert out.dtypes == frame.dtypes
    wanted = [(i, digest) for i, _, _, own, digest in brute_copies(rows) if own]
    assert order((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()) == order(wanted)
    assert exact.deduplicate(frame.limit(0)).count() == 0


def test_radix_classes():
    rng = random.Random(4)
    for _ in range(300):
        texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 40))]
        wanted = {}
        for k, t in enumerate(texts):
            wanted.setdefault(t, []).append(k)
        assert sorted(map(sorted, exact.radix_classes(texts, 1))) == sorted(wanted.values())


# resampling

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute_resample(rows, target, run=1, buckets=10_000, least=20, draw=(10, 100), seed="2024"):
    def features(t):
        w = re.findall(PATTERN, lowered(t))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(w) - k + 1)], len(w)

    corpus, aim = np.zeros(buckets), np.zeros(buckets)
    for _, t in rows:
        np.add.at(corpus, features(t)[0], 1)
    for t in target:
        np.add.at(aim, features(t)[0], 1)
    gain = [math.floor(1000 * math.log((t + 1) * (corpus.sum() + buckets) / ((s + 1) * (aim.sum() + buckets)))) for s, t in zip(corpus, aim)]
    out = []
    for i, t in rows:
        found, words = features(t)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = [(*r[:4], k + 1 if k < draw[0] * len(may) // draw[1] else None) for k, r in enumerate(may)]
    return ranks + [(*r[:4], None) for r in out if r[4] < least]


@pytest.mark.parametrize("run,draw,ranges", [(1, (10, 100), 1024), (2, (37, 100), 5), (3, (1, 1), 3), (1, (0, 1), 1024)])
def test_resample(spark, monkeypatch, run, draw, ranges):
    monkeypatch.setattr(resampling, "RANGE", ranges)
    monkeypatch.setattr(resampling, "SLICE", 4_000)
    rng = random.Random(run)
    words = [f"W{k}" for k in range(300)] + ["é", "ÀB", "x" * 90, "a-b", "漢"]
    rows = list(ODD) + [(100 + k, " ".join(rng.choices(words[: rng.randint(1, 300)], k=rng.randint(0, 60)))) for k in range(400)]
    rows += [(7000, " ".join(words))] * 12 + [(7001 + k, " ".join(words)) for k in range(30)] + [(None, " ".join(words))] * 3
    target = [None, ""] + [" ".join(rng.choices(words[:40], k=50)) for _ in range(20)]
    frame = docs(spark, rows).repartition(6)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(frame, aim, run=run, draw=draw).select("doc_id", "n_features", "weight", "score", "rank")
    wanted = brute_resample(rows, target, run, draw=draw)
    assert order(map(tuple, got.collect())) == order(wanted)
    ranks = sorted(r[4] for r in wanted if r[4])
    assert ranks == list(range(1, len(ranks) + 1))
    if draw == (10, 100):
        taken = resampling.drawn(frame, got)
        assert taken.columns == frame.columns and {r["doc_id"] for r in taken.collect()} == {r[0] for r in wanted if r[4]} - {None}
        assert resampling.resample(frame.limit(0), aim).count() == 0
        assert resampling.resample(frame, aim.limit(0)).count() == len(rows)


def test_tournament():
    rng = random.Random(9)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 5), k) for k in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        tree = resampling.Tournament(runs)
        assert [runs[r][p] for r, p in tree] == sorted(x for r in runs for x in r)


def test_crc_of_slices():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 500)
    sizes = np.concatenate([rng.integers(0, 70, 480), rng.integers(60, 900, 20)])
    got = resampling.crc32_slices(data, starts, sizes)
    assert got.tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts.tolist(), sizes.tolist())]


# hard negatives


def brute_negatives(rows, scale=256, positives=5, wanted=10):
    sound = [(i, l, [math.floor(scale * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for r in sorted(sound):
        if r[0] % 10 == 0:
            anchors.setdefault(r[0], r)
    out = []
    for i, label, v in anchors.values():
        scores = [(-sum(a * b for a, b in zip(v, w)), j, l) for j, l, w in sound]
        own = sorted(s for s in scores if s[2] == label and s[1] != i)[:positives]
        for p, j, _ in own:
            p = -p
            found = sorted(s for s in scores if s[2] != label and 30 * p <= -100 * s[0] <= 90 * p)[:wanted]
            out += [(i, j, k + 1, m, p, -s) for k, (s, m, _) in enumerate(found)]
    return out


@pytest.mark.parametrize("size,digit", [(1.0, 12), (1.0, 3), (1e4, 12), (1e6, 12)])
def test_hard_negatives(spark, monkeypatch, size, digit):
    monkeypatch.setattr(negatives, "DIGIT", digit)
    monkeypatch.setattr(negatives, "LEAST_BLOCK", 60)
    monkeypatch.setattr(negatives, "GROUP", 9)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(8)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in size * (rng.standard_normal(8) * 0.5 + base)]) for i in range(300)]
    rows += [(i, i % 3, rows[0][2]) for i in range(1000, 1100)]  # ties
    rows += [(2000, 1, rows[5][2])] * 40 + [(-(1 << 62), 0, rows[6][2]), ((1 << 62) + 10, 1, rows[7][2])]
    rows += [(3000, None, rows[1][2]), (3010, 1, None), (None, 1, rows[1][2]), (3020, 1, [None] + rows[1][2][1:]), (3030, 1, [float("nan")] * 8), (3040, 1, [float("inf")] * 8), (3050, 1, [1.0]), (3060, 1, []), (3070, 1, [0.0] * 8), (20, 2, rows[9][2])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    for name in ("anchor", "rank", "id", "v", "a.b"):
        frame = frame.withColumn(name, F.lit(2))
    got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert order(map(tuple, got.collect())) == order(brute_negatives(rows))
    if digit == 3:
        assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
        assert negatives.hard_negatives(frame.where("vec_id = 100"), F.col("vec_id") % 10 == 0).count() == 0
