"""Inputs at the edge: very long words and numbers, names that clash, a number run with a stray digit."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import bpe, langid, pii, tagger, warc

DOCS = "doc_id long, text string, lang string"


def test_a_word_of_a_million_letters():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    rng = random.Random(5)
    for word in ("".join(rng.choices("etaoinshrdlucmf", k=1_000_000)), "ab" * 200_000, "a" * 300_000, "漢字" * 50_000):
        began = time.perf_counter()
        got = vocabulary.encode_words([word])[0]
        assert time.perf_counter() - began < 60
        assert got == reference.encode(word, add_special_tokens=False).ids


def test_merging_by_heap_is_exact():
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    rng = random.Random(6)
    for _ in range(2000):
        word = "".join(rng.choices("aabcehilnorst", k=rng.randint(1, 50)))
        assert vocabulary.merge(word) == reference.encode(word, add_special_tokens=False).ids


def test_numbers_of_thousands_of_digits(spark):
    texts = []
    for k in range(4):
        parts = ["1", "2", "3", "4"]
        for value in ("0" * 10_000, "0" * 10_000 + "255", "0" * 10_000 + "256", "9" * 10_000):
            texts.append("x " + ".".join(parts[:k] + [value] + parts[k + 1 :]) + " y")
    texts += ["5" * 20_000, "+1 " + "2" * 20_000, "1 " * 20_000, "a@" + "1." * 20_000]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["base"] for r in pii.find_personal_data(rows).collect()}
    assert [bool(got[i]) for i in range(16)] == [True, True, False, False] * 4
    assert pii.mask_personal_data(rows).count() == len(texts)


def test_a_card_among_stray_digits():
    assert pii._grouped("card", "4111 1111 1111 1111 2", 3) == [("card", 3, 22)]
    assert pii._grouped("card", "7 4111-1111-1111-1111", 0) == [("card", 2, 21)]
    assert pii._grouped("phone", "12 (555) 123-4567 ext. 3", 0) != []
    assert pii._grouped("card", "1 " * 10_000, 0) == [] and pii._grouped("card", "", 0) == []
    weights = tagger.train()
    text = 'the card 4111 1111 1111 1111 2 and password = "hunter2hunter2hunter2" went'
    ((base, spans),) = pii.all_spans([text], weights)
    assert not base and {text[b:e] for _, b, e in spans} == {"4111 1111 1111 1111", "hunter2hunter2hunter2"}


def test_weights_lie_on_a_grid():
    assert all(((v * tagger.GRID) % 1 == 0).all() and v.dtype == "float32" for v in tagger.train().values())


def test_language_columns_may_have_any_name(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice({"aa": ["abcd", "bcde"], "bb": ["wxyz", "vwxy"]}[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("_c", "_l", "id", "k", "_digest", "_rows", "a.b"):
        frame = frame.withColumn(name, F.lit("x"))
    model = langid.train(frame)
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame, model).collect()} == {i: lang for i, _, lang in rows}


def test_archives_of_pages_of_very_different_sizes(spark, tmp_path, monkeypatch):
    """Files are cut by bytes, also where a task's pages are all large."""
    monkeypatch.setattr(warc, "FILE", 1 << 20)
    small = [(k, "u", f"page {k} " * 12) for k in range(20_000)]
    large = [(100_000 + k, "u", chr(97 + k % 26) * (100_000 + k)) for k in range(100)] + [(200_000, "u", "é" * 3_000_000)]
    pages = spark.createDataFrame(small + large, "page_id long, url string, html string").repartitionByRange(3, "page_id")
    warc.write_warc(pages, str(tmp_path / "w"))
    sizes = [f.stat().st_size for f in (tmp_path / "w").rglob("*.txt")]
    assert 6_000_000 < max(sizes) < 6_001_000 and sorted(sizes)[-2] <= 1 << 20 and len(sizes) < 40
    got = warc.read_warc(spark, str(tmp_path / "w"))
    wanted = {f"<urn:page:{i}>": len(t.encode()) for i, _, t in small + large}
    assert {r["record_id"]: r["n"] for r in got.select("record_id", F.octet_length("payload").alias("n")).collect()} == wanted
