"""The registered queries, each called as it stands, beside brute force; names that clash; the far side of every switch on size."""

import collections
import hashlib
import os
import re
import zlib
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_mix, brute_spans, expected_url, near_rows, text
from tidepanel.llm import ann, bpe, common, components, langid, minhash, mixing, pii, quality_classifier, quality_rules, queries, tagger, url_filters, warc

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
CLASHES = ["_gone", "_key", "_key_", "_twice", "_mix_mine", "_mix_key", "_mix_epochs", "_mix_cut", "_mix_copy", "_mix_own", "a.b", "row", "cleaned", "body", "kept", "c0", "n", "doc_id_", "_id", "_t", "_lines", "_cleaned", "x y"]


def table(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def rows_of(spark, name):
    return queries.queries()[name](spark, SF).collect()


@needs_tables
def test_op1(spark):
    urls = {r["page_id"]: r["url"] for r in table(spark, "pages")}
    got = rows_of(spark, "op1_url_filters")
    assert len(got) == len(urls)
    for r in got:
        host, path, best = expected_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0]) and (best is None or r["verdict"] == best[1]) and r["verdict"] in ("allow", "block")


@needs_tables
def test_op2(spark):
    docs = table(spark, "documents")
    size, target = brute_mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs])
    source, taken = {r["doc_id"]: r["source"] for r in docs}, collections.Counter()
    for r in rows_of(spark, "op2_mix_sources"):
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)


@needs_tables
def test_op3(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents")}
    got = rows_of(spark, "op3_personal_data")
    assert len(got) == len(texts)
    weights = tagger.train()
    for r in got:
        base = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert all(r[f"n_{k}"] == sum(s[0] == k for s in base) for k in pii.BASE_KINDS)
        spans = [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s]
        assert set(base) <= set(spans) and len(spans) == r["n_spans"] == len(base) + sum(r[f"added_{k}"] for k in pii.KINDS)
        assert all(s in base or all(s[2] <= a or s[1] >= b for _, a, b in base) for s in spans)
        assert spans == brute_tagged(texts[r["doc_id"]], base, weights)


def brute_tagged(t, base, weights):
    """All spans by reading every window, one at a time, and one plain pass of decoding over the whole text's joined scores."""
    points = np.array([ord(c) for c in t], np.uint32)
    if not len(points):
        return base
    sums, trust = np.zeros((len(points), tagger.TAGS), np.float32), np.zeros(len(points), np.float32)
    for a in range(0, max(1, len(points) - pii.WINDOW + pii.STEP), pii.STEP):
        x = np.zeros((pii.WINDOW, 1), np.int64)
        piece = points[a : a + pii.WINDOW]
        x[: len(piece), 0] = tagger.classes(piece)
        sums[a : a + len(piece)] += tagger.emissions(weights, x)[: len(piece), 0] * pii._TRUST[: len(piece), None]
        trust[a : a + len(piece)] += pii._TRUST[: len(piece)]
    more = pii._tagged(t, 0, np.array(viterbi(weights["trans"], sums / trust[:, None])))
    free = [s for s in more if all(s[2] <= a or s[1] >= b for _, a, b in base)]
    return sorted(base + free, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def viterbi(trans, scores):
    best, back = scores[0], []
    for row in scores[1:]:
        paths = best[:, None] + trans
        back.append(paths.argmax(0))
        best = row + paths.max(0)
    tags = [int(best.argmax())]
    for b in back[::-1]:
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def test_decoding_in_pieces_is_one_pass():
    weights, rng = tagger.train(), np.random.default_rng(0)
    lengths = np.array([1, 255, 256, 257, 900, 3])
    scores = (rng.standard_normal((lengths.sum(), tagger.TAGS)) * 3).astype(np.float32)
    got, at = tagger.decode(weights, scores, lengths), 0
    for n in lengths.tolist():
        assert got[at : at + n].tolist() == viterbi(weights["trans"], scores[at : at + n])
        at += n


HAND = [
    ("Call 030 1234567 or (555) 123-4567 ext. 12 today.", {"030 1234567", "(555) 123-4567 ext. 12"}),
    ("write to mary.smith [at] example.org please", {"mary.smith [at] example.org"}),
    ('set token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" here', {"9b0b3c6a43eb78aa99cbd7049c572391524f37a8"}),
    ("see commit 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 of 2020-01-02, version 3.11.2", set()),
    ("at noon we met at home, 12 of us (at least)", set()),
    ("card 4111.1111.1111.1111 and no more", {"4111.1111.1111.1111"}),
]


def test_added_spans_by_hand_and_on_held_out_text():
    weights = tagger.train()
    right = wrong = missed = 0
    for (t, wanted), (base, spans) in zip(HAND, pii.all_spans([t for t, _ in HAND], weights)):
        found = {t[a:b] for _, a, b in spans}
        right, wrong, missed = right + len(found & wanted), wrong + len(found - wanted), missed + len(wanted - found)
    assert right >= 4 and wrong <= 1 and missed <= 1
    rng, right, wrong, missed = Random(5), 0, 0, 0
    windows = [(t.rstrip("\0"), tags[: len(t.rstrip("\0"))]) for t, tags in (tagger.sample_window(rng) for _ in range(600))]
    for (t, tags), (_, spans) in zip(windows, pii.all_spans([w[0] for w in windows], weights)):
        cuts = [0, *[i for i in range(1, len(tags)) if tags[i] != tags[i - 1]], len(tags)]
        runs = [(tagger.KINDS[tags[a] - 1], a, b) for a, b in zip(cuts, cuts[1:]) if tags[a] and a > 0 and b < len(tags)]
        near = lambda s, r: s[0] == r[0] and abs(s[1] - r[1]) <= 1 and abs(s[2] - r[2]) <= 1
        hits = sum(any(near(s, r) for s in spans) for r in runs)
        right, missed = right + hits, missed + len(runs) - hits
        wrong += sum(all(s[2] <= a or s[1] >= b for a, b in zip(cuts, cuts[1:]) if tags[a]) for s in spans)
    assert right / (right + missed) > 0.88 and right / (right + wrong) > 0.97


@needs_tables
def test_op4(spark):
    held = {r["vec_id"]: r["embedding"] for r in table(spark, "embeddings")}
    good = {i: np.array(v, float) for i, v in held.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    matrix = np.stack([good[i] for i in ids.tolist()])
    got = collections.defaultdict(list)
    for r in rows_of(spark, "op4_nearest_neighbours"):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in good if i % 20 == 0}
    recall = []
    for q, found in got.items():
        s = (matrix * good[q]).sum(1)
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        found.sort()
        assert [f[0] for f in found] == list(range(1, min(20, len(ids) - 1) + 1))
        assert all(f[2] == pytest.approx(float((good[f[1]] * good[q]).sum()), rel=1e-12) for f in found)
        recall.append(len({f[1] for f in found} & set(best.tolist())) / len(best))
    assert np.mean(recall) >= 0.9


def test_search_of_clusters_reads_and_verifies_little():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((200, 64))[rng.integers(0, 200, 8000)] + 0.15 * rng.standard_normal((8000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    block = ann.Block(np.arange(8000), v, 1.0, 20)
    asked = np.arange(0, 8000, 200)
    found = block.search(asked, v[asked], 20)
    recall = [len(set(ids.tolist()) & set(np.argsort(-(v @ v[q]))[1:21].tolist())) / 20 for q, (ids, _) in zip(asked.tolist(), found)]
    assert np.mean(recall) >= 0.9 and block.verified < 0.05 * 8000 * len(asked) and block.touched < 0.3 * 64 * 8000 * len(asked)


@needs_tables
def test_op5(spark):
    pages = table(spark, "pages")
    best = {}
    for r in pages:
        best[r["html"] or ""] = max(best.get(r["html"] or "", r["page_id"]), r["page_id"])
    got = {r["page_id"]: r for r in rows_of(spark, "op5_warc")}
    assert len(got) == len(pages)
    for p in pages:
        body = (p["html"] or "").encode()
        again = len(body) >= 1000 and best[p["html"]] != p["page_id"]
        r = got[p["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", best[p["html"]] if again else None)


@needs_tables
def test_op6(spark):
    docs = table(spark, "documents")
    wanted = brute_components([(r["doc_id"], r["text"]) for r in docs], 2)
    got = rows_of(spark, "op6_minhash_dedup")
    assert len(got) == len(docs)
    assert all((r["n_shingles"], r["component_id"], r["kept"]) == (*wanted[r["doc_id"]], r["doc_id"] == wanted[r["doc_id"]][1]) for r in got)


def brute_language(docs, held):
    """The same choice of texts, and counts of 4-grams in dictionaries instead of filters."""
    fold = langid._FOLD.tolist()

    def grams(t):
        whole = b"  " + bytes(fold[c] for c in t.encode()) + b"   "
        return [whole[i : i + 4] for i in range(len(whole) - 3)]

    by = collections.defaultdict(list)
    for r in docs:
        if not held[r["doc_id"]] and r["text"] is not None and r["lang"] is not None:
            by[r["lang"]].append((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["text"]))
    rate = {lang: collections.Counter(g for _, t in sorted(rows)[: langid.SAMPLE] for g in grams(t)) for lang, rows in by.items()}
    total = {lang: sum(c.values()) for lang, c in rate.items()}
    member = collections.defaultdict(set)
    for g in set().union(*rate.values()):
        top = max(rate[lang][g] / total[lang] for lang in rate)
        member[g] = {lang for lang in rate if rate[lang][g] >= langid.SEEN and rate[lang][g] / total[lang] >= langid.SHARE * top}
    return {r["doc_id"]: collections.Counter(lang for g in grams(r["text"] or "") for lang in member.get(g, ())) for r in docs}


@needs_tables
def test_op7(spark):
    docs = table(spark, "documents")
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs}
    brute = brute_language(docs, held)
    got = {r["doc_id"]: r for r in rows_of(spark, "op7_language_id")}
    assert len(got) == len(docs)
    same = judged = hits = 0
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == held[d["doc_id"]] and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, d["text"] or "")))
        top = brute[d["doc_id"]].most_common(2)
        if len(top) == 1 or len(top) == 2 and top[0][1] > 1.05 * top[1][1]:  # where false positives can't turn the choice
            judged += 1
            same += r["lang_pred"] == top[0][0]
        hits += r["held_out"] and r["lang_pred"] == d["lang"]
    assert judged > 50 and same == judged and hits >= 0.95 * sum(held.values())


@needs_tables
def test_op8(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents")}
    for r in rows_of(spark, "op8_bpe"):
        ids = reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@needs_tables
def test_op10(spark):
    docs, labels = table(spark, "documents"), {r["doc_id"]: r["quality"] for r in table(spark, "labels")}
    got = {r["doc_id"]: r for r in rows_of(spark, "op10_quality_classifier")}
    assert len(got) == len(docs)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_classifier.train(frame.where(~langid.held_out(F.col("doc_id"), 3, 1)), spark.read.parquet(f"{SF}/labels.parquet"))
    both = model.compressors()
    for d in docs:
        r = got[d["doc_id"]]
        body = (d["text"] or "").encode()
        sizes = [sum(len(c.compress(body[i : i + 1024])) for i in range(0, len(body), 1024)) for c in both]
        wanted = 1 / (1 + np.exp(-(model.slope * (sizes[1] - sizes[0]) / max(1, len(body)) + model.bias)))
        assert r["score"] == pytest.approx(wanted, abs=1e-9) and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
    known = [d["doc_id"] for d in docs if got[d["doc_id"]]["held_out"] and labels.get(d["doc_id"]) in (0, 1)]
    assert np.mean([got[i]["predicted"] == labels[i] for i in known]) > 0.9


def clashing(spark, rows):
    frame = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit("kept as it is"))
    return frame


def test_clashing_names_pass_all_stages(spark):
    rng = Random(9)
    good = "\n".join(text(rng, 20).capitalize() + "." for _ in range(5))
    rows = [(1, good, "en", "a"), (1, good, "en", "a"), (2, good + " w1", "en", "b"), (3, good.upper().replace("W1", "q") + " mail a1@b.org.", None, None), (4, None, None, None), (None, good + "\nHome | About | Terms\n" + text(rng, 60) + ".", "en", "a")]
    stages = corpus_pipeline.STAGES[:-1]
    frame = clashing(spark, rows)
    for name, stage in stages:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        held = out.collect()
        assert all(r[c] == "kept as it is" for r in held for c in CLASHES), name
        assert stage(spark, frame.limit(0), SF).count() == 0, name
        frame = out
    assert corpus_pipeline.token_stage(spark, frame, SF).columns == ["doc_id", "n_tokens", "ids"]


def test_stages_alone_on_odd_rows(spark):
    """Each stage by itself: nulls, empty and very long texts, ties, repeated rows."""
    long_text = "\n".join(f"Line {k} of a very long text that goes on, and on." for k in range(12_000))
    rows = [(1, None, None, None), (2, "", "en", ""), (3, long_text, "en", "a"), (3, long_text, "en", "a"), (4, long_text + " More.", "de", "a"), (None, None, None, None), (None, "x", "en", "b")]
    frame = clashing(spark, rows)
    kept = corpus_pipeline.quality_stage(spark, frame, SF).collect()
    assert [r["doc_id"] for r in kept] == [] or {r["doc_id"] for r in kept} <= {3, 4}
    left = corpus_pipeline.dedup_stage(spark, frame, SF).collect()
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 0, 1, 2, 3]
    masked = corpus_pipeline.personal_data_stage(spark, frame, SF).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in masked))) == sorted(map(repr, ((i, t) for i, t, *_ in rows)))
    mixed = corpus_pipeline.mixing_stage(spark, frame, SF)
    assert mixed.columns == frame.columns and mixed.where("text is null or text = ''").count() <= 9
    tokens = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.token_stage(spark, frame, SF).collect()}
    assert tokens[1] == tokens[2] == 0 and tokens[4] > tokens[3] > 12_000


def test_far_side_of_the_switches(spark, monkeypatch, tmp_path):
    """Every broadcast that depends on size, as a shuffled join: with the same results."""
    rows = near_rows()
    frame = spark.createDataFrame([(i, t, lang, source, 0) for i, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([(k, f"http://a{k % 3}.org/b?c", ("p%d " % (k % 5)) * 500) for k in range(40)], "page_id long, url string, html string")
    rules = queries.url_rules() + [url_filters.pattern_rule("||a1.", "block")]
    warc.write_warc(pages, str(tmp_path / "near"))

    def results(name):
        model = langid.train(frame.where("lang is not null"))
        warc.write_warc(pages, str(tmp_path / name))
        return [
            sorted(map(repr, x.collect()))
            for x in (
                mixing.mix_rows(frame).select("doc_id"), langid.identify(frame, model), warc.read_warc(spark, str(tmp_path / name)).drop("payload"), url_filters.judge_urls(pages, rules),
                components.components(minhash_links(spark)),
            )
        ]

    near = results("a")
    for module, name in ((minhash, "BROADCAST_IDS"), (mixing, "BROADCAST_SOURCES"), (langid, "BROADCAST_SAMPLE"), (warc, "BROADCAST_ROWS"), (url_filters, "BROADCAST_RULES"), (url_filters, "INLINE_RULES")):
        monkeypatch.setattr(module, name, 0)
    for module in (common, minhash, components):
        monkeypatch.setattr(module, "HOT", 3)
    assert results("b") == near


def minhash_links(spark):
    """A star of 60, a path and a pair."""
    return spark.createDataFrame([(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(20)] + [(500, 501)], "a long, b long")


def test_rules_are_read_from_a_list():
    lines = ["! a comment", "", "||ads.example^", "@@||ads.example/fine^", "site: org/fr/", "@@site: example.net/en/", "/banner/*", "# too"]
    rules = url_filters.read_rules(lines)
    assert [(r.text, r.verdict, r.site) for r in rules] == [("||ads.example^", "block", False), ("||ads.example/fine^", "allow", False), ("org/fr/", "block", True), ("example.net/en/", "allow", True), ("/banner/*", "block", False)]


def test_exceptions_win(spark):
    rules = url_filters.read_rules(["||ads.example^", "@@||ads.example/fine^", "site: net/", "@@site: x.net/"])
    pages = spark.createDataFrame([(1, "http://a.ads.example/x"), (2, "http://ads.example/fine/x"), (3, "http://x.net/"), (4, "http://y.net/"), (5, "http://q.org/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(pages, rules).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow"}


def test_very_long_texts_and_urls(spark):
    frame = spark.createDataFrame([(1, "word " * 300_000), (2, "http://h.net/" + "a" * 200_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.score_rules(frame).collect()} == {1: 300_000, 2: 1}
    assert {r["page_id"]: r["rule"] for r in url_filters.judge_urls(frame.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), queries.url_rules()).collect()} == {1: None, 2: "net/"}
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert {r["doc_id"]: len(r["ids"]) for r in bpe.encode(frame, path).collect()}[1] == 300_000
    assert re.fullmatch(r"word( word)*", bpe.decode(bpe.encode(frame.where("doc_id = 1"), path), path).first()["decoded"].replace("</w>", "").replace("  ", " ").strip())
