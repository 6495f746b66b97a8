"""Edge cases and brute-force comparisons of the training-data operators, on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import ann, bpe, common, components, langid, minhash, mixing, pii, quality_classifier, quality_rules, tagger, url_filters, warc
from tidepanel.llm.queries import url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(400)]


def docs(spark, rows):
    """Documents with further columns whose names clash with the operators' own."""
    full = [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]
    frame = spark.createDataFrame(full, DOCS)
    for name in ("size", "_t", "band", "score", "kept", "_size", "value", "rule", "host", "spans", "ids"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", None), (4, "one", "en", None), (5, "x" * 50_000, "de", "b"), (None, "no id here", "en", "b"), (6, "é 漢字 ß\u00a0Σ", "fr", "")]


# URL filters


def judged(spark, urls, rules=None, **options):
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("rule", F.lit(1))
    out = url_filters.judge_urls(rows, rules or url_rules(), **options)
    return {r["page_id"]: r for r in out.collect()}


URLS = [None, "", "nothing", "http://A.Example.NET/en/x", "http://example.net/EN/x", "https://x.example.com/de/1", "https://example.com/fr/1", "http://a.org/fr/", "http://a.org", "http://org/fr/q?x", "net://net/", "http://notnet/", "://net/?q", "http://free-bets.example.com/", "http://xfree-bets.example.com/", "http://h/a.exe", "http://h/a.exec", "http://h/?utm_source=feed", "http://h/x?utm_source=feed&a", "http://example.net#/en/", "http://a://net/b"]


def expected_url(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for rule, verdict in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


@pytest.mark.parametrize("inline", [True, False])
def test_urls(spark, monkeypatch, inline):
    if not inline:
        monkeypatch.setattr(url_filters, "INLINE_RULES", 0)
    got = judged(spark, URLS + URLS[:3])
    assert len(got) == len(URLS) + 3
    for k, url in enumerate(URLS):
        host, path, best = expected_url(url)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, best and best[0]), url
        if best:
            assert got[k]["verdict"] == best[1]
    patterns = {URLS[k]: (r["pattern"], r["verdict"]) for k, r in got.items() if k < len(URLS) and r["rule"] is None}
    assert patterns["http://free-bets.example.com/"] == ("||free-bets.", "block") and patterns["http://xfree-bets.example.com/"] == (None, "allow")
    assert patterns["http://h/a.exe"] == ("*.exe^", "block") and patterns["http://h/a.exec"] == (None, "allow")
    assert patterns["http://h/?utm_source=feed"] == ("*?utm_source=feed^", "allow")


def test_urls_index_uses_the_rarest_token(spark):
    rows = spark.createDataFrame([(k, f"http://common.org/{'rare' if k == 3 else 'page'}") for k in range(9)], "page_id long, url string")
    rule = url_filters.pattern_rule("||common.org/rare^", "block")
    assert url_filters.rarest_tokens(rows, "url", [rule]) == {rule: "rare"}
    assert url_filters.site_rule("example.net/en", "block").tokens == ("example", "net")
    assert url_filters.judge_urls(rows.limit(0), [rule]).count() == 0
    assert {r["verdict"] for r in url_filters.judge_urls(rows, []).collect()} == {"allow"}


# mixing


def brute_mix(rows):
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, fixed = sum(size.values()), {}, set()
    while True:
        left = total - sum(3 * size[s] for s in fixed)
        open_ = sum(weight[s] for s in order if s not in fixed)
        target = {s: 3.0 * size[s] if s in fixed else left * weight[s] / open_ for s in order}
        over = {s for s in order if s not in fixed and target[s] > 3 * size[s]}
        if not over:
            return size, target
        fixed |= over


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(1000 + i, text(rng, rng.randint(0, 60)), "en", rng.choice(["a", "b", "b", "b", "b", "c", None, "é"])) for i in range(300)] + ODD + [(900, "a b c", None, "empty?"), (901, " ", None, "void")]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    size, target = brute_mix(rows)
    assert len(got) == len(rows)
    source = {i: s for i, _, _, s in rows}
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(taken[s] == int(target[s] + 1e-6) for s in size)
    again = mixing.mix_sources(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix_sources(docs(spark, rows).limit(0)).count() == 0


def test_mixed_rows(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randint(1, 60)), "en", rng.choice(["a", "b", "b", "b", "c"])) for i in range(200)]
    frame = docs(spark, rows)
    mixed = mixing.mix_rows(frame)
    assert mixed.columns == frame.columns
    taken = {r["doc_id"]: r for r in mixing.mix_sources(frame).collect()}
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for i, r in taken.items():
        assert copies.get(i, 0) == -(-r["taken"] // r["size"])


# personal data


def brute_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and tagger.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(3)
    parts = ["@", "a", "b.", ".", "1", "23", "+1", "255", "-", " ", "(", ")", "4111111111111111", "x@y.z", "_", "é"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)


def test_tagger_accuracy_and_windows():
    weights = tagger.train()
    x, y = tagger.training_batch(random.Random(99), 200)
    scores = tagger.emissions(weights, x)
    tags = tagger.decode(weights, scores.transpose(1, 0, 2).reshape(-1, tagger.TAGS), np.full(200, tagger.LENGTH))
    assert (tags.reshape(200, -1).T == y).mean() > 0.96
    t = text(random.Random(1), 300) + " call (555) 123-4567 now, card 4111 1111 1111 1111 2 ok " + text(random.Random(2), 300)
    (base, spans), = pii.all_spans([t], weights)
    assert not base and [t[b:e] for _, b, e in spans] == ["(555) 123-4567", "4111 1111 1111 1111"]
    assert pii.all_spans([t], weights, everywhere=True) == [(base, spans)]
    assert pii.masked(t, spans).count("<") == 2
    assert pii.all_spans(["Version 3.1.2 of 2020-01-02, see 10.1 and #12345"], weights) == [([], [])]


def test_personal_data(spark):
    rows = ODD + [(7, "漢 mail bob.1@ex-ample.co.uk and 10.0.0.255 or 10.0.0.256", "en", "a")]
    frame = docs(spark, rows)
    got = pii.find_personal_data(frame).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["base"] for r in got}[7] == "email:7:27,ip:32:42"
    masked = pii.mask_personal_data(frame)
    assert masked.columns == frame.columns
    out = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert out[7].startswith("漢 mail <EMAIL> and <IP> or") and out[1] is None and out[2] == "" and out[6] == ODD[-1][1]
    assert pii.find_personal_data(frame.limit(0)).count() == 0


# nearest neighbours


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 700)
    monkeypatch.setattr(ann, "GROUP", 40)
    rng = np.random.default_rng(2)
    v = rng.standard_normal((2000, 16)) * rng.uniform(0.2, 2, (2000, 1))
    v[100:400] = v[100]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, [1.0, 2.0]), (None, [1.0] * 16), (5100, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("block", F.lit("b"))
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 2000, 20))
    recall = []
    for q, found in got.items():
        found.sort()
        s = (v * v[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(2000), -s))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == pytest.approx(s[f[1]], rel=1e-12) for f in found)
        recall.append(len({f[1] for f in found} & set(best.tolist())) / 20)
        if q in range(100, 400, 20) and s[101] > np.delete(s, np.r_[100:400]).max():
            assert [f[1] for f in found] == [i for i in range(100, 121) if i != q][:20]
    assert np.mean(recall) >= 0.9


def test_nearest_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, -1.0)]
    assert ann.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


# WARC


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PART", 3000)
    monkeypatch.setattr(warc, "FILE", 20_000)
    fake = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n"
    big = "é" * 800
    rows = [(1, "http://a b\r\n/x", None), (2, None, ""), (3, "u", fake), (4, "u", big), (5, "u", big), (9, "u", big), (6, "u", "z" * 999), (7, "u", "z" * 999), (8, "u", fake * 40), (8, "u", fake * 40), (10, "u", "q" * 9000)]
    rows += [(100 + k, "u", f"{k} " * 300) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("keeper", F.lit(1))
    path = str(tmp_path / "w")
    warc.write_warc(pages.repartition(2), path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", i), i)
    for r in got:
        i = int(re.fullmatch(r"<urn:page:(\d+)>", r["record_id"])[1])
        html = next(h for j, _, h in rows if j == i) or ""
        again = len(html.encode()) >= 1000 and best[html] != i
        assert (r["record_type"] == "revisit") == again and r["payload_length"] == len(html.encode()) and r["digest"] == "sha1:" + hashlib.sha1(html.encode()).hexdigest()
        assert bytes(r["payload"]) == (b"" if again else html.encode()) and (not again or r["refers_to"] == f"<urn:page:{best[html]}>")
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_warc_ignores_what_no_chain_reaches(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    whole = record % 1 + record % 2 + b"junk" + record % 3
    (tmp_path / "a.txt").write_bytes(whole)
    (tmp_path / "b.txt").write_bytes((record % 4 + record % 5)[:-6])
    got = sorted(r["record_id"] for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got == ["<urn:page:1>", "<urn:page:2>", "<urn:page:4>"]


def test_warc_headers_of_any_length(spark, tmp_path):
    urls = {1: "u", 2: "a" * 70_000, 3: "u", 4: "b " * 30_000, 5: "c" * 5_000_000, 6: "u", 7: "d" * (65_536 - 300), 8: "é" * 40_000, 9: "u"}
    fake = "WARC/1.0\r\nContent-Length: 3\r\n" + "z" * 70_000 + "\r\nWARC/1.0\r\nContent-Length: 7\r\n" + "y" * 70_000 + "\r\n\r\n"
    pages = spark.createDataFrame([(i, u, fake if i == 6 else f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    got = {r["record_id"]: (r["target"], bytes(r["payload"]).decode()) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {f"<urn:page:{i}>": (u.replace(" ", "%20"), fake if i == 6 else f"page {i}") for i, u in urls.items()}
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.txt").write_bytes(b"WARC/1.0\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 4\r\nX: " + b"x" * 70_000)
    assert [r["record_id"] for r in warc.read_warc(spark, str(tmp_path / "cut")).collect()] == ["<urn:page:1>"]


# near-duplicates


def brute_components(rows, k, threshold=80):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_rows():
    rng = random.Random(8)
    rows, n = [], 10
    for _ in range(12):
        base = text(rng, rng.randint(6, 150)).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((n, " ".join(copy).replace("w1", "W1"), "en", "a"))
            n += 1
    base = text(rng, 100).split()  # a chain: each links with the next only
    for k in range(25):
        base = base[4:] + [f"v{k}{j}" for j in range(4)]
        rows.append((n, " ".join(base), "en", "a"))
        n += 1
    rng.shuffle(rows)
    return rows + [r for r in ODD if r[0] is not None] + [(400 + k, "one", "en", "a") for k in range(20)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k, monkeypatch):
    if k == 5:  # the far side of the switches on size
        monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
        for module in (common, components, minhash):
            monkeypatch.setattr(module, "HOT", 3)
    rows = near_rows()
    wanted = brute_components(rows, k)
    got = minhash.near_duplicates(docs(spark, rows), k=k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == wanted[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(docs(spark, rows).limit(0), k=k).count() == 0


def test_blocks_of_a_group(spark, monkeypatch):
    """All links of one large group, through tasks of two small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 9)
    rows = [r for r in near_rows() if 10 <= r[0] < 400]
    texts = docs(spark, rows).select("doc_id", "text")
    whole = texts.select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("component"))
    links = minhash.group_links(whole, texts, 2, 80)
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert {i: found.get(i, i) for i, *_ in rows} == {i: c for i, (_, c) in brute_components(rows, 2).items()}
    assert links.count() < 3 * len(rows)


def test_deduplicate(spark):
    rows = near_rows()
    frame = docs(spark, rows + [(None, "no id", "en", "a")])
    out = minhash.deduplicate(frame, k=2)
    assert out.columns == frame.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in brute_components(rows, 2).values()}) and ids.count(None) == 1


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (400, 100, 100))
    s = minhash.sketch([np.concatenate([common, a]), np.concatenate([common, b]), common[:1]], 1024)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.06


# language, quality, tokens


def test_language(spark):
    rng = random.Random(1)
    alphabets = {"aa": "abcde ", "bb": "fghij ", "cc": "klmno "}
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(200)), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    frame = docs(spark, rows + ODD)
    held = langid.held_out(F.col("doc_id"), 5, 0)
    model = langid.train(frame.where(~held & F.col("lang").isin("aa", "bb", "cc")))
    got = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    assert len(got) == len({r[0] for r in rows + ODD})
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows if i > 6) and all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r for r in langid.identify(docs(spark, ODD[:4]), model).collect()}
    assert odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[3]["lang_pred"] == "und" and odd[4]["lang_pred"] in model.languages
    assert [r[0] for r in frame.where("doc_id = 7").select(held).collect()] == [zlib.crc32(b"7") % 5 == 0]
    nothing = langid.train(frame.limit(0))
    assert {r["lang_pred"] for r in langid.identify(frame, nothing).collect()} == {"und"}
    assert langid.identify(frame.limit(0), model).count() == 0


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "BITS", 2)
    rows = [(i, f"{c}{c}{d} " * 30, c, "s") for i, (c, d) in enumerate((c, d) for c in "abcdef" for d in "xyzxyz")]
    model = langid.train(docs(spark, rows))
    assert model.masks.shape[0] == 3
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs(spark, rows), model).collect()}
    assert all(got[i] == c for i, _, c, _ in rows)


def test_quality_classifier(spark):
    rng = random.Random(2)
    good = [(20 + i, text(rng, 120), "en", "s") for i in range(120)]
    bad = [(200 + i, "".join(rng.choice("#$%&*!") for _ in range(600)), "en", "s") for i in range(60)]
    frame = docs(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + [(3, None), (None, 1), (2, 7)], "doc_id long, quality int").withColumn("score", F.lit(1))
    held = langid.held_out(F.col("doc_id"), 3, 1)
    model = quality_classifier.train(frame.where(~held), labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(frame, model).collect()}
    assert np.mean([(got[i] >= 0.5) for i, *_ in good] + [(got[i] < 0.5) for i, *_ in bad]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]
    one = quality_classifier.train(frame, labels.where("quality = 1"))
    assert {round(r["score"], 3) for r in quality_classifier.score(frame, one).collect()} == {1.0}
    none = quality_classifier.train(frame, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(frame, none).collect()} == {0.5}
    assert quality_classifier.score(frame.limit(0), model).count() == 0


def test_tokens(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    pool = "abc 'stdΣσςİıéÅǅ½²①\x1c\x1d\u200b\u180e\xa0\x85\u2028e\u0301中文字日本アカ😀👍🏽!?..--__ \n\t٣१ⅷª"
    rows = [(10 + i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 40))), "x", "s") for i in range(400)]
    rows += [(1000 + i, "".join(rng.choice("aab<|endoftext|> startoftext") for _ in range(40)) + "<|endoftext|><|startoftext|>x", "x", "s") for i in range(40)]
    rows += [(2000 + i, "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 60))) + "a" * i, "x", "s") for i in range(200)] + ODD
    got = bpe.decode(bpe.encode(docs(spark, rows), path), path).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        ids = reference.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == reference.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs(spark, rows).limit(0), path).count() == 0


def test_speculation_is_verified():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    exact = [vocabulary.merge(w) for w in words]
    assert vocabulary.encode_words(words) == exact
    assert any(vocabulary.propose(w) != e for w, e in zip(words, exact))


# quality rules


def test_quality_rules(spark):
    rng = random.Random(6)
    clean = "\n".join(text(rng, 20).capitalize() + "." for _ in range(6))
    rows = ODD + [(20, clean, "en", "a"), (21, "a b c " * 40, "en", "a"), (22, clean + "\nHome | About | Contact", "en", "a"), (23, " | ".join(WORDS[:80]), "en", "a"), (24, "\n".join(["same line of words here."] * 30) + clean, "en", "a"), (25, " ".join(w + "!!" for w in WORDS[:90]), "en", "a")]
    frame = docs(spark, rows)
    got = {r["doc_id"]: r for r in quality_rules.score_rules(frame).collect()}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {j + d for j, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert {i for i, r in got.items() if r["kept"]} == {20, 22}
    assert not got[23]["base_failed"] and not got[25]["base_failed"]
    good = quality_rules.keep_good(frame)
    assert good.columns == frame.columns and sorted(r["doc_id"] for r in good.collect()) == [20, 22]
    assert quality_rules.score_rules(frame.limit(0)).count() == 0 and quality_rules.keep_good(frame.limit(0)).count() == 0
    assert frame.where("doc_id = 22").select(quality_rules.clean_text(F.col("text"))).first()[0] == clean


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (102, 102)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100}
