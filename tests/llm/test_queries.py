"""The registered queries: those with SQL beside DuckDB, and the pipeline beside a plain version."""

import math
import os
import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_mix, brute_spans
from tidepanel.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def normal(v):
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    frame = queries.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    wanted = duck().sql(queries.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    place = [wanted.columns.index(c) for c in columns]
    assert sorted(repr([normal(r[c]) for c in columns]) for r in frame.collect()) == sorted(repr([normal(r[i]) for i in place]) for r in wanted.fetchall())


def test_pipeline(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = queries.quality_rules.keep_good(docs).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in good]
    groups = brute_components(rows, 5)
    kept = [r for r in rows if groups[r[0]][1] == r[0]]
    stage = corpus_pipeline.personal_data_stage(spark, spark.createDataFrame([r for r in good if r["doc_id"] in {k[0] for k in kept}], docs.schema), SF)
    masked = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert all(not brute_spans(t) for t in masked.values()) and sum("<" in t for t in masked.values()) > 0
    final = [(i, masked[i], lang, source) for i, _, lang, source in kept]
    size, target = brute_mix(final)
    reference = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    got = corpus_pipeline.run(spark, SF).collect()
    words = {}
    source = {i: s for i, _, _, s in final}
    for r in got:
        ids = reference.encode(masked[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        s = source[r["doc_id"]]
        words[s] = words.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", masked[r["doc_id"]]))
    longest = {s: max(len(t.split()) for _, t, _, x in final if x == s) for s in size}
    assert all(target[s] - 1 <= words.get(s, 0) + (target[s] < 1) and words.get(s, 0) < target[s] + longest[s] for s in size)
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
