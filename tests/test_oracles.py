"""Every query of the library beside its DuckDB equivalent, on the smallest tables."""

import math
import os

import pytest

from tidepanel.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def normal(v):
    return (None if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr([normal(r[c]) for c in columns]) for r in frame.collect())
    wanted = duck.sql(ORACLES[name])
    assert sorted(wanted.columns) == columns
    place = [wanted.columns.index(c) for c in columns]
    assert got == sorted(repr([normal(r[i]) for i in place]) for r in wanted.fetchall())
    spark.catalog.clearCache()
