"""The vendor as a data source, over files in place of a network: pushed ranges, retries, unknown names, resuming."""

import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import research
from tidepanel.sources import files, vendor

DAY = datetime.date(2020, 1, 31)


@pytest.fixture
def folder(tmp_path):
    for name, n in (("AA", 30), ("BB", 20), ("CC", 3)):
        rows = [{"date": str(DAY + datetime.timedelta(days=31 * k)), "adjClose": 10.0 + k, "adjVolume": 5.0} for k in range(n)]
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "EMPTY.json").write_text(json.dumps({"date": str(DAY)}))
    return str(tmp_path)


def fetcher(folder, busy=0):
    def fetch(ticker, since, until):
        with open(f"{folder}/asked", "a") as log:  # one machine: a log of what was asked
            log.write(f"{ticker} {since} {until}\n")
        path = f"{folder}/{ticker}.json"
        if not os.path.exists(path):
            raise vendor.Unknown
        tries = f"{path}.tries"
        with open(tries, "a") as count:
            count.write("x")
        if os.path.getsize(tries) <= busy:
            raise vendor.Busy(0.01)
        for line in open(path):
            r = json.loads(line)
            date = datetime.date.fromisoformat(r["date"])
            if (since is None or date >= since) and (until is None or date <= until):
                yield date, r.get("adjClose"), r.get("adjVolume")

    return fetch


def tickers(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "ticker string")


def asked(folder):
    return [line.split() for line in open(f"{folder}/asked")]


def test_ranges_and_names_are_pushed(spark, folder):
    series = vendor.read_series(spark, fetcher(folder), tickers(spark, "AA", "BB", "CC", "EMPTY", "GONE"), buckets=3)
    assert series.rdd.getNumPartitions() <= 3 and {r["ticker"]: r["count"] for r in series.groupBy("ticker").count().collect()} == {"AA": 30, "BB": 20, "CC": 3}
    os.remove(f"{folder}/asked")
    some = series.where((F.col("date") >= F.lit(datetime.date(2021, 1, 1))) & (F.col("date") < F.lit(datetime.date(2021, 6, 1))) & F.col("ticker").isin("AA", "CC"))
    got = some.collect()
    assert {r["ticker"] for r in got} == {"AA"} and all(datetime.date(2021, 1, 1) <= r["date"] < datetime.date(2021, 6, 1) for r in got)
    assert sorted(map(tuple, asked(folder))) == [("AA", "2021-01-01", "2021-05-31"), ("CC", "2021-01-01", "2021-05-31")]


def test_a_busy_vendor_is_asked_again(spark, folder):
    names = tickers(spark, "AA", "CC")
    assert vendor.read_series(spark, fetcher(folder, busy=3), names, attempts=4).count() == 33
    with pytest.raises(Exception, match="busy"):
        vendor.read_series(spark, fetcher(folder, busy=99), tickers(spark, "BB"), attempts=2).count()
    began = time.perf_counter()
    with pytest.raises(vendor.Busy):
        vendor._Reader(lambda *_: (_ for _ in ()).throw(vendor.Busy()), ["X"], 1, 3, 0.05)._asked("X")
    assert time.perf_counter() - began >= 0.05 + 0.1


def test_resuming_from_a_checkpoint(spark, folder, tmp_path):
    path = str(tmp_path / "kept")
    files.write_checkpoint(vendor.read_series(spark, fetcher(folder), tickers(spark, "AA")), path)
    os.remove(f"{folder}/asked")
    rest = vendor.read_series(spark, fetcher(folder), tickers(spark, "AA", "BB", "CC"), files.read_checkpoint(spark, path))
    files.write_checkpoint(rest, path, append=True)
    assert {a[0] for a in asked(folder)} == {"BB", "CC"}
    panel = research.broad_universe(files.read_checkpoint(spark, path))
    assert {r[0] for r in panel.select("ticker").distinct().collect()} == {"AA", "BB"}
