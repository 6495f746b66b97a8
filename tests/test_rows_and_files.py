"""As-of joins of keys with their own dates, panes, unit-root tests, conjugate gradients, versions of a checkpoint, tickers of any type."""

import datetime
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.unitroot import adf_p_value, adf_statistic
from tidepanel.operators import model, panel, research, walkforward
from tidepanel.sources import files

DAY = datetime.date(2020, 1, 1)


@pytest.mark.parametrize("spans", [1, 7, 64])
def test_asof_join(spark, spans):
    rng = random.Random(spans)
    day = lambda k: DAY + datetime.timedelta(days=k)
    asked = [(k, rng.choice(["a", "b", "hot", "hot", "none"]), day(rng.randrange(300))) for k in range(400)] + [(900, None, day(5)), (901, "a", None)]
    known = {(rng.choice(["a", "b", "hot", "hot", "other"]), day(rng.randrange(300))): (float(k), None if k % 9 == 0 else k) for k in range(300)}
    left = spark.createDataFrame(asked, "id int, ticker string, date date")
    right = spark.createDataFrame([(*k, *v) for k, v in known.items()], "ticker string, date date, price double, size int")
    got = panel.asof_join(left, right, ["price", "size"], spans=spans)
    assert got.columns == ["id", "ticker", "date", "price", "size"]
    for r in got.collect():
        before = [d for t, d in known if t == r["ticker"] and r["date"] is not None and d <= r["date"]]
        assert (r["price"], r["size"]) == (known[r["ticker"], max(before)] if before else (None, None))
    assert got.count() == len(asked)
    assert panel.asof_join(left.limit(0), right, ["price"]).count() == 0
    assert panel.asof_join(left, right.limit(0), ["price"]).where("price is not null").count() == 0


@pytest.mark.parametrize("train,test", [(24, 6), (10, 4), (9, 5), (6, 12)])
def test_panes_give_the_slices(spark, train, test):
    rng = random.Random(train)
    rows = [(t, k, None if rng.random() < 0.1 else rng.uniform(1, 9)) for t in range(61) for k in range(5)]
    px = spark.createDataFrame(rows, "t int, ticker int, close double")
    plan = walkforward.blocks(px, train, test)
    slices = walkforward.training_rows(px, plan, train).where("close is not null").groupBy("block", "ticker").agg(F.sum("close").alias("s"), F.count("close").alias("n"), F.max("t").alias("last"))
    panes = walkforward.by_panes(px.where("close is not null"), plan, train, test, {"_s": F.sum("close"), "_n": F.count("close"), "_l": F.max("t")}, {"s": F.sum("_s"), "n": F.sum("_n"), "last": F.max("_l")})
    key = lambda r: (r["block"], r["ticker"], round(r["s"], 9), r["n"], r["last"])
    assert sorted(map(key, slices.collect())) == sorted(map(key, panes.collect()))


def plain_adf(y, regression, lags, skip=None):
    """One regression by least squares: statistic, AIC, BIC and the last lag's t."""
    skip = lags if skip is None else skip
    change = np.diff(y)
    target, n = change[skip:], len(change) - skip
    columns = [y[skip:-1], *{"n": [], "c": [np.ones(n)], "ct": [np.ones(n), np.arange(n) + 1.0]}[regression], *[change[skip - j : len(change) - j] for j in range(1, lags + 1)]]
    x = np.stack(columns, 1)
    beta, *_ = np.linalg.lstsq(x, target, rcond=None)
    rss, k = ((target - x @ beta) ** 2).sum(), x.shape[1]
    t = beta / np.sqrt(rss / (n - k) * np.diag(np.linalg.inv(x.T @ x)))
    return t[0], n * np.log(rss / n) + 2 * k, n * np.log(rss / n) + np.log(n) * k, abs(t[-1])


@pytest.mark.parametrize("regression", ["n", "c", "ct"])
def test_nested_regressions(regression):
    rng = np.random.default_rng(3)
    for scale in (0.2, 0.7, 1.0):
        y = np.zeros(150)
        for k in range(2, 150):
            y[k] = scale * y[k - 1] + 0.2 * (y[k - 1] - y[k - 2]) + rng.standard_normal()
        for lags in (0, 1, 5):
            assert adf_statistic(y, regression=regression, lags=lags)[0] == pytest.approx(plain_adf(y, regression, lags)[0], rel=1e-8)
        most = min(int(np.ceil(12 * (150 / 100) ** 0.25)), 150 // 2 - 1 - {"n": 0, "c": 1, "ct": 2}[regression])
        tried = [plain_adf(y, regression, k, most) for k in range(most + 1)]
        assert adf_statistic(y, regression=regression, autolag="AIC")[1] == int(np.argmin([r[1] for r in tried]))
        assert adf_statistic(y, regression=regression, autolag="BIC")[1] == int(np.argmin([r[2] for r in tried]))
        significant = [k for k in range(1, most + 1) if tried[k][3] >= 1.6448536269514722]
        assert adf_statistic(y, regression=regression, autolag="t")[1] == max(significant, default=0)
    assert adf_p_value(rng.standard_normal(300), regression=regression) < 0.01 and adf_p_value(np.cumsum(rng.standard_normal(300)), regression=regression) > 0.05


def test_arguments_of_the_search():
    y = np.cumsum(np.random.default_rng(1).standard_normal(200))
    for wrong in ({"regression": "x"}, {"autolag": "x"}):
        with pytest.raises(ValueError):
            adf_p_value(y, **wrong)
        with pytest.raises(ValueError):
            model.smallest_order(y, 1e-3, 12, **wrong)
    assert model.smallest_order(y[:10]) == 1.0 and model.smallest_order(y[:10], grid=(0.2, 0.4)) == 0.4
    found = model.smallest_order(y, 1e-3, 12)
    assert 0 < found <= 1 and model.smallest_order(y, 1e-3, 12, grid=(0.0, found)) == pytest.approx(found, abs=0.011)


def test_search_on_names_of_text(spark):
    rng = np.random.default_rng(2)
    paths = {"AAPL": np.cumsum(np.abs(rng.standard_normal(120)) * 0.1), "B": rng.standard_normal(120) * 0.1}
    px = spark.createDataFrame([(t, k, float(np.exp(x))) for k, path in paths.items() for t, x in enumerate(path)], "t int, ticker string, close double")
    got = {r["ticker"]: r["d"] for r in model.search_orders(px, threshold=1e-3, max_lags=12).collect()}
    assert got.keys() == paths.keys() and got["AAPL"] > got["B"] == 0.0
    tests = {r["ticker"]: r for r in model.unit_root_statistics(px, lags=1).collect()}
    assert tests["B"]["tau"] == pytest.approx(plain_adf(paths["B"], "c", 1)[0], rel=1e-6) and tests["B"]["n"] == 120


def test_median_order(spark):
    for values in ([], [0.3], [0.1, 0.4], [0.2, 0.2, 0.9], [0.1, 0.2, 0.2, 0.5]):
        frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "ticker int, d double")
        assert model.median_order(frame) == pytest.approx(float(np.median(values)) if values else 1.0)


def test_conjugate_gradients(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((8, 8))
    matrix = a @ a.T + 0.5 * np.eye(8)
    right = {(t, k): float(rng.standard_normal()) for t in range(4) for k in range(8) if not (t == 1 and k in (2, 5)) and t != 2} | {(2, 3): 0.0, (2, 4): 0.0}
    long = spark.createDataFrame([(i, j, float(matrix[i, j])) for i in range(8) for j in range(8)], "ticker int, other int, value double")
    got = {(r["t"], r["ticker"]): r["aim"] for r in research.solved(long, spark.createDataFrame([(*k, v) for k, v in right.items()], "t int, ticker int, aim double")).collect()}
    assert got.keys() == right.keys()
    for t in range(4):
        held = sorted(k for d, k in right if d == t)
        wanted = np.linalg.solve(matrix[np.ix_(held, held)], [right[t, k] for k in held])
        assert [got[t, k] for k in held] == pytest.approx(wanted, abs=1e-9)
    with pytest.raises(ArithmeticError):
        research.solved(long, spark.createDataFrame([(0, k, 1.0) for k in range(8)], "t int, ticker int, aim double"), rounds=2).count()


def test_checkpoint_versions(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        files.read_checkpoint(spark, path)
    first, second = (spark.createDataFrame([(k,)], "ticker string") for k in ("A", "B"))
    names = lambda: sorted(r["ticker"] for r in files.read_checkpoint(spark, path).collect())
    files.write_checkpoint(first, path)
    assert names() == ["A"]
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("X")).alias("ticker"))
    for append in (False, True):  # a job that ends halfway: the old table stays readable
        with pytest.raises(Exception, match="lost"):
            files.write_checkpoint(broken, path, append=append)
        assert names() == ["A"]
    files.write_checkpoint(second, path, append=True)
    assert names() == ["A", "B"]
    files.write_checkpoint(second, path)
    assert names() == ["B"]
    assert files.clear_checkpoint(spark, path) >= 2 and names() == ["B"]


def test_zipped_metadata_with_quoted_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("m.csv", 'exchange,ticker,startDate,endDate,assetType\nNYSE,"A\nA",2000-01-01,,"Common, Stock"\nOTC,BB,,2001-02-03,Fund\n')
    got = files.read_metadata(spark, str(tmp_path / "m.zip")).orderBy("ticker").collect()
    assert [tuple(r) for r in got] == [("A\nA", "NYSE", "Common, Stock", datetime.date(2000, 1, 1), None), ("BB", "OTC", "Fund", None, datetime.date(2001, 2, 3))]
