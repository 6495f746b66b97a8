"""Queries on panels, returns, universes, features and labels, each beside its DuckDB equivalent."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import by_ticker, ratio
from ..operators import features, panel, portfolio, ranks, returns, universe
from ..sources import files
from ..sources.scratch import settled
from ..sources.tables import day_panel, month_panel, smooth_panel, table
from .catalog import query, round_all
from .sql import FEATURES, LABELS, MATRIX, P1, P2, P3, P4, RET_GAP, RET_MODEL, RET_PAD, rounded

#: Tiers and floors in the scale of the star schema.
TIERS = ((6e5, 0.0005), (4e5, 0.0010), (2e5, 0.0025), (5e4, 0.0060), (0.0, 0.0150))
FEES = ((6e5, 0.0025), (4e5, 0.0100), (2e5, 0.0500), (5e4, 0.2500), (0.0, 0.5000))
FLOORS = {"min_price": 900.0, "min_volume": 2e5, "short_min_volume": 3e5}


def tier_case(tiers, value: str = "dv3") -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {least!r} THEN {rate!r}::DOUBLE" for least, rate in tiers) + f" ELSE {tiers[-1][1]!r}::DOUBLE END"


@query("src_parquet_scan", "SELECT l_suppkey AS ticker, l_shipdate::DATE AS date, l_quantity AS volume, round(l_extendedprice * l_quantity, 2) AS dv FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_quantity < 10")
def src_parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 10))
    return lines.select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("volume"), F.round(F.col("l_extendedprice") * F.col("l_quantity"), 2).alias("dv"))


@query("panel_month_end_last", P4 + " SELECT ticker, last_day(date) AS date, arg_max(close, date) FILTER (close IS NOT NULL) AS close, arg_max(volume, date) AS volume FROM e GROUP BY 1, 2")
def panel_month_end_last(spark, sf_dir):
    return panel.month_end_last(day_panel(spark, sf_dir), ["close", "volume"])


@query("panel_pivot_last", "SELECT l_suppkey AS ticker, last_day(l_shipdate::DATE) AS date, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close FROM lineitem GROUP BY 1, 2")
def panel_pivot_last(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.last_day(F.col("l_shipdate").cast("date")).alias("date"), F.col("l_extendedprice").alias("close"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return panel.pivot_last(lines, "close", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])


@query("panel_densify", P2 + " SELECT t, date, ticker, close, volume, dv FROM p")
def panel_densify(spark, sf_dir):
    return month_panel(spark, sf_dir, "l_partkey")


@query("panel_ffill", P2 + " SELECT t, ticker, last_value(close IGNORE NULLS) OVER w AS close, last_value(dv IGNORE NULLS) OVER w AS dv FROM p WINDOW w AS (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def panel_ffill(spark, sf_dir):
    return panel.fill_forward(month_panel(spark, sf_dir, "l_partkey"), ["close", "dv"]).select("t", "ticker", "close", "dv")


def quarter_weights(source: DataFrame) -> DataFrame:
    """Weights on every third date, some names left out: a test case for as-of rows."""
    picked = source.where((F.col("t") % 3 == 1) & ((F.col("ticker") + F.col("t")) % 4 != 0))
    return picked.select("date", "ticker", ((F.col("ticker") % 7 - 3) / 10.0).alias("w"))


ASOF = """,
w AS (SELECT date, ticker, (ticker % 7 - 3) / 10.0::DOUBLE AS w FROM p WHERE t % 3 = 1 AND (ticker + t) % 4 <> 0),
k AS (SELECT d.date, max(m.date) AS mark FROM d JOIN (SELECT DISTINCT date FROM w) m ON m.date <= d.date GROUP BY 1)
"""


@query("panel_asof_weights", P1 + ASOF + "SELECT t, p.date, p.ticker, coalesce(w.w, 0) AS w FROM p LEFT JOIN k USING (date) LEFT JOIN w ON w.date = k.mark AND w.ticker = p.ticker")
def panel_asof_weights(spark, sf_dir):
    source = month_panel(spark, sf_dir)
    return panel.asof_weights(quarter_weights(source), source)


ASOF = """
WITH k AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT a.event_id, k.ts AS known_at, k.value AS known FROM (SELECT * FROM events WHERE event_type = 'view') a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.ts >= k.ts"""


@query("panel_asof_join", ASOF)
def panel_asof_join(spark, sf_dir):
    """Each view with its user's last other event before it: keys with times of their own."""
    events = table(spark, sf_dir, "events")
    known = events.where("event_type != 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("known")).withColumn("known_at", F.col("ts"))
    asked = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return panel.asof_join(asked, known, ["known_at", "known"], key="user_id", at="ts").select("event_id", "known_at", "known")


@query("panel_asof_trading_day", P4 + ", s AS (SELECT DISTINCT date_trunc('week', date)::DATE + 5 AS date FROM e) SELECT s.date, max(e.date) AS mark FROM s LEFT JOIN (SELECT DISTINCT date FROM e WHERE dayofweek(date) BETWEEN 1 AND 4) e ON e.date <= s.date GROUP BY 1")
def panel_asof_trading_day(spark, sf_dir):
    days = day_panel(spark, sf_dir).select("date").distinct()
    asked = days.select(F.date_add(F.trunc("date", "week"), 5).alias("date")).distinct()
    return panel.asof_dates(asked, days.where(F.dayofweek("date").between(2, 5)))


@query("panel_dedup_last", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts)::DATE AS date FROM events GROUP BY 1, 2")
def panel_dedup_last(spark, sf_dir):
    last = panel.dedup_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return last.select("user_id", "event_type", "event_id", F.col("ts").cast("date").alias("date"))


@query("panel_min_history", P2 + " SELECT ticker, count(*) AS n FROM p WHERE ticker IN (SELECT ticker FROM p GROUP BY 1 HAVING count(close) >= 26) GROUP BY 1")
def panel_min_history(spark, sf_dir):
    return panel.min_history(month_panel(spark, sf_dir, "l_partkey"), 26).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


DELIST = """,
z AS (SELECT ticker, max(t) AS last_t, arg_max(close, t) * 0.7::DOUBLE AS px FROM p WHERE close IS NOT NULL GROUP BY ticker)
SELECT t, p.ticker, CASE WHEN t = last_t + 1 THEN px ELSE close END AS close FROM p LEFT JOIN z USING (ticker)"""


@query("panel_delist_inject", P2 + DELIST)
def panel_delist_inject(spark, sf_dir):
    return panel.inject_delisting(month_panel(spark, sf_dir, "l_partkey")).select("t", "ticker", "close")


@query("universe_metadata_filter", "SELECT DISTINCT c_custkey AS ticker FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS d FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey < 20 AND (d IS NULL OR d >= DATE '2000-01-01')")
def universe_metadata_filter(spark, sf_dir):
    ended = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("endDate"))
    customers = table(spark, sf_dir, "customer").join(ended, F.col("o_custkey") == F.col("c_custkey"), "left")
    kind = F.when(F.col("c_nationkey") < 20, "Stock").otherwise("Fund")
    metadata = customers.select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("exchange"), kind.alias("assetType"), "endDate")
    return panel.filter_universe(metadata, ["BUILDING", "MACHINERY"], "Stock", datetime.date(2000, 1, 1))


@query("ingest_remaining_anti", "SELECT DISTINCT s_suppkey AS ticker FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-11-01')")
def ingest_remaining_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-11-01").cast("timestamp_ntz")).select(F.col("l_suppkey").alias("ticker"))
    return files.remaining(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ticker")).distinct(), done)


@query("ret_gap", P2 + RET_GAP + " SELECT t, ticker, round(ret, 6) AS ret FROM r")
def ret_gap(spark, sf_dir):
    return round_all(returns.simple_returns(month_panel(spark, sf_dir, "l_partkey")).select("t", "ticker", "ret"), {"ret": 6})


@query("ret_padded", P2 + RET_PAD + " SELECT t, ticker, round(ret, 6) AS ret FROM r")
def ret_padded(spark, sf_dir):
    return round_all(returns.simple_returns(month_panel(spark, sf_dir, "l_partkey"), fill="pad").select("t", "ticker", "ret"), {"ret": 6})


@query("ret_clip", P1 + RET_PAD + " SELECT t, ticker, round(CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.5), 0.5) END, 6) AS ret FROM r")
def ret_clip(spark, sf_dir):
    padded = returns.simple_returns(month_panel(spark, sf_dir), fill="pad")
    return round_all(returns.clip_returns(padded, -0.5, 0.5).select("t", "ticker", "ret"), {"ret": 6})


@query("ret_mask_winsor", P1 + RET_MODEL + " SELECT t, ticker, round(ret, 6) AS ret FROM r")
def ret_mask_winsor(spark, sf_dir):
    return round_all(returns.model_returns(month_panel(spark, sf_dir)).select("t", "ticker", "ret"), {"ret": 6})


PNL = (
    RET_PAD.replace("r AS (", "r0 AS (")
    + """,
r1 AS (SELECT * REPLACE (CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.95), 3.0) END AS ret) FROM r0),
q AS (SELECT t, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM r1 GROUP BY t),
r2 AS (SELECT r1.* REPLACE (CASE WHEN ret IS NOT NULL THEN least(greatest(ret, lo), hi) END AS ret) FROM r1 JOIN q USING (t))
SELECT t, ticker, CASE WHEN close IS NOT NULL THEN round(ln(product(1 + coalesce(ret, 0)) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) END AS log_close FROM r2"""
)


@query("pnl_price_path", P2 + PNL)
def pnl_price_path(spark, sf_dir):
    path = returns.pnl_prices(month_panel(spark, sf_dir, "l_partkey").select("t", "ticker", "close"))
    return path.select("t", "ticker", F.round(F.log("close"), 6).alias("log_close"))


@query("size_proxy", P2 + " SELECT t, ticker, round(last_value(close * volume IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS dv FROM p")
def size_proxy(spark, sf_dir):
    return round_all(returns.size_proxy(month_panel(spark, sf_dir, "l_partkey")).select("t", "ticker", "dv"), {"dv": 2})


DV3 = ", v AS (SELECT *, avg(dv) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS dv3 FROM p)"


@query("tier_cost", P1 + DV3 + f" SELECT t, ticker, {tier_case(TIERS)} AS rate FROM v")
def tier_cost(spark, sf_dir):
    return universe.tiered_costs(month_panel(spark, sf_dir), TIERS).select("t", "ticker", "rate")


@query("tier_borrow", P1 + DV3 + f" SELECT t, ticker, {tier_case(FEES)} AS rate FROM v")
def tier_borrow(spark, sf_dir):
    return universe.tiered_costs(month_panel(spark, sf_dir), FEES).select("t", "ticker", "rate")


RATES = """,
g AS (SELECT date, ticker, (ticker % 5 + t % 3) / 1000.0::DOUBLE AS rate FROM p WHERE (ticker + t) % 5 = 0)
SELECT t, p.ticker, coalesce(last_value(rate IGNORE NULLS) OVER (PARTITION BY p.ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), (SELECT max(rate) FROM g)) AS rate
FROM p LEFT JOIN g USING (date, ticker)"""


@query("rate_align", P1 + RATES)
def rate_align(spark, sf_dir):
    source = month_panel(spark, sf_dir)
    known = source.where((F.col("ticker") + F.col("t")) % 5 == 0).select("date", "ticker", ((F.col("ticker") % 5 + F.col("t") % 3) / 1000.0).alias("rate"))
    return universe.align_rates(source, known).select("t", "ticker", "rate")


ELIGIBLE = """,
v AS (
  SELECT *, sum((close IS NOT NULL)::INT) OVER s AS nv, sum(coalesce(close > 900, false)::INT) OVER s AS ng, count(*) OVER s AS rows, avg(dv) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS dv3
  FROM p WINDOW s AS (PARTITION BY ticker ORDER BY t ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)),
u AS (SELECT *, rows >= 12 AND ng / greatest(nv, 1)::DOUBLE >= 0.7::DOUBLE AND close > 900 AND nv >= 12 AND dv3 >= 200000 AS e FROM v),
b AS (SELECT t, date, ticker, coalesce(e, false) AS eligible, coalesce(e AND dv3 >= 300000, false) AS shortable FROM u)"""


@query("eligibility", P1 + ELIGIBLE + " SELECT t, ticker, eligible FROM b")
def eligibility(spark, sf_dir):
    return universe.eligibility(month_panel(spark, sf_dir), **FLOORS).select("t", "ticker", "eligible")


@query("shortable", P1 + ELIGIBLE + " SELECT t, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (shortable) AS n_shortable FROM b GROUP BY t")
def shortable(spark, sf_dir):
    masks = universe.eligibility(month_panel(spark, sf_dir), **FLOORS)
    return masks.groupBy("t").agg(F.count_if("eligible").alias("n_eligible"), F.count_if("shortable").alias("n_shortable"))


COSTS = """,
h AS (SELECT t, median(dv) AS med FROM p GROUP BY t),
c AS (SELECT t, ticker, CASE WHEN dv IS NOT NULL THEN 0.001::DOUBLE * pow(greatest(dv / med, 0.01), -0.5) END AS cost FROM p JOIN h USING (t))
SELECT t, ticker, round(coalesce(cost, (SELECT max(cost) FROM c)), 8) AS cost FROM c"""


@query("cost_coefficients", P1 + COSTS)
def cost_coefficients(spark, sf_dir):
    return universe.cost_coefficients(month_panel(spark, sf_dir)).select("t", "ticker", F.round("cost", 8).alias("cost"))


def raw_features(spark, sf_dir):
    return features.size_decile(features.dynamics(features.momentum(returns.model_returns(month_panel(spark, sf_dir))))).where(F.col("t") >= features.FIRST)


X1 = P1 + RET_MODEL + FEATURES
MOMS = [f"mom{m}" for m in features.MOMENTUM]


@query("feat_mom", X1 + f" SELECT t, ticker, {rounded(MOMS)} FROM x1 WHERE t >= 19")
def feat_mom(spark, sf_dir):
    return round_all(raw_features(spark, sf_dir).select("t", "ticker", *MOMS), dict.fromkeys(MOMS, 6))


@query("feat_accel", X1 + " SELECT t, ticker, round(accel, 6) AS accel FROM x1 WHERE t >= 19")
def feat_accel(spark, sf_dir):
    return round_all(raw_features(spark, sf_dir).select("t", "ticker", "accel"), {"accel": 6})


@query("feat_vol", X1 + " SELECT t, ticker, round(vol, 6) AS vol FROM x1 WHERE t >= 19")
def feat_vol(spark, sf_dir):
    return round_all(raw_features(spark, sf_dir).select("t", "ticker", "vol"), {"vol": 6})


@query("feat_pos", X1 + " SELECT t, ticker, round(pos, 6) AS pos FROM x1 WHERE t >= 19")
def feat_pos(spark, sf_dir):
    return round_all(raw_features(spark, sf_dir).select("t", "ticker", "pos"), {"pos": 6})


@query("feat_size_decile", X1 + " SELECT t, ticker, size_decile FROM x1 WHERE t >= 19")
def feat_size_decile(spark, sf_dir):
    return raw_features(spark, sf_dir).select("t", "ticker", "size_decile")


NAMES = features.feature_names()
MATRIX_SQL = P1 + RET_MODEL + MATRIX


@query("feat_matrix", MATRIX_SQL + f" SELECT t, ticker, {rounded(NAMES)} FROM x")
def feat_matrix(spark, sf_dir):
    matrix = features.feature_matrix(returns.model_returns(month_panel(spark, sf_dir)))
    return round_all(matrix.select("t", "ticker", *NAMES), dict.fromkeys(NAMES, 6))


SIGNAL = """,
s0 AS (SELECT *, lag(close, 1) OVER (PARTITION BY ticker ORDER BY t) / nullif(lag(close, 13) OVER (PARTITION BY ticker ORDER BY t), 0) - 1 AS raw FROM p),
s AS (SELECT t, date, ticker, (raw - avg(raw) OVER (PARTITION BY t)) / nullif(stddev_samp(raw) OVER (PARTITION BY t), 0) AS signal FROM s0)"""


@query("signal_price_momentum", P3 + SIGNAL + " SELECT t, ticker, round(signal, 6) AS signal FROM s")
def signal_price_momentum(spark, sf_dir):
    return round_all(features.price_momentum(smooth_panel(spark, sf_dir)).select("t", "ticker", "signal"), {"signal": 6})


@query("label_decile", P2 + RET_GAP + LABELS + " SELECT t, ticker, label FROM l")
def label_decile(spark, sf_dir):
    return features.decile_labels(returns.simple_returns(month_panel(spark, sf_dir, "l_partkey"))).select("t", "ticker", "label")


@query("class_stats", P1 + RET_MODEL + LABELS + " SELECT k::INT AS k, round(coalesce(avg(ret), 0), 6) AS mu, round(coalesce(var_samp(ret), 1e-4), 6) AS sigma2 FROM range(10) g(k) LEFT JOIN l ON label = k GROUP BY k")
def class_stats(spark, sf_dir):
    stats = features.class_stats(features.decile_labels(returns.model_returns(month_panel(spark, sf_dir))))
    return round_all(stats, {"mu": 6, "sigma2": 6})


@query("minimum_slice", P1 + RET_GAP + """,
n AS (SELECT t, date, ticker, lead(ret) OVER (PARTITION BY ticker ORDER BY t) AS fwd, close FROM r),
s0 AS (SELECT *, lag(close, 1) OVER (PARTITION BY ticker ORDER BY t) / nullif(lag(close, 13) OVER (PARTITION BY ticker ORDER BY t), 0) - 1 AS raw FROM n),
z AS (SELECT *, count(*) OVER (PARTITION BY t) AS c, row_number() OVER (PARTITION BY t ORDER BY raw DESC, ticker) AS hi, row_number() OVER (PARTITION BY t ORDER BY raw, ticker) AS lo FROM s0 WHERE raw IS NOT NULL)
SELECT t, date, count(*) FILTER (hi <= greatest(1, floor(c * 0.1))) AS n_long, round(avg(fwd) FILTER (hi <= greatest(1, floor(c * 0.1))) - avg(fwd) FILTER (lo <= greatest(1, floor(c * 0.1))), 6) AS ret
FROM z GROUP BY t, date HAVING count(fwd) > 0""")
def minimum_slice(spark, sf_dir):
    """The next month's return of the best tenth by price momentum, less that of the worst tenth."""
    frame = returns.simple_returns(month_panel(spark, sf_dir)).withColumn("fwd", F.lead("ret").over(by_ticker()))
    frame = frame.withColumn("raw", ratio(F.lag("close", 1).over(by_ticker()), F.lag("close", 13).over(by_ticker())) - 1).where(F.col("raw").isNotNull())
    frame = ranks.with_sizes(portfolio.both_ends(settled(frame.select("t", "date", "ticker", "raw", "fwd"), "raw"), "raw"), "size")
    n = F.greatest(F.lit(1), F.floor(F.col("size") * 0.1))
    high, low = F.col("_best") <= n, F.col("_worst") <= n
    spread = F.avg(F.when(high, F.col("fwd"))) - F.avg(F.when(low, F.col("fwd")))
    return frame.groupBy("t", "date").agg(F.count_if(high).alias("n_long"), F.round(spread, 6).alias("ret"), F.count("fwd").alias("_n")).where("_n > 0").drop("_n")
