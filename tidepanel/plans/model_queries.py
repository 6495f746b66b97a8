"""Queries on fractional differentiation, signal decay, policies, scores and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_ticker
from ..operators import execution, features, ffd, portfolio, returns, scoring, universe
from ..sources.scratch import merged, settled
from ..sources.tables import month_panel, smooth_panel
from .catalog import query, round_all
from .panel_queries import ELIGIBLE, FLOORS, SIGNAL
from .sql import LABELS, P1, P3, RET_GAP, RET_MODEL, z_columns

THRESHOLD, LAGS = 1e-5, 60


def taps_sql(orders: str, threshold: str = "1e-4", lags: int = 60) -> str:
    """Recursive taps of the orders that a query ``orders`` selects as d."""
    return f"""
g(d, k, w) AS (
  SELECT d, 0, 1.0::DOUBLE FROM ({orders})
  UNION ALL SELECT d, k + 1, -w * (d - k) / (k + 1) FROM g WHERE k + 1 < {lags} AND abs(-w * (d - k) / (k + 1)) >= {threshold})"""


@query("ffd_weights", P1.replace("WITH", "WITH RECURSIVE", 1) + "," + taps_sql("SELECT DISTINCT (ticker % 19) / 10.0::DOUBLE AS d FROM p") + " SELECT d, k, round(w, 10) AS w FROM g")
def ffd_weights(spark, sf_dir):
    """The taps of all orders that the panel's names ask for."""
    return round_all(ffd.tap_table(month_panel(spark, sf_dir).select(((F.col("ticker") % 19) / 10.0).alias("d"))), {"w": 10})


#: Levels of every supplier; each ticker's order in the second.
LEVEL = """,
x AS (SELECT t, date, ticker, ln(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS x, {d} AS d FROM p),
y AS (
  SELECT a.t, a.ticker, a.date, CASE WHEN count(b.x) = (SELECT count(*) FROM g WHERE g.d = any_value(a.d)) THEN sum(g.w * b.x) END AS level
  FROM x a JOIN g ON g.d = a.d LEFT JOIN x b ON b.ticker = a.ticker AND b.t = a.t - g.k GROUP BY 1, 2, 3)"""
LEVEL = LEVEL.replace("CASE WHEN count(b.x) = (SELECT count(*) FROM g WHERE g.d = any_value(a.d)) THEN sum(g.w * b.x) END", "CASE WHEN count(b.x) = count(*) THEN sum(g.w * b.x) END")


def level_sql(base: str, orders: str, d: str) -> str:
    return base.replace("WITH", "WITH RECURSIVE", 1) + "," + taps_sql(orders, "1e-5", LAGS) + LEVEL.format(d=d)


UNIFORM = level_sql(P1, "SELECT 0.4::DOUBLE AS d", "0.4::DOUBLE")
PER_TICKER = level_sql(P1, "SELECT DISTINCT (3 + k) / 10.0::DOUBLE AS d FROM range(4) r(k)", "(3 + ticker % 4) / 10.0::DOUBLE")


def orders_by_ticker(source: DataFrame) -> DataFrame:
    return source.select("ticker").distinct().withColumn("d", (F.col("ticker") % 4 + 3) / 10.0)


@query("ffd_level", UNIFORM + " SELECT t, ticker, round(level, 6) AS level FROM y")
def ffd_level(spark, sf_dir):
    return round_all(ffd.level(month_panel(spark, sf_dir), 0.4, THRESHOLD, LAGS).select("t", "ticker", "level"), {"level": 6})


ROLLING = ", ".join(f"CASE WHEN count(level) OVER (w ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW) >= {max(1, m // 2)} THEN round(avg(level) OVER (w ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW), 6) END AS ffd{m}" for m in (3, 6, 9, 12))


@query("ffd_scores_rolling", PER_TICKER + f" SELECT t, ticker, round(level, 6) AS ffd1, {ROLLING} FROM y WINDOW w AS (PARTITION BY ticker ORDER BY t)")
def ffd_scores_rolling(spark, sf_dir):
    source = month_panel(spark, sf_dir)
    scores = ffd.rolling_scores(ffd.level_by_ticker(source, orders_by_ticker(source), THRESHOLD, LAGS))
    names = [f"ffd{m}" for m in (1, 3, 6, 9, 12)]
    return round_all(scores.select("t", "ticker", *names), dict.fromkeys(names, 6))


SLOPES = """,
s AS (SELECT t, date, ticker, level AS ffd1, level - lag(level, 3) OVER w AS ffd3, level - lag(level, 12) OVER w AS ffd12 FROM y WINDOW w AS (PARTITION BY ticker ORDER BY t))"""


@query("ffd_scores_slope", UNIFORM + SLOPES + " SELECT t, ticker, round(ffd1, 6) AS ffd1, round(ffd3, 6) AS ffd3, round(ffd12, 6) AS ffd12 FROM s")
def ffd_scores_slope(spark, sf_dir):
    scores = ffd.slope_scores(ffd.level(month_panel(spark, sf_dir), 0.4, THRESHOLD, LAGS))
    return round_all(scores.select("t", "ticker", "ffd1", "ffd3", "ffd12"), dict.fromkeys(["ffd1", "ffd3", "ffd12"], 6))


FFDS = ("ffd1", "ffd3", "ffd12")
LAGGED = ", ".join(f"lag({n}) OVER (PARTITION BY ticker ORDER BY t) AS {n}" for n in FFDS)


@query("feat_ffd", UNIFORM + SLOPES + f", h AS (SELECT t, ticker, {LAGGED} FROM s), z AS (SELECT t, ticker, {z_columns(FFDS)} FROM h WHERE t >= 19) SELECT t, ticker, " + ", ".join(f"round({p}{n}, 6) AS {p}{n}" for n in FFDS for p in "zm") + " FROM z")
def feat_ffd(spark, sf_dir):
    scores = ffd.slope_scores(ffd.level(month_panel(spark, sf_dir), 0.4, THRESHOLD, LAGS))
    lagged = scores.withColumns({n: F.lag(n).over(by_ticker()) for n in FFDS}).where(F.col("t") >= features.FIRST)
    names = [f"{p}{n}" for n in FFDS for p in "zm"]
    return round_all(features.standardised(lagged, list(FFDS)).select("t", "ticker", *names), dict.fromkeys(names, 6))


@query("ffd_median_d", P1 + " SELECT median((3 + ticker % 4) / 10.0::DOUBLE) AS d, count(*) AS n FROM (SELECT DISTINCT ticker FROM p)")
def ffd_median_d(spark, sf_dir):
    return orders_by_ticker(month_panel(spark, sf_dir)).agg(F.median("d").alias("d"), F.count(F.lit(1)).alias("n"))


ACF = """,
a0 AS (SELECT {by}, t, signal - avg(signal) OVER (PARTITION BY {by}) AS x FROM {rel} WHERE signal IS NOT NULL),
a1 AS (SELECT {by}, x, x * lag(x) OVER (PARTITION BY {by} ORDER BY t) AS xx FROM a0),
a2 AS (SELECT {by}, count(*) AS n, avg(x * x) AS c0, avg(xx) AS c1 FROM a1 GROUP BY {by}),
a AS (SELECT {by}, CASE WHEN coalesce(n, 0) < 3 THEN 0.5 WHEN c0 < 1e-15 THEN 0 ELSE greatest(0.01, least(0.99, c1 / c0)) END AS phi FROM (SELECT DISTINCT {by} FROM {rel}) LEFT JOIN a2 USING ({by}))"""


@query("decay_acf1", P3 + SIGNAL + ACF.format(by="ticker", rel="s") + " SELECT ticker, round(phi, 6) AS phi FROM a")
def decay_acf1(spark, sf_dir):
    return round_all(execution.acf1(features.price_momentum(smooth_panel(spark, sf_dir)), ["ticker"]), {"phi": 6})


EXPANDED = ", o AS (SELECT e.t AS fin, s.t, s.ticker, s.signal FROM s JOIN (SELECT DISTINCT t FROM s WHERE t >= 23) e ON s.t BETWEEN e.t - 23 AND e.t)"
ROLLING_PHI = P3 + SIGNAL + EXPANDED + ACF.format(by="fin, ticker", rel="o") + ", f AS (SELECT fin AS t, avg(phi) AS phi FROM a GROUP BY fin)"


@query("decay_rolling", ROLLING_PHI + " SELECT t, round(phi, 6) AS phi FROM f")
def decay_rolling(spark, sf_dir):
    return round_all(execution.rolling_acf1(features.price_momentum(smooth_panel(spark, sf_dir))), {"phi": 6})


PARAMS = P3 + SIGNAL + ACF.format(by="ticker", rel="s") + """,
c AS (SELECT cost, (sqrt(pow(1 + cost * 0.001, 2) + 4 * cost * 0.999) - (1 + cost * 0.001)) / (2 * 0.999 * cost) AS a FROM (SELECT unnest([0.5, 1, 2, 5, 10])::DOUBLE AS cost))
SELECT ticker, cost, round(phi, 6) AS phi, round(a, 8) AS a, round(least(greatest(a / cost, 0), 1), 8) AS fraction, round(1 / (1 + phi * a), 6) AS aim_weight FROM a CROSS JOIN c"""


@query("policy_params", PARAMS)
def policy_params(spark, sf_dir):
    """The parameters of policies for each name, from the decay of its own signal."""
    decay = execution.acf1(features.price_momentum(smooth_panel(spark, sf_dir)), ["ticker"])
    table = execution.parameters(decay, [execution.Policy(cost=c) for c in (0.5, 1.0, 2.0, 5.0, 10.0)])
    return round_all(table.select("ticker", "cost", "phi", "a", "fraction", "aim_weight"), {"phi": 6, "a": 8, "fraction": 8, "aim_weight": 6})


def weights_on(source: DataFrame, q: float = 0.1) -> DataFrame:
    """Dense weights of the price-momentum signal: every name of every date from the first signal on."""
    held = portfolio.long_short(features.price_momentum(source), q, min_names=2)
    dense = source.select("t", "date", "ticker").join(merged(held.select("t", "ticker", "w")), ["t", "ticker"], "left")
    return dense.where(F.col("t") >= 13).select("t", "date", "ticker", F.coalesce("w", F.lit(0.0)).alias("w"))


def momentum_weights(spark, sf_dir) -> DataFrame:
    return weights_on(settled(smooth_panel(spark, sf_dir), "panel"))


#: The same weights in SQL: n best and worst by signal; dense in b.
WEIGHTS = """,
n AS (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY t) * {q}::DOUBLE))::INT AS n, count(*) OVER (PARTITION BY t) AS size,
  row_number() OVER (PARTITION BY t ORDER BY signal DESC, ticker) AS hi, row_number() OVER (PARTITION BY t ORDER BY signal, ticker) AS lo FROM s WHERE signal IS NOT NULL),
h AS (SELECT t, date, ticker, CASE WHEN lo <= n THEN -1.0::DOUBLE / n WHEN hi <= n THEN 1.0::DOUBLE / n ELSE 0.0::DOUBLE END AS w FROM n WHERE size >= {least}),
b AS (SELECT p.t, p.date, p.ticker, coalesce(h.w, 0) AS w FROM p LEFT JOIN h ON h.t = p.t AND h.ticker = p.ticker WHERE p.t >= 13)"""
DENSE = P3 + SIGNAL + WEIGHTS.format(q=0.1, least=2)

FOLD = """,
v AS (SELECT b.t, list(b.w ORDER BY ticker) AS w, list(ticker ORDER BY ticker) AS names FROM b GROUP BY b.t),
u AS (SELECT v.t, v.w, v.names, c.run, c.cost, {phi} AS phi, (sqrt(pow(1 + cost * 0.001, 2) + 4 * cost * 0.999) - (1 + cost * 0.001)) / (2 * 0.999 * cost) AS a FROM v CROSS JOIN ({runs}) c {join}),
k AS (SELECT t, w, names, run, least(greatest(a / cost, 0), 1) AS f, 1 / (1 + phi * a) AS aw FROM u),
z(t, run, x) AS (
  SELECT 12, run, list_transform(names, lambda q: 0.0::DOUBLE) FROM k WHERE t = 13
  UNION ALL
  SELECT t, run, list_transform(y, lambda q: q * CASE WHEN g > 0 THEN 2.0::DOUBLE / g ELSE 1 END) FROM (
    SELECT t, run, y, list_sum(list_transform(y, lambda q: abs(q))) AS g FROM (
      SELECT k.t, k.run, list_transform(list_zip(z.x, k.w), lambda q: (1 - f) * q[1] + f * aw * q[2]) AS y FROM z JOIN k ON k.t = z.t + 1 AND k.run = z.run)))
SELECT run, t, unnest(names) AS ticker, round(unnest(x), 6) AS w FROM z JOIN v USING (t)"""
ONE_RUN = "SELECT 'base' AS run, 2.0::DOUBLE AS cost"


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("policy_run", recursive(DENSE) + FOLD.format(phi="0.65::DOUBLE", runs=ONE_RUN, join=""))
def policy_run(spark, sf_dir):
    return round_all(execution.run_policies(momentum_weights(spark, sf_dir), {"base": execution.Policy()}, 0.65), {"w": 6})


PHI_JOIN = "LEFT JOIN (SELECT d2.t, (SELECT arg_max(phi, f.t) FROM f WHERE f.t <= d2.t) AS phi FROM (SELECT DISTINCT t FROM b) d2) pf ON pf.t = v.t"


@query("policy_run_rolling", recursive(ROLLING_PHI) + WEIGHTS.format(q=0.1, least=2) + FOLD.format(phi="coalesce(pf.phi, 0.65)", runs=ONE_RUN, join=PHI_JOIN))
def policy_run_rolling(spark, sf_dir):
    decay = execution.rolling_acf1(features.price_momentum(smooth_panel(spark, sf_dir)))
    return round_all(execution.run_policies(momentum_weights(spark, sf_dir), {"base": execution.Policy()}, decay), {"w": 6})


SWEEP = (0.5, 1.0, 2.0, 5.0, 10.0)
RUNS = " UNION ALL ".join(f"SELECT 'cost {c}' AS run, {c}::DOUBLE AS cost" for c in SWEEP)


@query("policy_sweep", recursive(DENSE) + FOLD.format(phi="0.65::DOUBLE", runs=RUNS, join=""))
def policy_sweep(spark, sf_dir):
    return round_all(execution.run_policies(momentum_weights(spark, sf_dir), {f"cost {c}": execution.Policy(cost=c) for c in SWEEP}, 0.65), {"w": 6})


def made_up_probabilities(source: DataFrame) -> DataFrame:
    """``t, ticker, p``: ten probabilities from a formula; the names of a month differ in each weight, so that no scores tie."""
    weight = lambda k: 1 + (F.col("ticker") * 7919 + F.col("t") * 1301 + k * 2903) % 9973
    raw = F.transform(F.sequence(F.lit(1), F.lit(10)), weight)
    total = F.aggregate(raw, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return source.select("t", "ticker", raw.alias("_r"), total.alias("_t")).select("t", "ticker", F.transform("_r", lambda x: x / F.col("_t")).alias("p"))


PROBS = """,
c AS (SELECT k::INT AS k, coalesce(avg(ret), 0) AS mu, coalesce(var_samp(ret), 1e-4) AS sigma2 FROM range(10) g(k) LEFT JOIN l ON label = k GROUP BY k),
o AS (SELECT t, ticker, k, (1 + (ticker * 7919 + t * 1301 + (k + 1) * 2903) % 9973)::DOUBLE AS r FROM p CROSS JOIN c),
b AS (SELECT t, ticker, k, r / sum(r) OVER (PARTITION BY t, ticker) AS q FROM o),
e AS (SELECT t, ticker, sum(q * CASE WHEN k < 5 THEN 5 - k ELSE 4 - k END) AS dpr, sum(q * mu) AS mean, sum(q * (sigma2 + mu * mu)) AS second FROM b JOIN c USING (k) GROUP BY 1, 2)"""
SCORES = P1 + RET_MODEL + LABELS + PROBS


def scored(spark, sf_dir) -> DataFrame:
    source = month_panel(spark, sf_dir)
    stats = features.class_stats(features.decile_labels(returns.model_returns(source)))
    return scoring.with_scores(made_up_probabilities(source), stats)


@query("score_dpr", SCORES + " SELECT t, ticker, round(dpr, 6) AS score FROM e")
def score_dpr(spark, sf_dir):
    return scored(spark, sf_dir).select("t", "ticker", F.round("dpr", 6).alias("score"))


@query("score_ret", SCORES + " SELECT t, ticker, round(mean, 6) AS score FROM e")
def score_ret(spark, sf_dir):
    return scored(spark, sf_dir).select("t", "ticker", F.round("ret_score", 6).alias("score"))


@query("score_srp", SCORES + " SELECT t, ticker, round(mean / sqrt(greatest(second - mean * mean, 1e-12)), 6) AS score FROM e")
def score_srp(spark, sf_dir):
    return scored(spark, sf_dir).select("t", "ticker", F.round("srp", 6).alias("score"))


SIGNALS = P3 + SIGNAL
GUARD = 5


@query("weights_long_short", SIGNALS + WEIGHTS.format(q=0.1, least=GUARD) + " SELECT t, ticker, round(w, 8) AS w FROM h")
def weights_long_short(spark, sf_dir):
    held = portfolio.long_short(features.price_momentum(smooth_panel(spark, sf_dir)), min_names=GUARD)
    return round_all(held.select("t", "ticker", "w"), {"w": 8})


@query("weights_long_only", SIGNALS + WEIGHTS.format(q=0.1, least=GUARD) + " SELECT t, ticker, round(CASE WHEN hi <= n THEN 1.0::DOUBLE / n ELSE 0 END, 8) AS w FROM n WHERE size >= 5")
def weights_long_only(spark, sf_dir):
    held = portfolio.long_short(features.price_momentum(smooth_panel(spark, sf_dir)), min_names=GUARD, short=False)
    return round_all(held.select("t", "ticker", "w"), {"w": 8})


SHORTABLE = ELIGIBLE.replace("v AS (", "v2 AS (").replace("FROM v)", "FROM v2)").replace("u AS (", "u2 AS (").replace("FROM u)", "FROM u2)").replace("b AS (", "b2 AS (") + """,
n2 AS (SELECT s.t, s.ticker, signal, shortable, greatest(1, floor(count(*) OVER (PARTITION BY s.t) * 0.1::DOUBLE))::INT AS n, count(*) OVER (PARTITION BY s.t) AS size,
  row_number() OVER (PARTITION BY s.t ORDER BY signal DESC, s.ticker) AS hi, row_number() OVER (PARTITION BY s.t, shortable ORDER BY signal, s.ticker) AS lo
  FROM s JOIN b2 ON b2.t = s.t AND b2.ticker = s.ticker WHERE signal IS NOT NULL)
SELECT t, ticker, round(CASE WHEN shortable AND lo <= n THEN -1.0::DOUBLE / n WHEN hi <= n THEN 1.0::DOUBLE / n ELSE 0 END, 8) AS w FROM n2 WHERE size >= 5"""


@query("weights_shortable", SIGNALS + SHORTABLE)
def weights_shortable(spark, sf_dir):
    source = smooth_panel(spark, sf_dir)
    masks = universe.eligibility(source, **FLOORS)
    held = portfolio.long_short(features.price_momentum(source), min_names=GUARD, shortable=masks)
    return round_all(held.select("t", "ticker", "w"), {"w": 8})


GUARDED = """,
n AS (SELECT t, ticker, greatest(1, floor(count(*) OVER (PARTITION BY t) * 0.05::DOUBLE))::INT AS n, count(signal) OVER (PARTITION BY t) AS valid,
  row_number() OVER (PARTITION BY t ORDER BY signal DESC NULLS LAST, ticker) AS hi, row_number() OVER (PARTITION BY t ORDER BY signal NULLS LAST, ticker) AS lo FROM s)
SELECT t, ticker, round(CASE WHEN lo <= n THEN -1.0::DOUBLE / n WHEN hi <= n THEN 1.0::DOUBLE / n ELSE 0 END, 8) AS w FROM n WHERE valid >= 2 * n"""


@query("weights_guarded", SIGNALS + GUARDED)
def weights_guarded(spark, sf_dir):
    return round_all(portfolio.guarded(features.price_momentum(smooth_panel(spark, sf_dir))).select("t", "ticker", "w"), {"w": 8})


SPREAD = RET_GAP + SIGNAL + """,
f AS (SELECT t, ticker, lead(ret) OVER (PARTITION BY ticker ORDER BY t) AS fwd FROM r),
n AS (SELECT s.t, fwd, greatest(1, floor(count(*) OVER (PARTITION BY s.t) * 0.1::DOUBLE)) AS n, row_number() OVER (PARTITION BY s.t ORDER BY signal DESC, s.ticker) AS hi, row_number() OVER (PARTITION BY s.t ORDER BY signal, s.ticker) AS lo
  FROM s JOIN f ON f.t = s.t AND f.ticker = s.ticker WHERE signal IS NOT NULL AND fwd IS NOT NULL),
g AS (SELECT t, avg(fwd) FILTER (hi <= n) - avg(fwd) FILTER (lo <= n) AS long_short, avg(fwd) FILTER (hi <= n) AS long_leg FROM n GROUP BY t)"""


def spreads(spark, sf_dir) -> DataFrame:
    source = smooth_panel(spark, sf_dir)
    forward = returns.simple_returns(source).select("t", "ticker", F.lead("ret").over(by_ticker()).alias("fwd"))
    signal = features.price_momentum(source).select("t", "ticker", F.col("signal").alias("score"))
    return portfolio.spread_returns(signal.join(merged(forward), ["t", "ticker"]))


@query("port_ret", P3 + SPREAD + " SELECT t, round(long_short, 6) AS long_short, round(long_leg, 6) AS long_leg FROM g")
def port_ret(spark, sf_dir):
    return round_all(spreads(spark, sf_dir), {"long_short": 6, "long_leg": 6})


@query("turnover_detail", DENSE + ", c AS (SELECT t, sum(abs(w - w0)) AS turnover FROM (SELECT t, w, lag(w) OVER (PARTITION BY ticker ORDER BY t) AS w0 FROM b) GROUP BY t) SELECT t, round(turnover, 6) AS turnover FROM c WHERE turnover IS NOT NULL")
def turnover_detail(spark, sf_dir):
    return round_all(portfolio.turnover_detail(momentum_weights(spark, sf_dir)), {"turnover": 6})


