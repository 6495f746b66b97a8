"""Queries on the engine, its figures, walk-forward runs and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift, execution, features, ffd, metrics, model, portfolio, research, universe, walkforward
from ..operators.returns import model_returns, pnl_prices
from ..sources.scratch import bounded, merged, settled
from ..sources.tables import month_panel, smooth_panel
from .catalog import query, round_all
from .model_queries import DENSE, FOLD, P1, P3, SPREAD, SWEEP, THRESHOLD, recursive, spreads, weights_on
from .panel_queries import FEES, FLOORS, TIERS, tier_case

FREQ = 12
#: Taps of the comparison: with 60 and 12 months of slope, a panel of 71 months would leave nothing to train on.
SHORT_LAGS = 12


def targets_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Quarterly momentum targets, and the panel they are run on."""
    source = settled(smooth_panel(spark, sf_dir), "panel")  # used for signals, prices and both rates
    weights = settled(weights_on(source), "weights").select(F.lit("momentum").alias("strategy"), "t", "ticker", "w")
    quarterly = source.where("t % 3 = 1").select("t")
    return drift.schedule(weights, source, lag=0, signal_dates=quarterly), source


def rates_of(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    return universe.tiered_costs(source, TIERS), universe.tiered_costs(source, FEES)


def held_of(spark, sf_dir) -> DataFrame:
    targets, source = targets_of(spark, sf_dir)
    return drift.positions(targets, source, *rates_of(source))


def curve_of(spark, sf_dir) -> DataFrame:
    return settled(drift.curve(held_of(spark, sf_dir), freq=FREQ), "curve")  # one row a date


EXECUTED = """,
tgt AS (SELECT p.t, p.ticker, CASE WHEN p.close IS NOT NULL THEN b.w ELSE 0 END AS target FROM b JOIN p ON p.t = b.t + 1 AND p.ticker = b.ticker WHERE b.t % 3 = 1)"""
#: The engine on targets tgt(t, ticker, target), rates rt(t, ticker, tc, bf) and panel p.
ENGINE = """,
i0 AS (SELECT p.t, p.date, p.ticker, close / nullif(lag(close) OVER (PARTITION BY p.ticker ORDER BY p.t), 0) - 1 AS ret, tc, bf, target, p.t IN (SELECT t FROM tgt) AS ex
  FROM p JOIN rt ON rt.t = p.t AND rt.ticker = p.ticker LEFT JOIN tgt ON tgt.t = p.t AND tgt.ticker = p.ticker),
i1 AS (SELECT *, sum(ex::INT) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM i0),
i2 AS (SELECT *, CASE WHEN seg > 0 THEN first_value(coalesce(target, 0)) OVER g ELSE 0 END AS w0, product(1 + coalesce(ret, 0)) OVER g AS g FROM i1 WINDOW g AS (PARTITION BY ticker, seg ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
i3 AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY ticker, seg ORDER BY t), 1) AS g0 FROM i2),
i4 AS (SELECT *, 1 + sum(w0 * (g - 1)) OVER (PARTITION BY t) AS v, 1 + sum(w0 * (g0 - 1)) OVER (PARTITION BY t) AS v0 FROM i3),
pos AS (SELECT *, w0 * g0 / v0 AS held, w0 * g / v AS after_, coalesce(lag(w0 * g / v) OVER (PARTITION BY ticker ORDER BY t), 0) AS before_ FROM i4),
j AS (SELECT t, date, max(v) AS v, max(v0) AS v0, coalesce(sum(abs(held - before_)) FILTER (ex), 0) AS traded,
  least(coalesce(sum(abs(held - before_) * tc * CASE WHEN held < 0 THEN 1.5 ELSE 1 END) FILTER (ex), 0), 0.999) AS cost_frac,
  least(coalesce(sum(-held * bf / {freq}) FILTER (held < 0 AND t > 0), 0), 0.999) AS borrow_frac FROM pos GROUP BY t, date),
curve AS (SELECT t, date, product(CASE WHEN t > 0 THEN v / v0 ELSE 1 END * (1 - cost_frac) * (1 - borrow_frac)) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity, traded / 2 AS turnover, cost_frac, borrow_frac FROM j)"""
RATES = f""",
dv3 AS (SELECT *, avg(dv) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS dv3 FROM p),
rt AS (SELECT t, ticker, {tier_case(TIERS)} AS tc, {tier_case(FEES)} AS bf FROM dv3)"""
RUN = DENSE + EXECUTED + RATES + ENGINE.format(freq="12.0::DOUBLE")
NO_COST = ", rt AS (SELECT t, ticker, {tc}::DOUBLE AS tc, 0.0::DOUBLE AS bf FROM p)"


@query("exec_schedule", DENSE + EXECUTED + " SELECT t, ticker, round(target, 8) AS target FROM tgt")
def exec_schedule(spark, sf_dir):
    return round_all(targets_of(spark, sf_dir)[0].select("t", "ticker", "target"), {"target": 8})


@query("drift_weights", RUN + " SELECT t, ticker, round(before_, 8) AS before, round(held, 8) AS held, round(after_, 8) AS after FROM pos")
def drift_weights(spark, sf_dir):
    return round_all(held_of(spark, sf_dir).select("t", "ticker", "before", "held", "after"), {"before": 8, "held": 8, "after": 8})


@query("drift_equity", RUN + " SELECT t, date, round(equity, 8) AS equity FROM curve")
def drift_equity(spark, sf_dir):
    return round_all(curve_of(spark, sf_dir).select("t", "date", "equity"), {"equity": 8})


@query("drift_turnover_cost", RUN + " SELECT t, round(turnover, 8) AS turnover, round(cost_frac, 8) AS cost_frac FROM curve")
def drift_turnover_cost(spark, sf_dir):
    return round_all(curve_of(spark, sf_dir).select("t", "turnover", "cost_frac"), {"turnover": 8, "cost_frac": 8})


@query("drift_borrow", RUN + " SELECT t, round(borrow_frac, 8) AS borrow_frac FROM curve")
def drift_borrow(spark, sf_dir):
    return round_all(curve_of(spark, sf_dir).select("t", "borrow_frac"), {"borrow_frac": 8})


NUMBERS = [
    "total_return", "ann_return", "ann_vol", "sharpe", "sortino_ratio", "max_drawdown", "avg_drawdown", "cdar", "cvar", "cvar_ann", "downside_deviation", "expectancy",
    "win_rate", "avg_turnover", "ann_turnover", "total_turnover", "total_cost", "ann_borrow", "total_borrow",
]
FIGURES = """,
e0 AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, coalesce(equity / lag(equity) OVER (ORDER BY t) - 1, 0) AS ret, equity / max(equity) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM curve),
x AS (SELECT ret, row_number() OVER (ORDER BY ret) AS r, count(*) OVER () AS n FROM e0 WHERE i > 0),
y AS (SELECT dd, row_number() OVER (ORDER BY dd) AS r, count(*) OVER () AS n FROM e0),
z AS (SELECT count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, stddev_samp(ret) FILTER (ret < 0) AS neg, count(*) FILTER (ret < 0) AS nn, count(*) FILTER (ret > 0) AS np, avg(ret) FILTER (ret > 0) AS mp, avg(ret) FILTER (ret < 0) AS mn FROM x),
k AS (SELECT arg_max(equity, t) / arg_min(equity, t) AS factor, min(dd) AS max_drawdown, coalesce(avg(dd) FILTER (dd < 0), 0) AS avg_drawdown, avg(turnover) AS avg_turnover, sum(turnover) AS total_turnover,
  coalesce(sum(equity * cost_frac / greatest(1 - cost_frac, 1e-12)) FILTER (cost_frac > 0), 0) AS total_cost, avg(borrow_frac) FILTER (i > 0) * 12 AS ann_borrow,
  coalesce(sum(equity * borrow_frac / greatest(1 - borrow_frac, 1e-12)) FILTER (borrow_frac > 0), 0) AS total_borrow FROM e0),
cv AS (SELECT avg(ret) AS cvar FROM x WHERE r <= CASE WHEN ceil((1.0::DOUBLE - 0.95::DOUBLE) * n) BETWEEN 1 AND n - 1 THEN ceil((1.0::DOUBLE - 0.95::DOUBLE) * n) ELSE n END),
cd AS (SELECT avg(dd) AS cdar FROM y WHERE r <= CASE WHEN ceil((1.0::DOUBLE - 0.95::DOUBLE) * n) BETWEEN 1 AND n - 1 THEN ceil((1.0::DOUBLE - 0.95::DOUBLE) * n) ELSE n END),
fig AS (
  SELECT factor - 1 AS total_return, pow(factor, 12.0::DOUBLE / n) - 1 AS ann_return, std * sqrt(12) AS ann_vol, CASE WHEN std > 0 THEN mean / std * sqrt(12) END AS sharpe,
    CASE WHEN nn > 1 AND neg > 0 THEN (pow(factor, 12.0::DOUBLE / n) - 1) / (neg * sqrt(12)) END AS sortino_ratio, max_drawdown, avg_drawdown, cdar, cvar, cvar * sqrt(12) AS cvar_ann,
    CASE WHEN nn > 1 THEN neg * sqrt(12) END AS downside_deviation, np / n::DOUBLE * coalesce(mp, 0) + nn / n::DOUBLE * coalesce(mn, 0) AS expectancy, np / n::DOUBLE AS win_rate,
    avg_turnover, avg_turnover * 12 AS ann_turnover, total_turnover, total_cost, ann_borrow, total_borrow FROM z, k, cv, cd)"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS)


@query("metrics_all", RUN + FIGURES + f" SELECT 'momentum' AS strategy, {ROUNDED} FROM fig")
def metrics_all(spark, sf_dir):
    figures = metrics.metrics(curve_of(spark, sf_dir), freq=FREQ)
    return round_all(figures.select("strategy", *NUMBERS), dict.fromkeys(NUMBERS, 6))


@query("tail_cvar", RUN + FIGURES + " SELECT 'momentum' AS strategy, round(cvar, 8) AS cvar FROM cv")
def tail_cvar(spark, sf_dir):
    return round_all(metrics.tail_mean(metrics.with_returns(curve_of(spark, sf_dir)).where("i > 0"), "ret", "cvar"), {"cvar": 8})


@query("tail_cdar", RUN + FIGURES + " SELECT 'momentum' AS strategy, round(cdar, 8) AS cdar FROM cd")
def tail_cdar(spark, sf_dir):
    return round_all(metrics.tail_mean(metrics.with_returns(curve_of(spark, sf_dir)), "drawdown", "cdar"), {"cdar": 8})


@query("yearly_returns", RUN + FIGURES + " SELECT 'momentum' AS strategy, year(date)::INT AS year, round(arg_max(equity, t) / arg_min(equity, t) - 1, 6) AS ret, round(min(dd), 6) AS max_dd FROM e0 GROUP BY 2")
def yearly_returns(spark, sf_dir):
    return round_all(metrics.yearly(curve_of(spark, sf_dir)), {"ret": 6, "max_dd": 6})


LINES = " UNION ALL ".join(f"SELECT {k} AS position, '{label.replace("'", "''")}' AS metric, coalesce(printf('{form}', {c} * {float(scale)}::DOUBLE), '-') AS value FROM fig" for k, (label, c, form, scale) in enumerate(metrics.SUMMARY))


@query("summary_table", RUN + FIGURES + f" SELECT 'momentum' AS strategy, position, metric, value FROM ({LINES})")
def summary_table(spark, sf_dir):
    return metrics.summary(metrics.metrics(curve_of(spark, sf_dir), freq=FREQ))


PERF = """,
c0 AS (SELECT t, long_short, product(1 + long_short) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM g),
c1 AS (SELECT *, c / max(c) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM c0)
SELECT round(avg(long_short) * 12, 6) AS ann, round(avg(long_short) * 12 / (stddev_pop(long_short) * sqrt(12)), 6) AS sharpe, round(min(dd), 6) AS max_dd FROM c1"""


@query("perf_summary", P3 + SPREAD + PERF)
def perf_summary(spark, sf_dir):
    return round_all(metrics.performance(spreads(spark, sf_dir), "long_short"), {"ann": 6, "sharpe": 6, "max_dd": 6})


WALK = """,
bl AS (SELECT (row_number() OVER (ORDER BY start) - 1)::INT AS block, start, least(start + 5, (SELECT max(t) FROM p)) AS stop FROM range(24, (SELECT max(t) + 1 FROM p), 6) r(start)),
sl AS (SELECT block, ticker, arg_max(close, t) / nullif(arg_min(close, t), 0) AS g FROM p JOIN bl ON t >= start - 24 AND t < start GROUP BY 1, 2),
bm AS (SELECT block, ticker, 1.0::DOUBLE AS w FROM sl WHERE g IS NOT NULL QUALIFY g = max(g) OVER (PARTITION BY block))"""


def walk(spark, sf_dir):
    source = settled(smooth_panel(spark, sf_dir), "panel")
    plan = walkforward.blocks(source, 24, 6)
    return source, plan, walkforward.best_momentum(source, plan, 24, 6)


@query("walk_forward_blocks", P3 + WALK + " SELECT block, start::INT AS start, stop::INT AS stop, ticker, w FROM bl JOIN bm USING (block)")
def walk_forward_blocks(spark, sf_dir):
    _, plan, signals = walk(spark, sf_dir)
    return plan.join(signals, "block").select("block", "start", "stop", "ticker", "w")


WALK_RUN = P3 + WALK + """,
wb AS (SELECT p.t, p.ticker, coalesce(bm.w, 0) AS w FROM p JOIN bl ON p.t BETWEEN start AND stop LEFT JOIN bm ON bm.block = bl.block AND bm.ticker = p.ticker),
oos AS (SELECT t - 24 AS t, date, ticker, close FROM p WHERE t >= 24),
tgt AS (SELECT o.t, o.ticker, CASE WHEN o.close IS NOT NULL THEN wb.w ELSE 0 END AS target FROM wb JOIN oos o ON o.t = wb.t - 24 + 2 AND o.ticker = wb.ticker),
rt AS (SELECT t, ticker, 0.001::DOUBLE AS tc, 0.0::DOUBLE AS bf FROM oos)""" + ENGINE.format(freq="12.0::DOUBLE").replace("FROM p JOIN rt ON rt.t = p.t", "FROM oos p JOIN rt ON rt.t = p.t")


@query("walk_forward_backtest", WALK_RUN + " SELECT t, date, round(equity, 8) AS equity, round(turnover, 8) AS turnover FROM curve")
def walk_forward_backtest(spark, sf_dir):
    source, plan, signals = walk(spark, sf_dir)
    weights = walkforward.held_weights(source, plan, signals, "walk").withColumn("t", F.col("t") - 24)
    later = source.where("t >= 24").withColumn("t", F.col("t") - 24)
    run = drift.backtest(weights, later, freq=FREQ, lag=1, cost=0.001)
    return round_all(run.select("t", "date", "equity", "turnover"), {"equity": 8, "turnover": 8})


FIXED = """,
tgt AS (SELECT p.t, p.ticker, CASE WHEN p.close IS NOT NULL THEN (SELECT 1.0::DOUBLE / count(DISTINCT ticker) FROM p) ELSE 0 END AS target FROM p WHERE {when})"""


def equal_weights(source: DataFrame) -> DataFrame:
    names = source.select("ticker").distinct()
    return names.crossJoin(F.broadcast(names.agg(F.count(F.lit(1)).alias("n")))).select("ticker", (1 / F.col("n")).alias("w"))  # a single row


@query("static_weights_backtest", P3 + FIXED.format(when="t >= 2") + NO_COST.format(tc="0.002") + ENGINE.format(freq="12.0::DOUBLE") + " SELECT t, date, round(equity, 8) AS equity, round(turnover, 8) AS turnover, round(cost_frac, 8) AS cost_frac FROM curve")
def static_weights_backtest(spark, sf_dir):
    source = settled(smooth_panel(spark, sf_dir), "panel")
    run = drift.backtest(drift.hold(source, equal_weights(source), "equal"), source, freq=FREQ, lag=1, cost=0.002)
    return round_all(run.select("t", "date", "equity", "turnover", "cost_frac"), {"equity": 8, "turnover": 8, "cost_frac": 8})


@query("buy_and_hold", P3 + FIXED.format(when="t = 1") + NO_COST.format(tc="0.0") + ENGINE.format(freq="12.0::DOUBLE") + " SELECT t, date, round(equity, 8) AS equity FROM curve")
def buy_and_hold(spark, sf_dir):
    source = settled(smooth_panel(spark, sf_dir), "panel")
    run = drift.backtest(drift.hold(source, equal_weights(source), "hold"), source, freq=FREQ, lag=0, signal_dates=source.where("t = 0").select("t"))
    return round_all(run.select("t", "date", "equity"), {"equity": 8})


def bench_weights(source: DataFrame, masks: DataFrame, first: int, q: float = 0.1) -> DataFrame:
    """``t, date, ticker, w`` by ``zmom12`` of the features' month from ``first`` on, dated one month before: only eligible names, only shortable ones sold."""
    matrix = features.feature_matrix(bounded(settled(model_returns(source), "returns"), "ticker")).where(F.col("t") >= first)
    signals = matrix.select((F.col("t") - 1).alias("t"), "ticker", F.col("zmom12").alias("signal")).join(merged(masks.where("eligible").select("t", "date", "ticker")), ["t", "ticker"])
    held = settled(portfolio.long_short(signals, q, min_names=2, shortable=masks), "held")
    dense = source.select("t", "date", "ticker").join(F.broadcast(held.select("t").distinct()), "t", "left_semi")  # one row a date
    return dense.join(merged(held.select("t", "ticker", "w")), ["t", "ticker"], "left").select("t", "date", "ticker", F.coalesce("w", F.lit(0.0)).alias("w"))


def compared_weights(source: DataFrame, min_train: int = 24, seeds: int = 20, trees: int = 300) -> DataFrame:
    """``strategy, t, ticker, w`` of momentum, the learned model, the model with partial adjustment by its own decay, and all names alike."""
    first = features.FIRST + min_train
    masks = settled(universe.eligibility(source, **FLOORS), "masks")
    bench = bench_weights(source, masks, first)
    learned = settled(model.model_weights(source, min_train=min_train, last=36, min_names=2, seeds=seeds, trees=trees, masks=masks, threshold=THRESHOLD, max_lags=SHORT_LAGS), "learned")
    decay = execution.acf1(learned.select("t", "ticker", F.col("w").alias("signal")), ["ticker"]).agg(F.avg("phi")).first()[0]
    adjusted = execution.run_policies(learned, {"adjusted": execution.Policy()}, 0.65 if decay is None else decay)
    named = [frame.select(F.lit(name).alias("strategy"), "t", "ticker", "w") for name, frame in (("momentum", bench), ("model", learned), ("adjusted", adjusted))]
    held = drift.hold(source.where(F.col("t") >= first - 1), equal_weights(source), "equal")
    return settled(named[0].unionByName(named[1]).unionByName(named[2]).unionByName(held), "weights")


@query("compare_strategies", None)
def compare_strategies(spark, sf_dir):
    """:func:`compared_weights` as one run of the engine on cleaned prices and one table, from the first signal's month on."""
    source = settled(smooth_panel(spark, sf_dir), "panel")
    weights = compared_weights(source)
    begin = features.FIRST + 24 - 1
    later = lambda frame: frame.where(F.col("t") >= begin).withColumn("t", F.col("t") - begin)
    cost, fee = rates_of(source)
    run = settled(drift.backtest(later(weights), settled(later(pnl_prices(source)), "prices"), freq=FREQ, lag=0, cost=later(cost), borrow=later(fee)), "curve")
    return metrics.summary(metrics.metrics(run, freq=FREQ))


EVERY_DATE = """,
tgt AS (SELECT p.t, p.ticker, CASE WHEN p.close IS NOT NULL THEN b.w ELSE 0 END AS target FROM b JOIN p ON p.t = b.t + 1 AND p.ticker = b.ticker)"""


def _swept(cost: float) -> str:
    fold = FOLD.format(phi="0.65::DOUBLE", runs=f"SELECT 'cost {cost}' AS run, {cost}::DOUBLE AS cost", join="").replace("round(unnest(x), 6) AS w", "unnest(x) AS w")
    held = P3 + f", b AS (SELECT t, ticker, w FROM ({recursive(DENSE)}{fold}))"
    return f"SELECT 'cost {cost}' AS run, * FROM ({held}{EVERY_DATE}{RATES}{ENGINE.format(freq='12.0::DOUBLE')}{FIGURES} SELECT round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol, round(sharpe, 5) AS sharpe, round(ann_turnover, 6) AS ann_turnover FROM fig)"


@query("policy_sweep_engine", " UNION ALL ".join(_swept(c) for c in SWEEP))
def policy_sweep_engine(spark, sf_dir):
    """Each cost multiplier's policy run through the engine: what it returns, and what it trades."""
    source = settled(smooth_panel(spark, sf_dir), "panel")
    held = execution.run_policies(settled(weights_on(source), "weights"), {f"cost {c}": execution.Policy(cost=c) for c in SWEEP}, 0.65)
    weights = settled(held.select(F.col("run").alias("strategy"), "t", "ticker", "w"), "swept")
    figures = metrics.metrics(drift.backtest(weights, source, freq=FREQ, lag=0, cost=rates_of(source)[0], borrow=rates_of(source)[1]), freq=FREQ)
    return round_all(figures.select(F.col("strategy").alias("run"), "ann_return", "ann_vol", "sharpe", "ann_turnover"), {"ann_return": 6, "ann_vol": 6, "sharpe": 5, "ann_turnover": 6})


@query("d_search", None)
def d_search(spark, sf_dir):
    return model.search_orders(month_panel(spark, sf_dir))


@query("ffd_scores_searched", None)
def ffd_scores_searched(spark, sf_dir):
    """The chain whole: each name's order searched, their median, the level of that order, and its slopes."""
    source = settled(month_panel(spark, sf_dir), "panel")
    d = model.median_order(model.search_orders(source))
    return ffd.slope_scores(ffd.level(source, d)).select("t", "ticker", "ffd1", "ffd3", "ffd12", F.lit(d).alias("d"))


@query("ffd_scores_rolling_searched", None)
def ffd_scores_rolling_searched(spark, sf_dir):
    """The first form of the scores whole: each name filtered by its own searched order, and means of its level."""
    source = settled(month_panel(spark, sf_dir), "panel")
    orders = settled(model.search_orders(source), "orders")
    scores = ffd.rolling_scores(ffd.level_by_ticker(source, orders))
    return scores.join(orders, "ticker").select("t", "ticker", "d", *[f"ffd{m}" for m in (1, 3, 6, 9, 12)])


UNIT_ROOT = P1 + """,
x AS (SELECT ticker, t, ln(close) AS y, lag(ln(close)) OVER (PARTITION BY ticker ORDER BY t) AS before FROM p WHERE close IS NOT NULL),
c AS (SELECT ticker, y - before AS change, before FROM x WHERE before IS NOT NULL),
s AS (SELECT ticker, count(*) AS n, regr_slope(change, before) AS slope, regr_sxx(change, before) AS sxx, regr_syy(change, before) AS syy FROM c GROUP BY ticker)
SELECT ticker, round(slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx), 5) AS tau FROM s WHERE n > 9"""


@query("unit_root_tau", UNIT_ROOT)
def unit_root_tau(spark, sf_dir):
    """The unit-root statistic of each name's log price, without lags."""
    return round_all(model.unit_root_statistics(month_panel(spark, sf_dir), lags=0).where("n > 10").select("ticker", "tau"), {"tau": 5})


def learned(spark, sf_dir, last: int):
    """Panel, learned probabilities and labels, with up to ``last`` months of training."""
    source = settled(smooth_panel(spark, sf_dir), "panel")
    cut = features.FIRST + 24
    matrix, labels = model.model_pool(source, None, cut, threshold=THRESHOLD, max_lags=SHORT_LAGS, min_names=2)
    return source, settled(model.fit_predict(matrix, labels, min_train=24, last=last, cut=cut), "probs"), labels


@query("compared_learned_scores", None)
def compared_learned_scores(spark, sf_dir):
    """The research loop's table for learned probabilities: momentum and the three scores."""
    source, probs, labels = learned(spark, sf_dir, 36)
    signal = features.momentum(settled(model_returns(source), "returns")).select("t", "ticker", F.col("ret").alias("fwd"), F.col("mom12").alias("signal"))
    return research.compared_scores(probs, features.class_stats(labels.where(F.col("t") < features.FIRST + 24)), settled(signal, "bench"))


@query("model_weights_expanding", None)
def model_weights_expanding(spark, sf_dir):
    """Weights by the ratio of expected return to deviation, trained each year on all months before it."""
    source = settled(smooth_panel(spark, sf_dir), "panel")
    return model.model_weights(source, min_train=24, last=10_000, min_names=2, threshold=THRESHOLD, max_lags=SHORT_LAGS, score="srp")


FOLDS = P3 + """,
md AS (SELECT DISTINCT t, date FROM p),
due AS (SELECT * FROM md WHERE t >= (SELECT min(t) FROM md) + 24),
yr AS (SELECT year(date) AS y, min(t) AS cut, max(t) AS final, row_number() OVER (ORDER BY year(date)) - 1 AS fold FROM due GROUP BY 1),
pr AS (SELECT fold, cut, md.t, md.t < cut AS past, row_number() OVER (PARTITION BY fold, md.t < cut ORDER BY md.t DESC) AS age FROM yr JOIN md ON md.t <= final),
pk AS (SELECT *, count(*) FILTER (past) OVER (PARTITION BY fold) AS size FROM pr WHERE NOT past OR age <= 36)
SELECT fold::INT AS fold, cut::INT AS cut, t::INT AS t, CASE WHEN NOT past THEN 'new' WHEN age <= greatest(6, floor(size * 0.2)) THEN 'val' ELSE 'train' END AS role FROM pk WHERE size >= 18"""


@query("model_folds", FOLDS)
def model_folds(spark, sf_dir):
    return model.folds(smooth_panel(spark, sf_dir), 24, 36)


@query("ensemble_fit_predict", None)
def ensemble_fit_predict(spark, sf_dir):
    returns = settled(model_returns(month_panel(spark, sf_dir)), "returns")
    return model.fit_predict(features.feature_matrix(returns), features.decile_labels(returns), min_train=24, last=36, seeds=20, trees=300)


