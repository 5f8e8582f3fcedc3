"""Queries of trading policies, tuning, backtest scenarios and risk reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions.columns import round6
from seriesmill.operators import backtest, metrics, policy
from seriesmill.plans import panels
from seriesmill.plans.registry import query
from seriesmill.plans.sqltext import (
    FORECASTS, POLICY_COUNTS, POLICY_VALUES, RISK_VALUES, W, curve_cte, frame, gated, policy_cte, position_sql,
    quantile_cte, risk_cte, rounded, spearman_cte, HIT,
)

BY = ["symbol"]
PV = POLICY_VALUES.split(", ")
RV = RISK_VALUES.split(", ")
SCALE = "3 * stddev_pop(y_pred) OVER (PARTITION BY symbol)"


def _f(spark, d):
    return panels.forecasts(spark, d)


def positioned(policy_name: str, ret: str = "{0} * y_true", **kw) -> str:
    """CTE `pos`: forecasts with position and strategy return."""
    p = position_sql(policy_name, **kw)
    return FORECASTS + f""", pos AS (SELECT *, {ret.format('position')} AS strategy_return FROM (
      SELECT *, {p} AS position FROM forecasts))"""


@query("position", rounded(
    "SELECT symbol, date, " + ", ".join(f"{position_sql(p, scale=SCALE)} AS {p}" for p in policy.POLICIES) + " FROM forecasts",
    "symbol, date", ", ".join(policy.POLICIES), with_=FORECASTS))
def position(spark, d):
    f = _f(spark, d).withColumn("s", policy.sizing_scale("y_pred", BY))
    out = f.select("symbol", "date", *[policy.position("y_pred", p, scale=F.col("s")).alias(p) for p in policy.POLICIES])
    return round6(out, *policy.POLICIES)


VT = FORECASTS + f""", vt AS (
  SELECT *, least(greatest(coalesce(lag(raw) OVER w, 1), 0.5), 2.0) AS vol_scalar FROM (
    SELECT *, 0.15 / coalesce({gated('stddev_samp', 'ret', 21, 10)} * sqrt(252), 0.15) AS raw FROM forecasts
    WINDOW {frame(21)}) WINDOW {W})"""


@query("vol_target", rounded(
    "SELECT symbol, date, vol_scalar, sign(y_pred) * vol_scalar AS position FROM vt", "symbol, date", "vol_scalar, position", with_=VT))
def vol_target(spark, d):
    f = policy.vol_scalar("ret", BY)(_f(spark, d))
    f = f.withColumn("position", policy.position("y_pred", "long_short") * F.col("vol_scalar"))
    return round6(f.select("symbol", "date", "vol_scalar", "position"), "vol_scalar", "position")


COSTED = FORECASTS + f""", pos AS (
  SELECT *, position * y_true - abs(position - lag(position, 1, 0) OVER w) * 0.001 AS strategy_return FROM (
    SELECT *, {position_sql('thresholded', t='0.1')} AS position FROM forecasts) WINDOW {W})"""


def _costed(spark, d):
    f = _f(spark, d).withColumn("position", policy.position("y_pred", "thresholded", 0.1))
    return policy.strategy_returns(f, BY, 0.001)


@query("strategy_returns", rounded("SELECT symbol, date, strategy_return FROM pos", "symbol, date", "strategy_return", with_=COSTED))
def strategy_returns(spark, d):
    return round6(_costed(spark, d).select("symbol", "date", "strategy_return"), "strategy_return")


@query("equity_curve", rounded("SELECT symbol, date, equity FROM c", "symbol, date", "equity",
                               with_=COSTED + ", " + curve_cte("pos", "symbol", "c", "strategy_return")))
def equity_curve(spark, d):
    return round6(policy.equity_curve(_costed(spark, d), BY).select("symbol", "date", "equity"), "equity")


@query("max_drawdown", rounded("SELECT symbol, min(drawdown) AS max_drawdown FROM c GROUP BY symbol", "symbol", "max_drawdown",
                               with_=COSTED + ", " + curve_cte("pos", "symbol", "c", "strategy_return")))
def max_drawdown(spark, d):
    return round6(policy.max_drawdown(_costed(spark, d), BY), "max_drawdown")


MONTHLY = FORECASTS + f""", months AS (
  SELECT symbol, max(date) AS date, avg(y_pred) FILTER (rn <= 5) AS y_pred, coalesce(max(nxt) FILTER (rn = 1), 0) AS y_true
  FROM (SELECT *, lead(y_true) OVER w AS nxt,
          row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date DESC) AS rn
        FROM forecasts WINDOW {W}) GROUP BY symbol, date_trunc('month', date))"""


@query("monthly_signals", rounded("SELECT symbol, date, y_pred AS signal FROM months", "symbol, date", "signal", with_=MONTHLY))
def monthly_signals(spark, d):
    m = policy.monthly_signals(_f(spark, d), BY)
    return round6(m.select("symbol", "date", F.col("y_pred").alias("signal")), "signal")


@query("monthly_positions", rounded(
    f"SELECT symbol, date, {position_sql('thresholded', t='0.05')} AS position, {position_sql('continuous_sizing', scale=SCALE)} AS sized FROM months",
    "symbol, date", "position, sized", with_=MONTHLY))
def monthly_positions(spark, d):
    m = policy.monthly_signals(_f(spark, d), BY).withColumn("s", policy.sizing_scale("y_pred", BY))
    return round6(m.select("symbol", "date", policy.position("y_pred", "thresholded", 0.05).alias("position"),
                           policy.position("y_pred", "continuous_sizing", scale=F.col("s")).alias("sized")), "position", "sized")


@query("monthly_returns", rounded("SELECT symbol, date, y_true AS monthly_return FROM months", "symbol, date", "monthly_return", with_=MONTHLY))
def monthly_returns(spark, d):
    m = policy.monthly_signals(_f(spark, d), BY)
    return round6(m.select("symbol", "date", F.col("y_true").alias("monthly_return")), "monthly_return")


@query("evaluate_policy", rounded("SELECT * FROM ps", f"symbol, {POLICY_COUNTS}", POLICY_VALUES,
                                  with_=COSTED + ", " + policy_cte("pos", "symbol", "ps")))
def evaluate_policy(spark, d):
    return round6(policy.evaluate_policy(_f(spark, d), BY, "thresholded", threshold=0.1, cost=0.001), *PV)


@query("evaluate_policy_monthly", rounded(
    "SELECT * FROM ps", f"symbol, {POLICY_COUNTS}", POLICY_VALUES,
    with_=MONTHLY + f""", pos AS (SELECT *, position * y_true AS strategy_return FROM (
      SELECT *, {position_sql('continuous_sizing', scale=SCALE)} AS position FROM months)), """ + policy_cte("pos", "symbol", "ps", 12)))
def evaluate_policy_monthly(spark, d):
    return round6(policy.evaluate_policy(_f(spark, d), BY, "continuous_sizing", execution="monthly"), *PV)


ALL = VT + ", scaled AS (SELECT *, " + SCALE + " AS s FROM vt), pos AS (SELECT *, position * y_true AS strategy_return FROM (" + \
    " UNION ALL ".join(
        f"SELECT symbol, date, y_true, y_pred, '{p}{tag}' AS policy, {position_sql(p, t='0.1', scale='s')}{mul} AS position FROM scaled"
        for tag, mul in (("", ""), ("_vt", " * 1")) for p in policy.POLICIES) + ")), " + policy_cte("pos", "symbol, policy", "ps")
for _p in policy.POLICIES:  # the targeted variants multiply the whole position
    _sql = position_sql(_p, t="0.1", scale="s")
    ALL = ALL.replace(f"{_sql} * 1 AS position", f"({_sql}) * vol_scalar AS position")


@query("evaluate_all_policies", rounded("SELECT * FROM ps", f"symbol, policy, {POLICY_COUNTS}", POLICY_VALUES, with_=ALL))
def evaluate_all_policies(spark, d):
    return round6(policy.evaluate_all_policies(_f(spark, d), BY, threshold=0.1, vol_returns="ret"), *PV)


CLIPPED = positioned("long_short", p="least(greatest(y_pred, -0.2), 0.2)").replace(
    "FROM forecasts))", "FROM (SELECT * REPLACE (least(greatest(y_pred, -0.2), 0.2) AS y_pred) FROM forecasts)))")


@query("clipped_strategy", rounded("SELECT * FROM ps", f"symbol, {POLICY_COUNTS}", POLICY_VALUES,
                                   with_=CLIPPED + ", " + policy_cte("pos", "symbol", "ps")))
def clipped_strategy(spark, d):
    return round6(policy.clipped_strategy(_f(spark, d), BY, 0.2), *PV)


def grid_cte(source: str) -> str:
    step = 80.0 / 9
    shares = ", ".join(repr((10.0 + i * step) / 100.0) + "::DOUBLE" for i in range(10))
    fixed = ", ".join(f"{t}::DOUBLE" for t in policy.FIXED_THRESHOLDS)
    return f"""grids AS (
  SELECT symbol, CASE WHEN len(g) < 3 THEN [0.01::DOUBLE, 0.02, 0.03] ELSE g END AS grid FROM (
    SELECT symbol, list_filter(list_sort(list_distinct(list_concat(q, [{fixed}]))), lambda t: t >= 0 AND t <= top) AS g
    FROM (SELECT symbol, quantile_cont(abs(y_pred), [{shares}]) AS q, quantile_cont(abs(y_pred), 0.95) AS top
          FROM {source} GROUP BY symbol))),
candidates AS (SELECT symbol, unnest(grid) AS threshold FROM grids),
pos AS (SELECT *, position * y_true AS strategy_return FROM (
  SELECT s.*, threshold, {position_sql('thresholded', t='threshold')} AS position FROM {source} s JOIN candidates USING (symbol))),
{policy_cte("pos", "symbol, threshold", "ps")}"""


GRID = FORECASTS + ", " + grid_cte("forecasts")


@query("threshold_grid", rounded(
    "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY threshold) AS place, threshold FROM candidates",
    "symbol, place", "threshold", with_=GRID).replace("symbol, place,", "symbol, CAST(place AS INTEGER) AS place,", 1))
def threshold_grid(spark, d):
    g = policy.threshold_grid(_f(spark, d), BY)
    out = g.select("symbol", F.posexplode("grid").alias("i", "threshold"))
    return round6(out.select("symbol", (F.col("i") + 1).alias("place"), "threshold"), "threshold")


def best_sql(score: str) -> str:
    return f"""best AS (
  SELECT symbol, coalesce(arg_min(threshold, (round(-score, 10), threshold)) FILTER (score IS NOT NULL), min(threshold)) AS best_threshold,
         max(score) AS best_score, count(*) AS tried
  FROM (SELECT *, CASE WHEN holding_frequency >= 0.1 THEN {score} END AS score FROM ps) GROUP BY symbol)"""


@query("tune_threshold", rounded("SELECT * FROM best", "symbol, tried", "best_threshold, best_score", with_=GRID + ", " + best_sql("sharpe")))
def tune_threshold(spark, d):
    return round6(policy.tune_threshold(_f(spark, d), BY), "best_threshold", "best_score")


@query("tune_threshold_ic_spread", rounded(
    "SELECT * FROM best", "symbol, tried", "best_threshold, best_score", with_=GRID + ", " + best_sql("ic * spread")))
def tune_threshold_ic_spread(spark, d):
    return round6(policy.tune_threshold(_f(spark, d), BY, "ic_spread"), "best_threshold", "best_score")


HALVES = FORECASTS + """, halves AS (SELECT *, CASE WHEN date < DATE '1999-01-01' THEN 'val' ELSE 'test' END AS split FROM forecasts),
val AS (SELECT * FROM halves WHERE split = 'val')"""
TUNED = HALVES + ", " + grid_cte("val") + ", " + best_sql("sharpe") + f""",
applied AS (SELECT *, position * y_true AS strategy_return FROM (
  SELECT h.*, best_threshold, {position_sql('thresholded', t='best_threshold')} AS position FROM halves h JOIN best USING (symbol))),
{policy_cte("applied", "symbol, split, best_threshold", "te")}"""


def _halves(spark, d):
    return _f(spark, d).withColumn(
        "split", F.when(F.col("date") < F.lit("1999-01-01").cast("date"), "val").otherwise("test"))


@query("tune_and_evaluate", rounded("SELECT * FROM te", f"symbol, split, {POLICY_COUNTS}", "best_threshold, " + POLICY_VALUES, with_=TUNED))
def tune_and_evaluate(spark, d):
    return round6(policy.tune_and_evaluate(_halves(spark, d), BY), "best_threshold", *PV)


TV, TS = "FILTER (split = 'val')", "FILTER (split = 'test')"
STRICT = "CASE WHEN count(*) FILTER (split = 'val' AND sharpe IS NULL) = 0 THEN {0} END"


@query("aggregate_tuned", rounded(
    f"""SELECT count(*) {TS} AS n_folds, avg(best_threshold) {TS} AS threshold_mean, stddev_pop(best_threshold) {TS} AS threshold_std,
      min(best_threshold) {TS} AS threshold_min, max(best_threshold) {TS} AS threshold_max,
      {STRICT.format(f'avg(sharpe) {TV}')} AS val_sharpe_mean, {STRICT.format(f'stddev_pop(sharpe) {TV}')} AS val_sharpe_std,
      avg(sharpe) {TS} AS test_sharpe_mean, stddev_pop(sharpe) {TS} AS test_sharpe_std, quantile_cont(sharpe, 0.5) {TS} AS test_sharpe_median,
      avg(total_return) {TS} AS test_return_mean, sum(total_return) {TS} AS test_return_sum, avg(hit_rate) {TS} AS test_hit_rate_mean,
      CAST(sum(trade_count) {TS} AS BIGINT) AS test_trade_count_total FROM te""",
    "n_folds, test_trade_count_total",
    "threshold_mean, threshold_std, threshold_min, threshold_max, val_sharpe_mean, val_sharpe_std, test_sharpe_mean, test_sharpe_std,"
    " test_sharpe_median, test_return_mean, test_return_sum, test_hit_rate_mean", with_=TUNED))
def aggregate_tuned(spark, d):
    out = policy.aggregate_tuned(policy.tune_and_evaluate(_halves(spark, d), BY, ranks=False))
    return round6(out, *[c for c, t in out.dtypes if t == "double"])


ZSCORED = FORECASTS + """, z AS (SELECT *, (y_pred - m) / s AS z, CAST(sign(y_pred) AS DOUBLE) AS position FROM forecasts JOIN (
  SELECT fold_id, avg(y_pred) AS m, stddev_pop(y_pred) AS s FROM forecasts GROUP BY fold_id) USING (fold_id))"""


def _z(spark, d):
    f = _f(spark, d)
    stats = f.groupBy("fold_id").agg(F.avg("y_pred").alias("m"), F.stddev_pop("y_pred").alias("s"))
    return f.join(stats, "fold_id").withColumns(
        {"z": (F.col("y_pred") - F.col("m")) / F.col("s"), "position": F.signum("y_pred")})


def best_of(expr: str, name: str, grid) -> str:
    values = ", ".join(f"{g}::DOUBLE" for g in grid)
    return f"""SELECT fold_id, arg_min({name}, (round(-sharpe, 10), {name})) AS best_{name}, max(sharpe) AS best_sharpe FROM (
      SELECT fold_id, {name}, CASE WHEN stddev_pop(r) > 1e-8 THEN avg(r) / stddev_pop(r) * sqrt(12) ELSE 0 END AS sharpe FROM (
        SELECT fold_id, {name}, {expr} AS r FROM z, (SELECT unnest([{values}]) AS {name})) GROUP BY fold_id, {name}) GROUP BY fold_id"""


@query("tune_k", rounded(best_of("least(greatest(k * z, -1), 1) * y_true", "k", policy.K_GRID), "fold_id, best_k", "best_sharpe", with_=ZSCORED))
def tune_k(spark, d):
    return round6(policy.tune_k(_z(spark, d), ["fold_id"]), "best_sharpe")


@query("tune_regime_cap", rounded(
    best_of("CASE WHEN regime = 0 THEN position * cap ELSE position END * y_true", "cap", policy.CAP_GRID),
    "fold_id, best_cap", "best_sharpe", with_=ZSCORED))
def tune_regime_cap(spark, d):
    return round6(policy.tune_regime_cap(_z(spark, d), ["fold_id"]), "best_sharpe")


def coverage_cte() -> str:
    shares = ", ".join(f"{p / 100.0}::DOUBLE" for p in policy.COVERAGE_PERCENTILES)
    return f"""cov_grid AS (SELECT symbol, unnest(list_sort(list_distinct(list_concat([0.0::DOUBLE], q)))) AS threshold FROM (
    SELECT symbol, quantile_cont(abs(y_pred), [{shares}]) AS q FROM forecasts GROUP BY symbol)),
pos AS (SELECT *, position * y_true AS strategy_return FROM (
  SELECT s.*, threshold, {position_sql('thresholded', t='threshold')} AS position FROM forecasts s JOIN cov_grid USING (symbol))),
{policy_cte("pos", "symbol, threshold", "ps")},
curve AS (SELECT symbol, threshold, holding_frequency AS coverage, sharpe, total_return, trade_count,
    CASE WHEN trade_count > 5 THEN ic ELSE 0 END AS ic_when_trading FROM ps),
{spearman_cte("curve", "symbol", "cc", "coverage", "sharpe")},
summary AS (SELECT symbol, arg_min(threshold, (round(-sharpe, 10), threshold)) FILTER (coverage > 0.05 AND sharpe IS NOT NULL) AS best_threshold,
    arg_min(coverage, (round(-sharpe, 10), threshold)) FILTER (coverage > 0.05 AND sharpe IS NOT NULL) AS best_coverage,
    max(sharpe) FILTER (coverage > 0.05) AS best_sharpe FROM curve GROUP BY symbol)"""


COVERAGE = FORECASTS + ", " + coverage_cte()
CV = "threshold, coverage, sharpe, total_return, ic_when_trading"


@query("coverage_performance", rounded("SELECT * FROM curve", "symbol, trade_count", CV, with_=COVERAGE))
def coverage_performance(spark, d):
    return round6(policy.coverage_performance(_f(spark, d), BY)[0], *CV.split(", "))


CONC = "ic, hit_rate, spread, tstat, monotonicity, top_mean, bottom_mean, best_threshold, best_coverage, best_sharpe, coverage_sharpe_corr"


@query("signal_concentration", rounded(
    """SELECT s.*, cc.ic AS coverage_sharpe_corr, fic.ic, fh.hit_rate, fq.spread, fq.tstat, fq.monotonicity, fq.top_mean, fq.bottom_mean
       FROM summary s JOIN cc USING (symbol) JOIN fic USING (symbol) JOIN fh USING (symbol) JOIN fq USING (symbol)""",
    "symbol", CONC, with_=COVERAGE + ", " + spearman_cte("forecasts", "symbol", "fic") + f""",
    fh AS (SELECT symbol, {HIT} AS hit_rate FROM forecasts GROUP BY symbol), """ + quantile_cte("forecasts", "symbol", "fq")))
def signal_concentration(spark, d):
    f = _f(spark, d)
    q = metrics.quantile_analysis(f, BY, is_series=True, p_value=False).drop("top_count", "bottom_count")
    out = (policy.coverage_performance(f, BY)[1]
           .join(metrics.information_coefficient(f, BY, is_series=True).drop("n"), BY)
           .join(metrics.hit_rate(f, BY), BY).join(q, BY))
    return round6(out, *CONC.split(", "))


# --- backtest and risk ------------------------------------------------------

SIGNALS = {"ls_daily": position_sql("long_short"), "long_only_daily": position_sql("long_flat"),
           "big_move_daily": position_sql("thresholded", t="0.1")}
SCENARIO = FORECASTS + f""", sig AS (SELECT *, {", ".join(f"{e} AS s_{n}" for n, e in SIGNALS.items())},
    row_number() OVER w AS rn FROM forecasts WINDOW {W}),
held AS (SELECT *, {", ".join(f"{gated('avg', f's_{n}', 21)} AS m_{n}" for n in SIGNALS)},
    last_value(CASE WHEN (rn - 1) % 21 = 0 THEN s_ls_daily END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS m_ls_monthly
  FROM sig WINDOW {frame(21)}),
moved AS (SELECT *, {", ".join(f"coalesce(lag(m_{n}) OVER w, 0) AS {n}" for n in (*SIGNALS, "ls_monthly"))} FROM held WINDOW {W}),
scen AS (SELECT symbol, date, 'buy_and_hold' AS scenario, ret AS pnl FROM forecasts UNION ALL """ + " UNION ALL ".join(
    f"SELECT symbol, date, '{n}', {n} * ret - coalesce(abs({n} - lag({n}) OVER w), 0) * 0.0005 FROM moved WINDOW {W}"
    for n in (*SIGNALS, "ls_monthly")) + "), ls AS (SELECT symbol, date, pnl FROM scen WHERE scenario = 'ls_daily')"


@query("scenario_daily", rounded("SELECT symbol, date, ls_daily, big_move_daily FROM moved", "symbol, date", "ls_daily, big_move_daily", with_=SCENARIO))
def scenario_daily(spark, d):
    f = backtest.scenario_daily(_f(spark, d), BY, out="ls_daily")
    f = backtest.scenario_daily(f, BY, "big_move", threshold=0.1, out="big_move_daily")
    return round6(f.select("symbol", "date", "ls_daily", "big_move_daily"), "ls_daily", "big_move_daily")


@query("scenario_monthly", rounded("SELECT symbol, date, ls_monthly FROM moved", "symbol, date", "ls_monthly", with_=SCENARIO))
def scenario_monthly(spark, d):
    f = backtest.scenario_monthly(_f(spark, d), BY, out="ls_monthly")
    return round6(f.select("symbol", "date", "ls_monthly"), "ls_monthly")


def _pnl(spark, d):
    return backtest.scenario_pnl(backtest.scenario_daily(_f(spark, d), BY), BY)


@query("scenario_pnl", rounded("SELECT symbol, date, pnl FROM ls", "symbol, date", "pnl", with_=SCENARIO))
def scenario_pnl(spark, d):
    return round6(_pnl(spark, d).select("symbol", "date", "pnl"), "pnl")


RISK = SCENARIO + ", " + risk_cte("ls", "symbol", "risk")


@query("risk_metrics", rounded("SELECT * FROM risk", "symbol, dd_duration", RISK_VALUES, with_=RISK).replace(
    "dd_duration,", "CAST(dd_duration AS INTEGER) AS dd_duration,", 0))
def risk_metrics(spark, d):
    out = backtest.risk_metrics(_pnl(spark, d), BY)
    return round6(out.withColumn("dd_duration", F.col("dd_duration").cast("bigint")), *RV)


@query("drawdown_duration", f"WITH {RISK} SELECT symbol, dd_duration FROM risk")
def drawdown_duration(spark, d):
    out = backtest.drawdown_duration(_pnl(spark, d), BY)
    return out.withColumn("dd_duration", F.col("dd_duration").cast("bigint"))


@query("sortino", rounded(
    "SELECT fold_id, avg(ret) * 252 / (sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(252)) AS sortino FROM forecasts GROUP BY fold_id",
    "fold_id", "sortino", with_=FORECASTS))
def sortino(spark, d):
    return round6(backtest.sortino(_f(spark, d), ["fold_id"], "ret"), "sortino")


@query("calmar", rounded("SELECT symbol, calmar FROM risk", "symbol", "calmar", with_=RISK))
def calmar(spark, d):
    return round6(backtest.calmar(_pnl(spark, d), BY), "calmar")


@query("scenario_report", rounded("SELECT * FROM risk", "symbol, scenario, dd_duration", RISK_VALUES,
                                  with_=SCENARIO + ", " + risk_cte("scen", "symbol, scenario", "risk")))
def scenario_report(spark, d):
    out = backtest.scenario_report(_f(spark, d), BY, threshold=0.1)
    return round6(out.withColumn("dd_duration", F.col("dd_duration").cast("bigint")), *RV)


EXT = "beta, correlation, up_capture, down_capture, skew, kurtosis, var_95, cvar_95, avg_trade, best_month, worst_month"


@query("extended_risk", rounded(
    """SELECT * FROM (
      SELECT symbol, regr_slope(pnl, ret) AS beta, corr(pnl, ret) AS correlation,
        avg(pnl) FILTER (ret > 0) / avg(ret) FILTER (ret > 0) AS up_capture, avg(pnl) FILTER (ret < 0) / avg(ret) FILTER (ret < 0) AS down_capture,
        avg((pnl - m) ** 3) / avg((pnl - m) ** 2) ** 1.5 AS skew, avg((pnl - m) ** 4) / avg((pnl - m) ** 2) ** 2 - 3 AS kurtosis,
        max(v) AS var_95, avg(pnl) FILTER (pnl <= v) AS cvar_95, avg(pnl) FILTER (pnl <> 0) AS avg_trade, count(*) FILTER (pnl <> 0) AS trades
      FROM (SELECT ls.*, f.ret, avg(pnl) OVER p AS m, quantile_cont(pnl, 0.05) OVER p AS v FROM ls JOIN forecasts f USING (symbol, date)
            WINDOW p AS (PARTITION BY symbol)) GROUP BY symbol)
    JOIN (SELECT symbol, max(r) AS best_month, min(r) AS worst_month FROM (
      SELECT symbol, product(1 + pnl) - 1 AS r FROM ls GROUP BY symbol, date_trunc('month', date)) GROUP BY symbol) USING (symbol)""",
    "symbol, trades", EXT, with_=SCENARIO))
def extended_risk(spark, d):
    return round6(backtest.extended_risk(_pnl(spark, d), BY), *EXT.split(", "))


@query("rolling_sharpe", rounded(
    f"SELECT symbol, date, {gated('avg', 'pnl', 63)} / nullif({gated('stddev_samp', 'pnl', 63)}, 0) * sqrt(252) AS rolling_sharpe FROM ls WINDOW {frame(63)}",
    "symbol, date", "rolling_sharpe", with_=SCENARIO))
def rolling_sharpe(spark, d):
    out = backtest.rolling_sharpe(_pnl(spark, d), BY)
    return round6(out.select("symbol", "date", "rolling_sharpe"), "rolling_sharpe")


OVERLAY = FORECASTS + f""", scaled AS (SELECT *, coalesce(lag(least(greatest(0.15 / v, 0.5), 2.0)) OVER w, 1) AS k FROM (
    SELECT *, coalesce({gated('stddev_samp', 'ret', 63, 21)} * sqrt(252), 0.15) AS v FROM forecasts WINDOW {frame(63)}) WINDOW {W}),
strat AS (SELECT symbol, date, 'raw' AS strategy, sign(y_pred) * ret AS pnl FROM scaled
  UNION ALL SELECT symbol, date, 'vol_target', sign(y_pred) * ret * k FROM scaled
  UNION ALL SELECT symbol, date, 'buy_and_hold', ret FROM scaled), """ + risk_cte("strat", "symbol, strategy", "risk")


@query("ensemble_overlay", rounded("SELECT * FROM risk", "symbol, strategy", "sharpe, total_return, max_drawdown", with_=OVERLAY))
def ensemble_overlay(spark, d):
    return round6(backtest.ensemble_overlay(_f(spark, d), BY), "sharpe", "total_return", "max_drawdown")
