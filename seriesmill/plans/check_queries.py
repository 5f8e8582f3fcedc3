"""Queries of data checks and of the streaming operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from seriesmill.functions.columns import Series, round6
from seriesmill.operators import checks, rolling, splits
from seriesmill.plans import panels
from seriesmill.plans.registry import query
from seriesmill.plans.split_queries import WF, WF_ARGS
from seriesmill.plans.sqltext import ARRIVALS, FORECASTS, PRICES, W, frame, gated, rounded, spearman_cte
from seriesmill.plans.store_queries import ALIGNED, aligned
from seriesmill.streaming import refresh

X = ["y_pred", "ret", "f1", "f2", "regime"]


def _f(spark, d):
    return panels.forecasts(spark, d)


@query("null_percentages", rounded(
    """SELECT * FROM (SELECT 'close' AS column_name, 100.0 * count(*) FILTER (close IS NULL) / count(*) AS pct FROM aligned
       UNION ALL SELECT 'volume', 100.0 * count(*) FILTER (volume IS NULL) / count(*) FROM aligned) WHERE pct > 0""",
    "column_name", "pct", with_=ALIGNED))
def null_percentages(spark, d):
    return round6(checks.null_percentages(aligned(spark, d), ["symbol", "close", "volume"]), "pct")


LAGGED = PRICES + f", lagged AS (SELECT *, close / lag(close, 21) OVER w - 1 AS r21, close / lag(close, 63) OVER w - 1 AS r63 FROM prices WINDOW {W})"


def _lagged(spark, d):
    p = rolling.trailing_return(panels.prices(spark, d), 21, out="r21")
    return rolling.trailing_return(p, 63, out="r63")


@query("row_null_counts", f"""WITH {LAGGED}, n AS (SELECT CAST(r21 IS NULL AS INTEGER) + CAST(r63 IS NULL AS INTEGER) AS k FROM lagged)
  SELECT count(*) AS n_rows, max(k) AS max_nulls, count(*) FILTER (k = 0) AS complete_rows FROM n""")
def row_null_counts(spark, d):
    return checks.row_null_counts(_lagged(spark, d), ["r21", "r63"])


@query("leading_nulls", f"""WITH {LAGGED}, u AS (SELECT symbol, date, 'r21' AS column_name, r21 AS v FROM lagged UNION ALL SELECT symbol, date, 'r63', r63 FROM lagged),
  f AS (SELECT symbol, column_name, min(date) FILTER (v IS NOT NULL) AS first_valid FROM u GROUP BY symbol, column_name)
  SELECT symbol, column_name, first_valid, count(*) FILTER (first_valid IS NULL OR date < first_valid) AS leading
  FROM u JOIN f USING (symbol, column_name) GROUP BY symbol, column_name, first_valid""")
def leading_nulls(spark, d):
    return checks.leading_nulls(_lagged(spark, d), ["r21", "r63"])


@query("data_range", rounded(
    """SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, CAST(2 AS INTEGER) AS n_features,
       date_diff('day', min(date), max(date)) / 365.25 AS years FROM prices GROUP BY symbol""",
    "symbol, first_date, last_date, n_rows, n_features", "years", with_=PRICES))
def data_range(spark, d):
    return round6(checks.data_range(panels.prices(spark, d), 2, ["symbol"]), "years")


LAGS = FORECASTS + """, pairs AS (SELECT symbol, lag, y_true, before FROM (
    SELECT symbol, k AS lag, y_true, lag(y_true, CAST(k AS INTEGER)) OVER (PARTITION BY symbol, k ORDER BY date) AS before
    FROM forecasts, range(1, 26) t(k)) WHERE before IS NOT NULL), """ + spearman_cte("pairs", "symbol, lag", "ac", "y_true", "before")


@query("target_autocorr", rounded("SELECT symbol, CAST(lag AS INTEGER) AS lag, n AS pairs, CASE WHEN n > 10 THEN ic ELSE 0 END AS autocorr FROM ac",
                                  "symbol, lag, pairs", "autocorr", with_=LAGS))
def target_autocorr(spark, d):
    return round6(checks.target_autocorr(_f(spark, d)), "autocorr")


LONG = FORECASTS + ", long_rows AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, y_true FROM forecasts WHERE {c} IS NOT NULL" for c in X) + "), " \
    + spearman_cte("long_rows", "feature", "lc", "x", "y_true")


@query("leakage_correlation", rounded(
    "SELECT feature, n AS pairs, ic AS correlation, abs(ic) > 0.5 AS suspicious FROM lc WHERE n > 10 ORDER BY abs(ic) DESC, feature LIMIT 5",
    "feature, pairs, suspicious", "correlation", with_=LONG))
def leakage_correlation(spark, d):
    return round6(checks.leakage_correlation(_f(spark, d), X, "y_true"), "correlation")


@query("pearson_ranking", rounded(
    "SELECT *, CASE WHEN abs(correlation) > 0.95 THEN 'identical' WHEN abs(correlation) > 0.8 THEN 'severe' WHEN abs(correlation) > 0.5"
    " THEN 'suspicious' ELSE 'ok' END AS level FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, corr({c}, y_true) AS correlation FROM forecasts" for c in X) + ")",
    "column_name, level", "correlation", with_=FORECASTS))
def pearson_ranking(spark, d):
    return round6(checks.pearson_ranking(_f(spark, d), X, "y_true"), "correlation")


@query("correlation_matrix", rounded(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS correlation FROM forecasts" for i, a in enumerate(X) for b in X[i + 1:]),
    "a, b", "correlation", with_=FORECASTS))
def correlation_matrix(spark, d):
    return round6(checks.correlation_matrix(_f(spark, d), X), "correlation")


SHUFFLED = FORECASTS + f""", r AS (SELECT seed, symbol, date, y_true FROM forecasts, (SELECT unnest([0, 1, 2, 3, 4]) AS seed)),
a AS (SELECT seed, y_true, row_number() OVER (PARTITION BY seed ORDER BY symbol, date) AS k FROM r),
b AS (SELECT seed, y_true AS y_pred, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws('|', seed, symbol, date)), symbol, date) AS k FROM r),
paired AS (SELECT seed, y_true, y_pred FROM a JOIN b USING (seed, k)), {spearman_cte("paired", "seed", "sic")},
gains AS (SELECT seed, avg(sign(y_pred) * y_true) / stddev_pop(sign(y_pred) * y_true) * sqrt(252) AS sharpe FROM paired WHERE y_pred <> 0 GROUP BY seed)"""


@query("null_model_shuffle", rounded(
    """SELECT avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, avg(sharpe) AS sharpe_mean, stddev_pop(sharpe) AS sharpe_std, abs(avg(ic)) < 0.07 AS passed
       FROM sic JOIN gains USING (seed)""", "passed", "ic_mean, ic_std, sharpe_mean, sharpe_std", with_=SHUFFLED))
def null_model_shuffle(spark, d):
    return round6(checks.null_model_shuffle(_f(spark, d)), "ic_mean", "ic_std", "sharpe_mean", "sharpe_std")


@query("null_model_constant", f"WITH {FORECASTS} SELECT symbol, CAST(0 AS BIGINT) AS trade_count, 0.0::DOUBLE AS total_return, TRUE AS passed FROM forecasts GROUP BY symbol")
def null_model_constant(spark, d):
    return checks.null_model_constant(_f(spark, d))


@query("null_model_perfect", rounded("SELECT symbol, 1.0 AS ic, 1.0 AS hit_rate, TRUE AS passed FROM forecasts GROUP BY symbol",
                                     "symbol, passed", "ic, hit_rate", with_=FORECASTS))
def null_model_perfect(spark, d):
    return round6(checks.null_model_perfect(_f(spark, d)), "ic", "hit_rate")


SANITY = FORECASTS + "".join(cte[len(FORECASTS):] for cte in (LAGS, LONG, SHUFFLED)) + WF[len(PRICES):] + f""", found AS (
SELECT 'missing_values' AS name, greatest({", ".join(f"100.0 * count(*) FILTER ({c} IS NULL) / count(*)" for c in X)}) AS value, 0.0 AS low, 0.0 AS high FROM forecasts
UNION ALL SELECT 'enough_rows', count(*), 253, 1e300 FROM forecasts
UNION ALL SELECT 'embargo_ok', count(*) FILTER (test_lo - train_hi - 1 < 21 OR train_hi_date >= test_lo_date), 0, 0 FROM dated
UNION ALL SELECT 'no_leakage_corr', count(*) FILTER (abs(ic) > 0.5), 0, 0 FROM lc WHERE n > 10
UNION ALL SELECT 'autocorr_checked', avg(CASE WHEN n > 10 THEN ic ELSE 0 END), -1e300, 1e300
  FROM (SELECT DISTINCT symbol FROM forecasts) LEFT JOIN (SELECT * FROM ac WHERE lag = 1) USING (symbol)
UNION ALL SELECT 'constant_pred_ok', 0, 0, 0
UNION ALL SELECT 'perfect_pred_ok', 0, 0, 0
UNION ALL SELECT 'shuffled_ic_ok', avg(ic), -0.0699999999, 0.0699999999 FROM sic)"""


@query("sanity_suite", rounded(
    """SELECT name AS "check", value, value BETWEEN low AND high AS passed,
       name IN ('embargo_ok', 'shuffled_ic_ok', 'perfect_pred_ok', 'missing_values') AS critical FROM found""",
    '"check", passed, critical', "value", with_=SANITY))
def sanity_suite(spark, d):
    audit = splits.embargo_audit(splits.walk_forward_folds(panels.prices(spark, d), **WF_ARGS))
    return round6(checks.sanity_suite(_f(spark, d), audit, X), "value")


HEALTH = FORECASTS + ", long_rows AS (" + " UNION ALL ".join(
    f"SELECT symbol, date, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, y_true FROM forecasts WHERE {c} IS NOT NULL" for c in ("y_pred", "f1", "f2")) \
    + "), " + spearman_cte("long_rows", "symbol, feature", "hic", "x", "y_true") + """,
lagged AS (SELECT *, lag(x) OVER (PARTITION BY symbol, feature ORDER BY date) AS x1, avg(x) OVER (PARTITION BY symbol, feature) AS m FROM long_rows),
health AS (SELECT symbol, feature, sum((x - m) * (x1 - m)) / sum((x - m) * (x - m)) AS acf_1,
    regr_slope(x - x1, x1) / sqrt((1 - corr(x - x1, x1) ** 2) * regr_syy(x - x1, x1) / ((count(x1) - 2) * regr_sxx(x - x1, x1))) AS df_t
  FROM lagged GROUP BY symbol, feature)"""


@query("feature_health", rounded(
    """SELECT symbol, feature, df_t, acf_1, ic, CASE WHEN df_t < -2.86 AND acf_1 <= 0.95 AND abs(ic) >= 0.01 THEN 'PASS' ELSE 'FAIL: ' || concat_ws(',',
        CASE WHEN df_t < -2.86 THEN NULL ELSE 'Non-Stat' END, CASE WHEN acf_1 > 0.95 THEN 'RandomWalk' END, CASE WHEN abs(ic) < 0.01 THEN 'NoSignal' END) END AS verdict
       FROM health JOIN hic USING (symbol, feature)""", "symbol, feature, verdict", "df_t, acf_1, ic", with_=HEALTH))
def feature_health(spark, d):
    return round6(checks.feature_health(_f(spark, d), ["y_pred", "f1", "f2"], "y_true"), "df_t", "acf_1", "ic")


@query("extreme_targets", rounded(
    """SELECT fold_id, count(*) FILTER (y_true > 0) AS positive, count(*) FILTER (y_true < 0) AS negative, min(y_true) AS min_target,
       max(y_true) AS max_target, count(*) FILTER (abs(y_true) > 0.2) AS extreme FROM forecasts GROUP BY fold_id""",
    "fold_id, positive, negative, extreme", "min_target, max_target", with_=FORECASTS))
def extreme_targets(spark, d):
    return round6(checks.extreme_targets(_f(spark, d), limit=0.2, by=["fold_id"]), "min_target", "max_target")


#: every feature and the target
DESCRIBED = ["y_true", "y_pred", "ret", "f1", "f2", "regime"]
QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def bin_sql(k: int) -> str:
    """Finite values in the k-th of ten bins, closed on the right; the first one holds the smallest value too."""
    above = "x >= lo" if k == 0 else f"x > lo + {k} * ((hi - lo) / 10)"
    return f"count(*) FILTER ({above} AND x <= {'hi' if k == 9 else f'lo + {k + 1} * ((hi - lo) / 10)'}) AS bin_{k}"


@query("value_anomalies", rounded(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS n_values, count(DISTINCT {c}) AS distinct_values, count(*) FILTER (isinf(x)) AS infinite, avg({c}) AS mean,
        stddev_samp({c}) AS std, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, count(DISTINCT {c}) < 10 AS few_values,
        {", ".join(f"quantile_cont({c}, {p}) AS {n}" for n, p in QUARTILES.items())}, {", ".join(map(bin_sql, range(10)))}
        FROM (SELECT {c}, CAST({c} AS DOUBLE) AS x FROM forecasts),
          (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT CAST({c} AS DOUBLE) AS x FROM forecasts) WHERE isfinite(x))""" for c in DESCRIBED),
    "column_name, n_values, distinct_values, infinite, few_values, " + ", ".join(f"bin_{k}" for k in range(10)),
    "mean, std, min_value, max_value, p25, median, p75", with_=FORECASTS))
def value_anomalies(spark, d):
    return round6(checks.value_anomalies(_f(spark, d), DESCRIBED), "mean", "std", "min_value", "max_value", "p25", "median", "p75")


AX = ["y_true", "f2", "regime"]


@query("value_histogram", f"WITH {FORECASTS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(least(floor(({c} - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin, count(*) AS count
        FROM forecasts, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM forecasts) GROUP BY 2""" for c in AX))
def value_histogram(spark, d):
    return checks.value_histogram(_f(spark, d), AX)


LIMITS = [("y_true", -1.0, 1.0, -0.1, 0.1), ("f1", -1.0, 1.0, -0.05, 0.05), ("f2", -1.0, 10.0, -0.2, 0.2)]


@query("range_check", rounded(
    "SELECT *, min_value >= min_ok AND max_value <= max_ok AND mean BETWEEN lo AND hi AS passed FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, avg({c}) AS mean, min({c}) AS min_value, max({c}) AS max_value, stddev_samp({c}) AS std,"
        f" {a} AS min_ok, {b} AS max_ok, {lo} AS lo, {hi} AS hi FROM forecasts" for c, a, b, lo, hi in LIMITS) + ")",
    "column_name, passed", "mean, min_value, max_value, std", with_=FORECASTS))
def range_check(spark, d):
    expected = spark.createDataFrame(LIMITS, "column_name string, min_ok double, max_ok double, mean_low double, mean_high double")
    return round6(checks.range_check(_f(spark, d), expected, [r[0] for r in LIMITS]), "mean", "min_value", "max_value", "std")


# --- streaming --------------------------------------------------------------


def _folder(spark) -> str:
    """A new folder below the shared checkpoint folder, local in tests only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix="stream-")
    return f"{shared.rstrip('/')}/stream-{spark.sql('SELECT uuid()').first()[0]}"


@query("stream_upsert", f"WITH {ARRIVALS} SELECT symbol, date, arg_max(value, ingest_seq) AS value FROM arrivals GROUP BY symbol, date")
def stream_upsert(spark, d):
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP"
    arriving = spark.readStream.schema(schema).parquet(f"{d}/orders*.parquet").select(
        (F.col("o_custkey") % 10).cast("string").alias("symbol"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ingest_seq"))
    folder = _folder(spark)
    refresh.stream_upsert(arriving, f"{folder}/store", f"{folder}/progress", seq="ingest_seq").awaitTermination()
    return spark.read.parquet(f"{folder}/store").drop("month", "ingest_seq")


def _features(df):
    s = Series()
    out = rolling.trailing_return(df, 21, out="r21").withColumn("ma10", s.mean("close", 10))
    return out.select("symbol", "date", "r21", "ma10", *[c for c in df.columns if c == "first_date"])


DAILY = """daily AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close
  FROM orders GROUP BY 1, 2)"""


@query("stream_feature_refresh", rounded(
    f"SELECT symbol, date, close / lag(close, 21) OVER w - 1 AS r21, {gated('avg', 'close', 10)} AS ma10 FROM daily WINDOW {W}, {frame(10)}",
    "symbol, date", "r21, ma10", with_=DAILY))
def stream_feature_refresh(spark, d):
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP"
    arriving = spark.readStream.schema(schema).parquet(f"{d}/orders*.parquet").select(
        (F.col("o_custkey") % 10).cast("string").alias("symbol"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("ingest_seq"))
    folder = _folder(spark)
    refresh.stream_feature_refresh(
        arriving, f"{folder}/prices", f"{folder}/features", f"{folder}/progress", _features, 22,
        seq="ingest_seq").awaitTermination()
    return round6(spark.read.parquet(f"{folder}/features").drop("month"), "r21", "ma10")
