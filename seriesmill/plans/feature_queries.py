"""Queries of rolling features, rehab transforms, targets and datasets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seriesmill.functions.columns import Series, round6
from seriesmill.operators import alignment, garch, rehab, rolling, targets
from seriesmill.plans import panels
from seriesmill.plans.registry import query
from seriesmill.plans.sqltext import BRANDS, CALENDAR, MACRO, MARKET, PRICES, W, frame, gated, rounded

SERIES = Series()
ROOT = repr(math.sqrt(252))


def pct(column: str, n: int) -> str:
    return f"{column} / nullif(lag({column}, {n}) OVER w, 0) - 1"


def on_prices(select: str, *frames: int, values: str, source: str = "prices", with_: str = PRICES) -> str:
    windows = ", ".join([W, *[frame(n) for n in frames]])
    return rounded(f"SELECT symbol, date, {select} FROM {source} WINDOW {windows}",
                   "symbol, date", values, with_=with_)


def _out(df, *columns):
    return round6(df.select("symbol", "date", *columns), *columns)


RETURNS = PRICES + """, returns AS (
  SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM prices)"""


@query("dist_from_200ma", on_prices(
    f"close / {gated('avg', 'close', 200)} - 1 AS d, (close - {gated('avg', 'close', 200)}) / {gated('avg', 'close', 200)} AS m",
    200, values="d, m"))
def dist_from_200ma(spark, d):
    df = rolling.dist_from_ma(panels.prices(spark, d), out="d")
    return _out(rolling.sma_deviation(df, "close", 200, out="m"), "d", "m")


@query("trend_200ma_slope", rounded(
    f"SELECT symbol, date, {pct('ma', 20)} AS slope FROM"
    f" (SELECT symbol, date, {gated('avg', 'close', 200)} AS ma FROM prices WINDOW {frame(200)}) WINDOW {W}",
    "symbol, date", "slope", with_=PRICES))
def trend_200ma_slope(spark, d):
    return _out(rolling.ma_slope(panels.prices(spark, d), out="slope"), "slope")


STEPS = PRICES + f""", steps AS (
  SELECT *, abs(close - lag(close) OVER w) AS step, abs(close - lag(close, 21) OVER w) AS net FROM prices WINDOW {W})"""


@query("trend_efficiency", on_prices(
    f"CASE WHEN count(step) OVER w21 = 21 THEN least(greatest(net / nullif(sum(step) OVER w21, 0), 0), 1) END AS e", 21,
    values="e", source="steps", with_=STEPS))
def trend_efficiency(spark, d):
    return _out(rolling.trend_efficiency(panels.prices(spark, d), out="e"), "e")


@query("trailing_return", on_prices(
    ", ".join(f"{pct('close', n)} AS r{n}" for n in (21, 63, 126, 252)), values="r21, r63, r126, r252"))
def trailing_return(spark, d):
    df = panels.prices(spark, d)
    for n in (21, 63, 126, 252):
        df = rolling.trailing_return(df, n, out=f"r{n}")
    return _out(df, "r21", "r63", "r126", "r252")


@query("rolling_slope", rounded(
    "SELECT symbol, date, " + ", ".join(
        f"CASE WHEN count(*) OVER w{n} = {n} THEN regr_slope(close, t) OVER w{n} END AS s{n}" for n in (50, 100))
    + f" FROM (SELECT *, row_number() OVER w AS t FROM prices WINDOW {W}) WINDOW {frame(50)}, {frame(100)}",
    "symbol, date", "s50, s100", digits=4, with_=PRICES))
def rolling_slope(spark, d):
    df = rolling.rolling_slope(panels.prices(spark, d), 50, out="s50")
    df = rolling.rolling_slope(df, 100, out="s100").select("symbol", "date", "s50", "s100")
    return round6(df, "s50", "s100", digits=4)


def _hurst_sql() -> str:
    lags = range(2, 20)
    x = {k: math.log(k) for k in lags}
    mean = sum(x.values()) / len(x)
    spread = sum((v - mean) ** 2 for v in x.values())
    diffs = ", ".join(f"close - lag(close, {k}) OVER w AS d{k}" for k in lags)
    var = ", ".join(
        f"CASE WHEN count(d{k}) OVER v{k} = {100 - k} THEN var_pop(d{k}) OVER v{k} END AS v{k}" for k in lags)
    windows = ", ".join(frame(100 - k, f"v{k}") for k in lags)
    slope = " + ".join(f"ln(nullif(v{k}, 0)) * {(x[k] - mean) / spread!r}" for k in lags)
    return rounded(
        f"SELECT symbol, date, CASE WHEN v2 IS NOT NULL THEN least(greatest(({slope}) / 2, 0), 1) END AS hurst FROM ("
        f"SELECT symbol, date, {var} FROM (SELECT *, {diffs} FROM prices WINDOW {W}) WINDOW {windows})",
        "symbol, date", "hurst", with_=PRICES)


@query("rolling_hurst", _hurst_sql())
def rolling_hurst(spark, d):
    return _out(rolling.rolling_hurst(panels.prices(spark, d), out="hurst"), "hurst")


@query("rolling_apply", on_prices(
    f"({gated('max', 'close', 20)} - {gated('min', 'close', 20)}) / close AS span", 20, values="span"))
def rolling_apply(spark, d):
    df = rolling.rolling_apply(
        panels.prices(spark, d), "close", 20,
        lambda w: (F.array_max(w) - F.array_min(w)) / F.element_at(w, -1), "span")
    return _out(df, "span")


@query("rv_ratio", on_prices(
    f"{gated('stddev_samp', 'ret', 5)} / nullif({gated('stddev_samp', 'ret', 20)}, 0) AS rv", 5, 20,
    values="rv", source="returns", with_=RETURNS))
def rv_ratio(spark, d):
    return _out(rolling.rv_ratio(rolling.daily_return(panels.prices(spark, d)), "ret", out="rv"), "rv")


@query("garch_variance")
def garch_variance(spark, d):
    df = rolling.daily_return(panels.prices(spark, d))
    return round6(garch.garch_variance(df), "GARCH_Forecast")


@query("volume_roc", on_prices(f"{pct('volume', 5)} AS roc", values="roc"))
def volume_roc(spark, d):
    return _out(rolling.volume_roc(panels.prices(spark, d), out="roc"), "roc")


BREADTH = BRANDS + f""", above AS (
  SELECT symbol, date, close, {gated('avg', 'close', 50)} AS ma FROM brand_prices WINDOW {frame(50)}),
breadth AS (
  SELECT date, 100.0 * count(*) FILTER (close > ma) / (SELECT count(DISTINCT symbol) FROM brand_prices) AS breadth,
         100.0 * count(*) FILTER (close > ma) / nullif(count(ma), 0) AS breadth_available
  FROM above GROUP BY date)"""


@query("breadth_above_sma", rounded("SELECT * FROM breadth", "date", "breadth, breadth_available", with_=BREADTH))
def breadth_above_sma(spark, d):
    p = panels.brand_prices(spark, d)
    available = rolling.breadth_above_sma(p, available_only=True, out="breadth_available")
    return round6(rolling.breadth_above_sma(p).join(available, "date"), "breadth", "breadth_available")


@query("price_ratio", rounded("SELECT date, hyg / shy AS spread FROM market", "date", "spread", with_=MARKET))
def price_ratio(spark, d):
    return round6(rolling.price_ratio(panels.market(spark, d), "hyg", "shy", "spread").select("date", "spread"), "spread")


@query("sma_diff", rounded(
    f"SELECT symbol, date, ma - lag(ma) OVER w AS trend FROM"
    f" (SELECT symbol, date, {gated('avg', 'close', 50)} AS ma FROM prices WINDOW {frame(50)}) WINDOW {W}",
    "symbol, date", "trend", with_=PRICES))
def sma_diff(spark, d):
    return _out(rolling.sma_diff(panels.prices(spark, d), "close", out="trend"), "trend")


@query("sma_deviation", on_prices(
    f"(close - {gated('avg', 'close', 50)}) / {gated('avg', 'close', 50)} AS dev", 50, values="dev"))
def sma_deviation(spark, d):
    return _out(rolling.sma_deviation(panels.prices(spark, d), "close", out="dev"), "dev")


@query("level_diff", on_prices("close - lag(close, 63) OVER w AS change", values="change"))
def level_diff(spark, d):
    return _out(rolling.level_diff(panels.prices(spark, d), "close", out="change"), "change")


MONTHLY_PMI = f"""{CALENDAR}, {MACRO}, days AS (
  SELECT 'PMI' AS symbol, calendar.date, value FROM calendar LEFT JOIN macro USING (date))"""


@query("macro_ffill", f"""WITH {MONTHLY_PMI} SELECT symbol, date,
  last_value(value IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS pmi FROM days""")
def macro_ffill(spark, d):
    days = alignment.calendar_align(panels.macro_monthly(spark, d), panels.calendar(spark, d), ["value"])
    return rolling.macro_ffill(days, "value", out="pmi").select("symbol", "date", "pmi")


@query("rolling_zscore", on_prices(
    f"(close - {gated('avg', 'close', 252, 126)}) / nullif({gated('stddev_samp', 'close', 252, 126)}, 0) AS z",
    252, values="z"))
def rolling_zscore(spark, d):
    return _out(rolling.rolling_zscore(panels.prices(spark, d), "close", out="z"), "z")


@query("implied_realized_gap", rounded(
    f"SELECT symbol, date, vix / 100.0 - {gated('stddev_samp', 'ret', 20)} * {ROOT} AS gap"
    f" FROM returns JOIN market USING (date) WINDOW w20 AS (PARTITION BY returns.symbol ORDER BY date ROWS 19 PRECEDING)"
    .replace("SELECT symbol,", "SELECT returns.symbol AS symbol,"),
    "symbol, date", "gap", with_=RETURNS + ", " + MARKET))
def implied_realized_gap(spark, d):
    vix = panels.market(spark, d).select("date", "vix")
    df = rolling.daily_return(panels.prices(spark, d)).join(vix, "date")
    return _out(rolling.implied_realized_gap(df, "vix", "ret", out="gap"), "gap")


@query("daily_return", on_prices(f"{pct('close', 1)} AS ret", values="ret"))
def daily_return(spark, d):
    return _out(rolling.daily_return(panels.prices(spark, d)), "ret")


# --- the whole feature table ------------------------------------------------

MARKET_FULL = f"""{MARKET}, {MACRO}, kept AS (SELECT macro.date, value FROM macro WHERE date IN (SELECT date FROM market)),
known AS (
  SELECT m.*, k.value AS pmi, k.value AS umich FROM market m ASOF LEFT JOIN kept k ON m.date >= k.date),
market_features AS (
  SELECT date, hyg / shy AS "HY_Spread", dxy_ma - lag(dxy_ma) OVER w AS "USD_Trend",
         (oil - oil_ma) / oil_ma AS "Oil_Deviation", t10y2y - lag(t10y2y, 63) OVER w AS "Yield_Curve",
         pmi AS "ISM_PMI", z AS "UMich_Sentiment", cpc AS "Put_Call_Ratio", vix, "QC_cpc_missing"
  FROM (SELECT *, {gated('avg', 'dxy', 50)} AS dxy_ma, {gated('avg', 'oil', 50)} AS oil_ma,
               (umich - {gated('avg', 'umich', 252, 126)}) / nullif({gated('stddev_samp', 'umich', 252, 126)}, 0) AS z,
               CAST(cpc IS NULL AS INTEGER) AS "QC_cpc_missing"
        FROM known WINDOW {frame(50)}, {frame(252)}) WINDOW {W})"""

TREND = [f"{pct('close', n)} AS {c}" for n, c in
         ((21, '"Return_1M"'), (63, '"Return_3M"'), (126, '"Return_6M"'), (252, '"Return_12M"'))]


def feature_sql(source: str, panel_cte: str) -> str:
    lags = range(2, 20)
    x = {k: math.log(k) for k in lags}
    mean = sum(x.values()) / len(x)
    spread = sum((v - mean) ** 2 for v in x.values())
    diffs = ", ".join(f"close - lag(close, {k}) OVER w AS d{k}" for k in lags)
    var = ", ".join(
        f"CASE WHEN count(d{k}) OVER v{k} = {100 - k} THEN var_pop(d{k}) OVER v{k} END AS v{k}" for k in lags)
    windows = ", ".join(frame(100 - k, f"v{k}") for k in lags)
    slope = " + ".join(f"ln(nullif(v{k}, 0)) * {(x[k] - mean) / spread!r}" for k in lags)
    return f"""{panel_cte}, {MARKET_FULL}, {BREADTH},
stepped AS (
  SELECT *, close / lag(close) OVER w - 1 AS ret, abs(close - lag(close) OVER w) AS step,
         row_number() OVER w AS t, {diffs} FROM {source} WINDOW {W}),
own AS (
  SELECT symbol, date, close, ma200, (close - ma200) / ma200 AS "MA_Dist_200", close / ma200 - 1 AS "Dist_from_200MA",
         {pct('ma200', 20)} AS "Trend_200MA_Slope",
         CASE WHEN path IS NOT NULL THEN
           least(greatest(abs(close - lag(close, 21) OVER w) / nullif(path, 0), 0), 1) END AS "Trend_Efficiency",
         {", ".join(TREND)}, s50 AS "Slope_50", s100 AS "Slope_100",
         CASE WHEN v2 IS NOT NULL THEN least(greatest(({slope}) / 2, 0), 1) END AS "Hurst",
         std5 / nullif(std20, 0) AS "RV_Ratio", {pct('volume', 5)} AS "Vol_ROC", std20 * {ROOT} AS rv,
         (lead(close, 21) OVER w - close) / close AS "Target_1M", ln(lead(close, 21) OVER w / close) AS "Log_Target_1M"
  FROM (SELECT *, {gated('avg', 'close', 200)} AS ma200, {gated('sum', 'step', 21)} AS path,
               {gated('stddev_samp', 'ret', 5)} AS std5, {gated('stddev_samp', 'ret', 20)} AS std20,
               CASE WHEN count(*) OVER w50 = 50 THEN regr_slope(close, t) OVER w50 END AS s50,
               CASE WHEN count(*) OVER w100 = 100 THEN regr_slope(close, t) OVER w100 END AS s100, {var}
        FROM stepped WINDOW {frame(5)}, {frame(20)}, {frame(21)}, {frame(50)}, {frame(100)}, {frame(200)}, {windows})
  WINDOW {W}),
features AS (
  SELECT symbol, date, close AS "Price", "MA_Dist_200", "Dist_from_200MA", "Trend_200MA_Slope", "Return_1M",
         "Return_3M", "Return_6M", "Return_12M", "RV_Ratio", "Vol_ROC", "Target_1M", "Log_Target_1M",
         "Trend_Efficiency", "Slope_50", "Slope_100", "Hurst", "HY_Spread", "USD_Trend", "Oil_Deviation",
         "Yield_Curve", "ISM_PMI", "UMich_Sentiment", "QC_cpc_missing", "Put_Call_Ratio",
         vix / 100.0 - rv AS "Imp_Real_Gap", breadth AS "Sectors_Above_50MA"
  FROM own LEFT JOIN market_features USING (date) LEFT JOIN breadth USING (date) WHERE "Target_1M" IS NOT NULL)"""


FEATURES = ["MA_Dist_200", "Dist_from_200MA", "Trend_200MA_Slope", "Return_1M", "Return_3M", "Return_6M",
            "Return_12M", "RV_Ratio", "Vol_ROC", "Target_1M", "Log_Target_1M", "Trend_Efficiency", "Slope_50",
            "Slope_100", "Hurst", "HY_Spread", "USD_Trend", "Oil_Deviation", "Yield_Curve", "ISM_PMI",
            "UMich_Sentiment", "Put_Call_Ratio", "Imp_Real_Gap", "Sectors_Above_50MA"]
QUOTED = ", ".join(f'"{c}"' for c in FEATURES)


def market_with_macro(spark, d):
    market = panels.market(spark, d)
    pmi = alignment.asof_release(market, panels.macro_monthly(spark, d), out="pmi")
    return alignment.missing_flags(market.join(pmi, "date"), ["cpc"]).withColumn("umich", F.col("pmi"))


def features_of(spark, d, panel):
    return rolling.feature_table(
        panel, market_with_macro(spark, d), qc=("QC_cpc_missing",),
        breadth=rolling.breadth_above_sma(panels.brand_prices(spark, d)))


@query("feature_table", rounded(
    f"SELECT * FROM features WHERE date >= DATE '1996-01-01'", 'symbol, date, "Price", "QC_cpc_missing"', QUOTED,
    digits=4, with_=feature_sql("prices", PRICES)))
def feature_table(spark, d):
    df = alignment.date_slice(features_of(spark, d, panels.prices(spark, d)), "1996-01-01")
    return round6(df, *FEATURES, digits=4)


# --- rehab ------------------------------------------------------------------
# one long series per return flag, so that a year of z-scores of a year's
# returns has enough history

LONG = """long_prices AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS close,
         sum(l_quantity) AS volume
  FROM lineitem WHERE isodow(l_shipdate) < 6 GROUP BY 1, 2)"""
LONG_FEATURES = feature_sql("long_prices", LONG)


def long_prices(spark, d):
    lines = panels.table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double")
    return alignment.drop_weekends(lines).groupBy(F.col("l_returnflag").alias("symbol"), "date").agg(
        (cents / (F.count("*") * 100.0)).alias("close"), F.sum("l_quantity").alias("volume"))


def long_features(spark, d):
    return features_of(spark, d, long_prices(spark, d))


def rehab_step(select: str, values: str, *frames: int) -> str:
    windows = ", ".join([W, *[frame(n) for n in frames]])
    return rounded(f"SELECT symbol, date, {select} FROM features WINDOW {windows}", "symbol, date", values,
                   digits=4, with_=LONG_FEATURES)


def _rehab_out(df, *columns):
    return round6(df.select("symbol", "date", *columns), *columns, digits=4)


def diff(c: str, new: str, n: int = 21) -> str:
    return f'"{c}" - lag("{c}", {n}) OVER w AS "{new}"'


DIFFS = ", ".join(diff(a, b) for a, b in rehab.DIFF_COLUMNS.items())
DIFF_NAMES = list(rehab.DIFF_COLUMNS.values())


@query("diff21", rehab_step(DIFFS, ", ".join(f'"{c}"' for c in DIFF_NAMES)))
def diff21(spark, d):
    return _rehab_out(rehab.diff21(long_features(spark, d)), *DIFF_NAMES)


@query("pct21", on_prices(f"{pct('volume', 21)} AS chg", values="chg"))
def pct21(spark, d):
    return _out(rehab.pct21(panels.prices(spark, d), "volume", "chg"), "chg")


def zscore(c: str) -> str:
    return (f'("{c}" - {gated("avg", chr(34) + c + chr(34), 252)}) / '
            f'({gated("stddev_samp", chr(34) + c + chr(34), 252)} + 1e-8) AS "{c}_Z"')


Z = [f"{c}_Z" for c in rehab.RETURN_COLUMNS]


@query("return_zscore", rehab_step(", ".join(zscore(c) for c in rehab.RETURN_COLUMNS), ", ".join(f'"{c}"' for c in Z), 252))
def return_zscore(spark, d):
    return _rehab_out(rehab.return_zscore(long_features(spark, d)), *Z)


@query("month_cyclic", rounded(
    'SELECT symbol, date, sin(2 * pi() * month(date) / 12) AS "Month_Sin", cos(2 * pi() * month(date) / 12) AS "Month_Cos" FROM prices',
    "symbol, date", '"Month_Sin", "Month_Cos"', with_=PRICES))
def month_cyclic(spark, d):
    return _out(rehab.month_cyclic(panels.prices(spark, d)), "Month_Sin", "Month_Cos")


@query("month_of_year", f'WITH {PRICES} SELECT symbol, date, CAST(month(date) AS INTEGER) AS "Month_of_Year" FROM prices')
def month_of_year(spark, d):
    return rehab.month_of_year(panels.prices(spark, d)).select("symbol", "date", "Month_of_Year")


@query("breadth_thrust", on_prices('volume - lag(volume, 5) OVER w AS "Breadth_Thrust"', values='"Breadth_Thrust"'))
def breadth_thrust(spark, d):
    return _out(rehab.breadth_thrust(panels.prices(spark, d), "volume"), "Breadth_Thrust")


@query("breadth_regime", f"""WITH {BREADTH} SELECT date, CASE WHEN breadth > 0.5 THEN 1 ELSE 0 END AS "Breadth_Regime",
  CASE WHEN breadth > 50 THEN 1 ELSE 0 END AS majority FROM breadth""")
def breadth_regime(spark, d):
    df = rolling.breadth_above_sma(panels.brand_prices(spark, d), out="Sectors_Above_50MA")
    half = rehab.breadth_regime(df, threshold=50).withColumnRenamed("Breadth_Regime", "majority")
    return rehab.breadth_regime(half).select("date", "Breadth_Regime", "majority")


@query("interactions", rehab_step(
    '"Imp_Real_Gap" * "Return_1M" AS "Vol_Trend_Interact",'
    ' ("Sectors_Above_50MA" - lag("Sectors_Above_50MA", 5) OVER w) * "Imp_Real_Gap" AS "Breadth_Vol_Interact"',
    '"Vol_Trend_Interact", "Breadth_Vol_Interact"'))
def interactions(spark, d):
    df = rehab.interactions(rehab.breadth_thrust(long_features(spark, d)))
    return _rehab_out(df, "Vol_Trend_Interact", "Breadth_Vol_Interact")


KEPT = ["MA_Dist_200", "Dist_from_200MA", "Trend_200MA_Slope", "Return_1M", "Vol_ROC", "Target_1M",
        "Trend_Efficiency", "Slope_50", "Slope_100", "Hurst", "ISM_PMI", "Imp_Real_Gap", "Sectors_Above_50MA"]
REHAB_INNER = ", ".join(['"Price"', *[f'"{c}"' for c in KEPT], '"QC_cpc_missing"', DIFFS,
                         '"UMich_Sentiment" / nullif(lag("UMich_Sentiment", 21) OVER w, 0) - 1 AS "UMich_Sentiment_Chg"',
                         '"Sectors_Above_50MA" - lag("Sectors_Above_50MA", 5) OVER w AS "Breadth_Thrust"',
                         'CASE WHEN "Sectors_Above_50MA" > 0.5 THEN 1 ELSE 0 END AS "Breadth_Regime"',
                         '"Imp_Real_Gap" * "Return_1M" AS "Vol_Trend_Interact"',
                         *[zscore(c) for c in rehab.RETURN_COLUMNS]])
REHAB_COMMON = [*KEPT, *DIFF_NAMES, "UMich_Sentiment_Chg", "Breadth_Thrust", "Vol_Trend_Interact", "Breadth_Vol_Interact"]
REHAB_CTE = LONG_FEATURES + f""", rehab_all AS (
  SELECT *, "Breadth_Thrust" * "Imp_Real_Gap" AS "Breadth_Vol_Interact",
         sin(2 * pi() * month(date) / 12) AS "Month_Sin", cos(2 * pi() * month(date) / 12) AS "Month_Cos",
         CAST(month(date) AS INTEGER) AS "Month_of_Year"
  FROM (SELECT symbol, date, {REHAB_INNER} FROM features WINDOW {W}, {frame(252)})),
rehab AS (SELECT * EXCLUDE ("Month_of_Year") FROM rehab_all WHERE {" AND ".join(f'"{c}" IS NOT NULL' for c in [*REHAB_COMMON, *Z])}),
legacy AS (SELECT * EXCLUDE ("Month_Sin", "Month_Cos", {", ".join(f'"{c}"' for c in Z)}) FROM rehab_all
  WHERE {" AND ".join(f'"{c}" IS NOT NULL' for c in REHAB_COMMON)})"""
REHAB_VALUES = [*REHAB_COMMON, *Z, "Month_Sin", "Month_Cos"]


@query("rehab_features", rounded(
    "SELECT * FROM rehab", 'symbol, date, "Price", "QC_cpc_missing", "Breadth_Regime"', ", ".join(f'"{c}"' for c in REHAB_VALUES),
    digits=4, with_=REHAB_CTE))
def rehab_features(spark, d):
    return round6(rehab.rehab_features(long_features(spark, d)), *REHAB_VALUES, digits=4)


@query("rehab_legacy", rounded(
    "SELECT * FROM legacy", 'symbol, date, "Price", "QC_cpc_missing", "Breadth_Regime", "Month_of_Year"',
    ", ".join(f'"{c}"' for c in REHAB_COMMON), digits=4, with_=REHAB_CTE))
def rehab_legacy(spark, d):
    return round6(rehab.rehab_features(long_features(spark, d), legacy=True), *REHAB_COMMON, digits=4)


@query("zscore126_detrend20", on_prices(
    f"(close - {gated('avg', 'close', 126)}) / ({gated('stddev_samp', 'close', 126)} + 1e-8) AS z,"
    f" volume / ({gated('avg', 'volume', 20)} + 1e-8) AS detrended", 126, 20, values="z, detrended"))
def zscore126_detrend20(spark, d):
    df = rehab.zscore126_detrend20(panels.prices(spark, d), "close", "volume")
    return _out(df.withColumnsRenamed({"close_Z": "z", "PCR_Detrend": "detrended"}), "z", "detrended")


# --- targets ----------------------------------------------------------------


@query("forward_return", rounded(
    f"SELECT * FROM (SELECT symbol, date, (lead(close, 21) OVER w - close) / close AS y FROM prices WINDOW {W}) WHERE y IS NOT NULL",
    "symbol, date", "y", with_=PRICES))
def forward_return(spark, d):
    return _out(targets.forward_return(panels.prices(spark, d), out="y"), "y")


@query("log_forward_return", on_prices("ln(lead(close, 21) OVER w / close) AS y", values="y"))
def log_forward_return(spark, d):
    return _out(targets.log_forward_return(panels.prices(spark, d), out="y"), "y")


@query("target_from_trailing", rounded(
    f"SELECT symbol, date, lead(r, 21) OVER w AS y FROM (SELECT symbol, date, {pct('close', 21)} AS r FROM prices WINDOW {W}) WINDOW {W}",
    "symbol, date", "y", with_=PRICES))
def target_from_trailing(spark, d):
    df = rolling.trailing_return(panels.prices(spark, d), 21, out="Return_1M")
    return _out(targets.target_from_trailing(df, out="y"), "y")


MONTH_ENDS = PRICES + """, ends AS (
  SELECT symbol, last_day(date) AS date, arg_max(close, date) AS close FROM prices GROUP BY 1, 2)"""


@query("next_month_return_monthly", rounded(
    f"SELECT * FROM (SELECT symbol, date, (lead(close) OVER w - close) / close AS y FROM ends WINDOW {W}) WHERE y IS NOT NULL",
    "symbol, date", "y", with_=MONTH_ENDS))
def next_month_return_monthly(spark, d):
    ends = alignment.month_end_sample(panels.prices(spark, d), ["volume"], "close")
    return _out(targets.next_month_return_monthly(ends, out="y"), "y")


@query("next_month_return_daily", rounded(
    """SELECT p.symbol, p.date, (e.close - p.close) / p.close AS y FROM prices p JOIN ends e ON e.symbol = p.symbol
       AND e.date = CASE WHEN p.date = last_day(p.date) THEN last_day(p.date + INTERVAL 1 DAY) ELSE last_day(p.date) END""",
    "symbol, date", "y", with_=MONTH_ENDS))
def next_month_return_daily(spark, d):
    return _out(targets.next_month_return_daily(panels.prices(spark, d), out="y"), "y")


LABELLED = PRICES + f""", labelled AS (
  SELECT symbol, date, close, volume, y, CASE WHEN abs(y) > 0.3 THEN 1 ELSE 0 END AS "BigMove",
         CASE WHEN y > 0.3 THEN 1 ELSE 0 END AS "BigMoveUp", CASE WHEN y < -0.3 THEN 1 ELSE 0 END AS "BigMoveDown"
  FROM (SELECT *, (lead(close, 21) OVER w - close) / close AS y FROM prices WINDOW {W}) WHERE y IS NOT NULL)"""


def labelled(spark, d):
    df = targets.forward_return(panels.prices(spark, d), out="y")
    return targets.big_move_labels(df, "y", 0.3)


@query("big_move_labels", rounded("SELECT * FROM labelled", 'symbol, date, "BigMove", "BigMoveUp", "BigMoveDown"', "y", with_=LABELLED))
def big_move_labels(spark, d):
    return round6(labelled(spark, d).drop("close", "volume"), "y")


SUMMARY = """count(*) AS n_rows, min(date) AS start_date, max(date) AS end_date, CAST({n} AS INTEGER) AS n_features,
  CAST(21 AS INTEGER) AS embargo_rows, CAST(sum("BigMove") AS BIGINT) AS n_big, CAST(sum("BigMoveUp") AS BIGINT) AS n_up,
  CAST(sum("BigMoveDown") AS BIGINT) AS n_down, 100.0 * sum("BigMove") / count(*) AS pct_big"""


@query("dataset_summary", rounded(
    f"SELECT {SUMMARY.format(n=2)} FROM labelled",
    "n_rows, start_date, end_date, n_features, embargo_rows, n_big, n_up, n_down", "pct_big", with_=LABELLED))
def dataset_summary(spark, d):
    return round6(targets.dataset_summary(labelled(spark, d), 2), "pct_big")


DATASET_KEPT = [c for c in REHAB_VALUES if c not in ("MA_Dist_200", "Target_1M")]


@query("build_dataset", rounded(
    f"""SELECT * EXCLUDE ("Target_1M"), y AS "Target_1M", CASE WHEN abs(y) > 0.1 THEN 1 ELSE 0 END AS "BigMove",
          CASE WHEN y > 0.1 THEN 1 ELSE 0 END AS "BigMoveUp", CASE WHEN y < -0.1 THEN 1 ELSE 0 END AS "BigMoveDown"
        FROM (SELECT *, (lead("Price", 21) OVER w - "Price") / "Price" AS y FROM rehab WINDOW {W}) WHERE y IS NOT NULL""",
    'symbol, date, "QC_cpc_missing", "Breadth_Regime", "BigMove", "BigMoveUp", "BigMoveDown"',
    ", ".join(f'"{c}"' for c in [*DATASET_KEPT, "Target_1M"]), digits=4, with_=REHAB_CTE))
def build_dataset(spark, d):
    df = targets.build_dataset(long_features(spark, d), threshold=0.1)
    return round6(df, *DATASET_KEPT, "Target_1M", digits=4)
