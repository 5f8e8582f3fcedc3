"""Queries of the store operators and of calendar alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions.columns import Series, round6
from seriesmill.operators import alignment, rolling
from seriesmill.plans import panels
from seriesmill.plans.registry import query
from seriesmill.plans.sqltext import (
    ARRIVALS, BRANDS, CALENDAR, FORECASTS, MACRO, MARKET, PRICES, RAW_LONG, RUNS, W, frame,
    gated, rounded,
)
from seriesmill.sources import store

SERIES = Series()
FLAGS = ("A", "N", "R")
FLAG_LONG = """flags AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, l_quantity AS value
  FROM lineitem WHERE isodow(l_shipdate) < 6)"""


def _flags(spark, d):
    lines = panels.table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    return alignment.drop_weekends(lines).select(
        F.col("l_returnflag").alias("symbol"), "date", F.col("l_quantity").alias("value")
    )


@query("read_feature_table", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice
  FROM orders""")
def read_feature_table(spark, d):
    schema = "o_orderkey BIGINT, o_orderdate TIMESTAMP, o_totalprice DOUBLE"
    df = store.read_feature_table(spark, f"{d}/orders.parquet", schema)
    return df.select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice").orderBy("date")


@query("read_since", f"WITH {PRICES} SELECT symbol, date, close FROM prices WHERE date >= DATE '1999-01-01'")
def read_since(spark, d):
    return store.read_since(panels.prices(spark, d), "1999-01-01").select("symbol", "date", "close")


@query("read_symbols", f"""WITH {RAW_LONG} SELECT symbol, date, value FROM raw_long
  WHERE symbol IN ('1_close', '3_volume', '7_close') AND date >= DATE '1998-06-01'""")
def read_symbols(spark, d):
    return store.read_symbols(panels.raw_long(spark, d), ["1_close", "3_volume", "7_close"], "1998-06-01")


@query("long_to_wide", rounded(
    'SELECT date, avg(value) FILTER (symbol = \'A\') AS "A", avg(value) FILTER (symbol = \'N\') AS "N",'
    ' avg(value) FILTER (symbol = \'R\') AS "R" FROM flags GROUP BY date',
    "date", "A, N, R", with_=FLAG_LONG))
def long_to_wide(spark, d):
    return round6(store.long_to_wide(_flags(spark, d), FLAGS), *FLAGS)


@query("wide_to_long", f"""WITH {PRICES}, shaped AS (
  SELECT symbol AS id, date, CASE WHEN volume > 100 THEN 'nan'::DOUBLE ELSE close END AS close,
         CASE WHEN volume < 5 THEN NULL ELSE volume END AS volume FROM prices)
  SELECT id || ':' || name AS symbol, date, value FROM (
    SELECT id, 'close' AS name, date, close AS value FROM shaped
    UNION ALL SELECT id, 'volume', date, volume FROM shaped)
  WHERE value IS NOT NULL AND NOT isnan(value)""")
def wide_to_long(spark, d):
    p = panels.prices(spark, d).select(
        F.struct("symbol", "date").alias("key"),
        F.when(F.col("volume") > 100, F.lit(float("nan"))).otherwise(F.col("close")).alias("close"),
        F.when(F.col("volume") >= 5, F.col("volume")).alias("volume"),
    )
    long = store.wide_to_long(p, ["close", "volume"], date="key", symbol="name")
    return long.select(F.concat_ws(":", "key.symbol", "name").alias("symbol"), "key.date", "value")


def _batches(spark, d):
    """Stored rows and a later delivery that overlaps them by a year."""
    p = panels.prices(spark, d)
    old = store.read_before(p, "2000-01-01").select("symbol", "date", "close", "volume")
    new = store.read_since(p, "1999-01-01").select(
        "symbol", "date",
        F.when(F.col("volume") >= 20, F.col("close") * 2).alias("close"),
        F.lit("late").alias("note"),
    )
    return old, new


@query("upsert_by_key", f"""WITH {PRICES},
  o AS (SELECT symbol, date, close, volume FROM prices WHERE date < DATE '2000-01-01'),
  b AS (SELECT symbol, date, CASE WHEN volume >= 20 THEN close * 2 END AS close, 'late' AS note
        FROM prices WHERE date >= DATE '1999-01-01')
  SELECT symbol, date, CASE WHEN b.note IS NOT NULL THEN b.close ELSE o.close END AS close, volume, note
  FROM o FULL JOIN b USING (symbol, date)""")
def upsert_by_key(spark, d):
    return store.upsert_by_key(*_batches(spark, d), ["symbol", "date"])


@query("high_water_mark", f"WITH {PRICES} SELECT symbol, max(date) AS last_date FROM prices GROUP BY symbol")
def high_water_mark(spark, d):
    return store.high_water_mark(panels.prices(spark, d), by=["symbol"])


def _predictions(spark, d):
    return panels.forecasts(spark, d).select(
        F.concat(F.lit("run_"), "fold_id").alias("run_id"), "symbol", "date", "y_true", "y_pred"
    )


@query("load_run", rounded("SELECT * FROM forecasts WHERE fold_id = 1999", "symbol, date", "y_true, y_pred", with_=FORECASTS))
def load_run(spark, d):
    return round6(store.load_run(_predictions(spark, d), "run_1999"), "y_true", "y_pred")


@query("load_latest_run", rounded(
    "SELECT run_id, symbol, date, y_true, y_pred FROM runs JOIN forecasts ON run_id = 'run_' || fold_id"
    " WHERE created_at = (SELECT max(created_at) FROM runs)",
    "run_id, symbol, date", "y_true, y_pred", with_=RUNS))
def load_latest_run(spark, d):
    return round6(store.load_latest_run(panels.runs(spark, d), _predictions(spark, d)), "y_true", "y_pred")


@query("first_valid_source", f"""WITH {BRANDS}
  SELECT symbol AS series, CASE WHEN length(symbol) = 7 THEN 'vendor' ELSE 'exchange' END AS source,
         date, close AS value FROM brand_prices""")
def first_valid_source(spark, d):
    p = panels.brand_prices(spark, d)
    # every series has three candidate sources; the first one is empty, the
    # second covers the brands with one-digit numbers only
    candidates = p.select(
        F.col("symbol").alias("series"),
        F.explode(F.array(F.lit("archive"), F.lit("vendor"), F.lit("exchange"))).alias("source"),
        "date", "close",
    ).select(
        "series", "source", "date",
        F.when(F.col("source") == "exchange", F.col("close"))
        .when((F.col("source") == "vendor") & (F.length("series") == 7), F.col("close"))
        .alias("value"),
    )
    return store.first_valid_source(candidates, ["archive", "vendor", "exchange"])


@query("predictions_export", rounded(
    "SELECT symbol, date, y_true, y_pred, CASE WHEN fold_id % 2 = 1 THEN 'validation' ELSE 'test' END AS type FROM forecasts",
    "symbol, date, type", "y_true, y_pred", with_=FORECASTS))
def predictions_export(spark, d):
    f = panels.forecasts(spark, d).select("symbol", "date", "fold_id", "y_true", "y_pred")
    odd = F.col("fold_id") % 2 == 1
    out = store.predictions_export(f.filter(odd).drop("fold_id"), f.filter(~odd).drop("fold_id"))
    return round6(out, "y_true", "y_pred")


@query("enrich_left_join", f"""WITH {PRICES}, o AS (
    SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS k, o_totalprice AS close, o_orderpriority AS priority FROM orders),
  f AS (SELECT date, arg_min(close, k) AS close_orders, arg_min(priority, k) AS priority FROM o GROUP BY date),
  e AS (SELECT CAST(o_orderdate AS DATE) AS date, arg_min(o_custkey, o_orderkey) AS volume_clients FROM orders GROUP BY 1)
  SELECT symbol, date, close, volume, close_orders, priority, volume_clients
  FROM prices LEFT JOIN f USING (date) LEFT JOIN e USING (date)""")
def enrich_left_join(spark, d):
    orders = panels.table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    extra = orders.select(
        "date", F.col("o_orderkey").alias("ingest_seq"), F.col("o_totalprice").alias("close"),
        F.col("o_orderpriority").alias("priority"))
    clients = orders.select("date", F.col("o_orderkey").alias("ingest_seq"), F.col("o_custkey").alias("volume"))
    return store.enrich_left_join(panels.prices(spark, d), {"orders": extra, "clients": clients})


def _refreshable(df):
    out = rolling.trailing_return(df, 21, series=SERIES)
    return out.withColumn("ma10", SERIES.mean("close", 10)).select("symbol", "date", "Return_21", "ma10")


@query("incremental_refresh", rounded(
    f"SELECT symbol, date, close / lag(close, 21) OVER w - 1 AS \"Return_21\", {gated('avg', 'close', 10)} AS ma10"
    f" FROM prices WINDOW {W}, {frame(10)}",
    "symbol, date", "Return_21, ma10", with_=PRICES))
def incremental_refresh(spark, d):
    p = panels.prices(spark, d)
    stored = _refreshable(p.filter(F.col("date") <= F.lit("2001-06-30").cast("date")))
    return round6(store.incremental_refresh(stored, p, _refreshable, 22), "Return_21", "ma10")


# --- calendar and alignment -------------------------------------------------

ALIGNED = PRICES + ", " + CALENDAR + """, aligned AS (
  SELECT s.symbol, c.date, p.close, p.volume FROM (SELECT DISTINCT symbol FROM prices) s
  CROSS JOIN calendar c LEFT JOIN prices p ON p.symbol = s.symbol AND p.date = c.date)"""


def aligned(spark, d):
    return alignment.calendar_align(panels.prices(spark, d), panels.calendar(spark, d), ["close", "volume"])


@query("calendar_align", f"WITH {ALIGNED} SELECT symbol, date, close, volume FROM aligned")
def calendar_align(spark, d):
    return aligned(spark, d)


WEEKLY = """weekly AS (
  SELECT CAST(min(o_orderdate) AS DATE) AS date, count(*)::DOUBLE AS value FROM orders
  GROUP BY date_trunc('week', o_orderdate))"""


@query("outer_join_series", f"""WITH {MACRO}, {WEEKLY}, {MARKET}
  SELECT coalesce(macro.date, weekly.date, market.date) AS date, macro.value AS pmi, weekly.value AS umich, t10y2y
  FROM macro FULL JOIN weekly ON macro.date = weekly.date
  FULL JOIN market ON market.date = coalesce(macro.date, weekly.date)""")
def outer_join_series(spark, d):
    weekly = panels.table(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").alias("w")).agg(
        F.to_date(F.min("o_orderdate")).alias("date"), F.count("*").cast("double").alias("value"))
    daily = panels.market(spark, d).select("date", F.col("t10y2y").alias("value"))
    return alignment.outer_join_series(
        {"pmi": panels.macro_monthly(spark, d), "umich": weekly, "t10y2y": daily})


CARRIED = "last_value({0} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query("ffill", f"WITH {ALIGNED} SELECT symbol, date, close, {CARRIED.format('volume')} AS volume FROM aligned")
def ffill(spark, d):
    return alignment.ffill(aligned(spark, d), ["volume"])


@query("asof_monthly", f"""WITH {PRICES}, {CALENDAR}, {MACRO},
  kept AS (SELECT macro.* FROM macro JOIN calendar USING (date)),
  days AS (SELECT c.date, m.value AS pmi, k.value AS pmi_strict FROM calendar c
    ASOF LEFT JOIN macro m ON c.date >= m.date ASOF LEFT JOIN kept k ON c.date >= k.date)
  SELECT symbol, date, close, pmi, pmi_strict FROM prices JOIN days USING (date)""")
def asof_monthly(spark, d):
    days, pmi = panels.calendar(spark, d), panels.macro_monthly(spark, d)
    strict = alignment.asof_release(days, pmi, out="pmi_strict")
    known = alignment.asof_release(days, pmi, strict=False, out="pmi")
    return panels.prices(spark, d).select("symbol", "date", "close").join(
        known.join(strict, "date"), "date")


@query("release_lag", f"""WITH {ALIGNED}, lagged AS (
    SELECT symbol, date, lag(volume, 22) OVER (PARTITION BY symbol ORDER BY date) AS volume FROM aligned)
  SELECT symbol, date, {CARRIED.format('volume')} AS volume FROM lagged""")
def release_lag(spark, d):
    return alignment.release_lag(aligned(spark, d).drop("close"), ["volume"])


@query("missing_flags", f"""WITH {ALIGNED} SELECT symbol, date,
  CAST(close IS NULL AS INTEGER) AS "QC_close_missing", CAST(volume IS NULL AS INTEGER) AS "QC_volume_missing" FROM aligned""")
def missing_flags(spark, d):
    return alignment.missing_flags(aligned(spark, d), ["close", "volume"]).drop("close", "volume")


@query("median_impute", rounded(
    "SELECT symbol, date, coalesce(close, quantile_cont(close, 0.5) OVER (PARTITION BY symbol), 0.7) AS close,"
    " 0.7::DOUBLE AS empty FROM aligned", "symbol, date", "close, empty", with_=ALIGNED))
def median_impute(spark, d):
    df = aligned(spark, d).drop("volume").withColumn("empty", F.lit(None).cast("double"))
    return round6(alignment.median_impute(df, ["close", "empty"]), "close", "empty")


@query("breadth_proxy", f"""WITH {PRICES}, b AS (
    SELECT *, CASE WHEN CAST(symbol AS INTEGER) % 2 = 1 THEN volume END AS breadth FROM prices)
  SELECT symbol, date,
    CASE WHEN count(breadth) OVER s = 0 THEN
      CASE WHEN close > {gated('avg', 'close', 50)} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE breadth END AS breadth,
    CASE WHEN count(breadth) OVER s = 0 THEN 1 ELSE 0 END AS "QC_breadth_proxy"
  FROM b WINDOW s AS (PARTITION BY symbol), {frame(50)}""")
def breadth_proxy(spark, d):
    df = panels.prices(spark, d).withColumn(
        "breadth", F.when(F.col("symbol").cast("int") % 2 == 1, F.col("volume")))
    return alignment.breadth_proxy(df, "breadth", "close").drop("close", "volume")


@query("quality_report", rounded(
    """SELECT 'close' AS column_name, 100.0 * count(*) FILTER (close IS NULL) / count(*) AS missing_pct,
         100.0 * count(*) FILTER (close = 0) / count(*) AS zero_pct, min(close) AS min_value, max(close) AS max_value FROM aligned
       UNION ALL SELECT 'volume', 100.0 * count(*) FILTER (volume IS NULL) / count(*),
         100.0 * count(*) FILTER (volume = 0) / count(*), min(volume), max(volume) FROM aligned""",
    "column_name", "missing_pct, zero_pct, min_value, max_value", with_=ALIGNED))
def quality_report(spark, d):
    return round6(alignment.quality_report(aligned(spark, d), ["close", "volume"]),
                  "missing_pct", "zero_pct", "min_value", "max_value")


@query("validate_calendar", f"""WITH {ARRIVALS},
  found AS (
    SELECT symbol, 'order' AS violation, date, ingest_seq AS k FROM (
      SELECT *, lag(date) OVER (PARTITION BY symbol ORDER BY ingest_seq) AS before FROM arrivals) WHERE date < before
    UNION ALL SELECT symbol, 'duplicate', date, min(ingest_seq) FROM arrivals GROUP BY symbol, date HAVING count(*) > 1
    UNION ALL SELECT symbol, 'weekend', date, min(ingest_seq) FROM arrivals WHERE isodow(date) > 5 GROUP BY symbol, date),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol, violation ORDER BY k) AS rn FROM found)
  SELECT symbol, violation, count(*) AS violations,
         string_agg(CAST(date AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 10) AS examples
  FROM numbered GROUP BY symbol, violation""")
def validate_calendar(spark, d):
    return alignment.validate_calendar(panels.ordered_batch(spark, d))


@query("drop_weekends", f"WITH {ARRIVALS} SELECT * FROM arrivals WHERE isodow(date) < 6")
def drop_weekends(spark, d):
    return alignment.drop_weekends(panels.ordered_batch(spark, d))


@query("date_slice", rounded(
    f"SELECT * FROM (SELECT symbol, date, close / lag(close, 21) OVER w - 1 AS r FROM prices WINDOW {W})"
    " WHERE date >= DATE '1998-01-01'", "symbol, date", "r", with_=PRICES))
def date_slice(spark, d):
    df = rolling.trailing_return(panels.prices(spark, d), 21, out="r").select("symbol", "date", "r")
    return round6(alignment.date_slice(df, "1998-01-01"), "r")


@query("drop_null_columns", f"WITH {PRICES} SELECT symbol, date, close, volume FROM prices")
def drop_null_columns(spark, d):
    p = panels.prices(spark, d).withColumn("retired", F.lit(None).cast("double"))
    return alignment.drop_null_columns(p.withColumn("unused", F.lit(None).cast("string")))


@query("drop_incomplete_rows", f"""WITH {PRICES}, f AS (
    SELECT symbol, date, close / lag(close, 21) OVER w - 1 AS r, lead(close, 21) OVER w AS ahead FROM prices WINDOW {W})
  SELECT symbol, count(*) AS rows_before, count(*) FILTER (r IS NOT NULL AND ahead IS NOT NULL) AS rows_after,
    count(*) FILTER (r IS NULL OR ahead IS NULL) AS rows_dropped,
    min(date) FILTER (r IS NOT NULL AND ahead IS NOT NULL) AS first_valid,
    max(date) FILTER (r IS NOT NULL AND ahead IS NOT NULL) AS last_valid
  FROM f GROUP BY symbol""")
def drop_incomplete_rows(spark, d):
    df = rolling.trailing_return(panels.prices(spark, d), 21, out="r").withColumn("ahead", SERIES.lead("close", 21))
    return alignment.incomplete_report(df, ["r", "ahead"], ["symbol"])


@query("inf_to_null", f"""WITH {PRICES} SELECT symbol, date,
  CASE WHEN CAST(volume AS BIGINT) % 7 = 0 OR CAST(volume AS BIGINT) % 5 = 0 OR CAST(volume AS BIGINT) % 11 = 0 THEN NULL ELSE close END AS close,
  volume FROM prices""")
def inf_to_null(spark, d):
    v = F.col("volume").cast("bigint")
    dirty = panels.prices(spark, d).withColumn(
        "close",
        F.when(v % 7 == 0, F.lit(float("inf"))).when(v % 5 == 0, F.lit(float("nan")))
        .when(v % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("close")))
    return alignment.inf_to_null(dirty).select("symbol", "date", "close", "volume")


@query("month_end_sample", f"""WITH {ALIGNED}, s AS (
    SELECT *, CASE WHEN day(date) < 25 THEN volume END AS early FROM aligned)
  SELECT symbol, last_day(date) AS date, arg_max(early, date) FILTER (early IS NOT NULL) AS early,
         arg_max(close, date) FILTER (close IS NOT NULL) AS close
  FROM s GROUP BY symbol, last_day(date) HAVING count(early) > 0 AND count(close) > 0""")
def month_end_sample(spark, d):
    df = aligned(spark, d).withColumn("early", F.when(F.dayofmonth("date") < 25, F.col("volume")))
    return alignment.month_end_sample(df, ["early"], "close")
