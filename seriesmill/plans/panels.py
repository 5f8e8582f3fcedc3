"""Panels derived from the given tables; inputs of the registered queries.

Sums run over whole cents, so they are exact and do not depend on the order in
which partial results are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions.columns import Series, divide, running_mean

#: rows ahead / behind for targets and trailing signals
HORIZON = 21
#: lines whose series one task holds
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _mean_cents(c: str, condition: Column | None = None) -> Column:
    value = _cents(c) if condition is None else F.when(condition, _cents(c))
    return divide(F.sum(value).cast("double"), F.count(value) * F.lit(100.0))


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines on trading weekdays."""
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("date", F.to_date("l_shipdate"))
        .filter(F.weekday("date") < 5)
    )


def tasks(spark: SparkSession, rows: int) -> int | None:
    """Partitions of at most about `TASK_ROWS` rows; None where Spark's own are as small."""
    n = -(-rows // TASK_ROWS)
    usual = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return n if n > usual else None


def dealt(panel: DataFrame) -> DataFrame:
    """The rows of a written panel with each series in one task, of which there are more for more rows."""
    n = tasks(panel.sparkSession, panel.count())
    return panel.repartition(n, "symbol") if n else panel


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily close and volume per supplier; suppliers trade on some days only.

    The number of partitions grows with the lines, as a task sorts all of its series.  Lines are dealt
    by day as well, so a busy supplier is grouped by many tasks; its series is bounded by the calendar.
    """
    lines = _shipments(spark, sf_dir).select(
        F.col("l_suppkey").cast("string").alias("symbol"), "date", "l_extendedprice", "l_quantity")
    n = tasks(spark, table(spark, sf_dir, "lineitem").count())
    if n:
        lines = lines.repartition(n, "symbol", "date")
    days = lines.groupBy("symbol", "date").agg(_mean_cents("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume"))
    return days.repartition(n, "symbol") if n else days


def brand_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily close per brand (the sectors of the breadth indicators)."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = _shipments(spark, sf_dir)
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(F.col("p_brand").alias("symbol"), "date")
        .agg(_mean_cents("l_extendedprice").alias("close"))
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per trading day; at small scale some cells are null."""
    def of(c: str) -> Column:
        return F.col("l_returnflag") == c

    return (
        _shipments(spark, sf_dir)
        .groupBy("date")
        .agg(
            _mean_cents("l_extendedprice").alias("spy"),
            _mean_cents("l_extendedprice", of("A")).alias("hyg"),
            _mean_cents("l_extendedprice", of("N")).alias("shy"),
            F.ln(_mean_cents("l_extendedprice", of("R"))).alias("dxy"),
            _mean_cents("l_extendedprice", F.col("l_linestatus") == "O").alias("oil"),
            (1000 * _mean_cents("l_discount")).alias("vix"),
            divide(
                (F.sum(_cents("l_tax")) - F.sum(_cents("l_discount"))).cast("double"),
                F.count("*").cast("double"),
            ).alias("t10y2y"),
            divide(
                F.count(F.when(F.col("l_linestatus") == "O", 1)).cast("double"),
                F.count(F.when(F.col("l_linestatus") == "F", 1)).cast("double"),
            ).alias("cpc"),
        )
        .withColumn("symbol", F.lit("MKT"))
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master calendar: the weekdays on which orders were placed."""
    return (
        table(spark, sf_dir, "orders")
        .select(F.to_date("o_orderdate").alias("date"))
        .filter(F.weekday("date") < 5)
        .distinct()
    )


def macro_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly release, dated at the first order of the month."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.trunc("o_orderdate", "month").alias("month"))
        .agg(
            F.to_date(F.min("o_orderdate")).alias("date"),
            _mean_cents("o_totalprice").alias("value"),
        )
        .select(F.lit("PMI").alias("symbol"), "date", "value")
    )


def raw_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long store rows (symbol, date, value) of close and volume."""
    p = prices(spark, sf_dir)
    return p.select(
        "date",
        F.inline(
            F.array(
                F.struct(F.concat("symbol", F.lit("_close")).alias("symbol"),
                         F.col("close").alias("value")),
                F.struct(F.concat("symbol", F.lit("_volume")).alias("symbol"),
                         F.col("volume").alias("value")),
            )
        ),
    ).select("symbol", "date", "value")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast rows of every supplier, on a level smoothed over 63 rows.

    `y_true` is the 21-row forward return, `y_pred` the 21-row trailing return,
    `ret` the daily return, `regime` whether close is above its 50-row mean,
    `f1`/`f2` two more features and `fold_id` the year.
    """
    series = Series()
    df = running_mean(
        prices(spark, sf_dir), series, [("level", "close", 63), ("sma50", "close", 50)]
    )
    df = df.withColumns(
        {
            "y_true": divide(series.lead("level", HORIZON), "level") - 1,
            "y_pred": series.pct("level", HORIZON),
            "ret": series.pct("level", 1),
            "f1": divide("close", "level") - 1,
            "f2": divide("volume", F.lit(25.0)) - 1,
            "regime": F.when(F.col("close") > F.col("sma50"), 1).otherwise(0),
        }
    )
    return df.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()).select(
        "symbol", "date", F.year("date").alias("fold_id"),
        "y_true", "y_pred", "ret", "f1", "f2", "regime",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored run per forecast year."""
    return forecasts(spark, sf_dir).groupBy("fold_id").agg(
        F.max("date").alias("created_at")
    ).select(F.concat(F.lit("run_"), "fold_id").alias("run_id"), "created_at",
             F.lit("Ridge").alias("model"))


def ordered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order stream with its arrival number: duplicates, weekends, disorder."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).cast("string").alias("symbol"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.col("o_totalprice").alias("value"),
    )
