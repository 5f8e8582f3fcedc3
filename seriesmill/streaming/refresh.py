"""Incremental maintenance of series and features from arriving rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesmill.sources.store import latest_per_key, merge_into


def with_month(df: DataFrame, date: str = "date", out: str = "month") -> DataFrame:
    """Partition column of the stores."""
    return df.withColumn(out, F.date_format(date, "yyyy-MM"))


def stream_upsert(
    rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("symbol", "date"),
    seq: str | None = None,
) -> StreamingQuery:
    """Merge arriving rows into a parquet store by key.

    Every micro-batch rewrites only the months it touches; a batch delivered
    again changes nothing.  With `seq`, which is stored, the last arrival of a key
    wins, also over rows of earlier batches.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = with_month(latest_per_key(batch, list(keys), seq) if seq else batch).persist()
        merge_into(batch.sparkSession, path, rows, keys, "month", seq)
        rows.unpersist()

    return (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def lookback_rows(panel: DataFrame, touched: DataFrame, rows: int) -> DataFrame:
    """History needed to recompute from the first touched date of each series.

    `touched` holds `(symbol, first_date)`; the rows before that date are kept
    up to the look-back.
    """
    p = panel.join(touched, "symbol")
    old = F.col("date") < F.col("first_date")
    back = Window.partitionBy("symbol", old).orderBy(F.col("date").desc())
    return p.withColumn("_k", F.row_number().over(back)).filter(~old | (F.col("_k") <= rows)).drop("_k")


def stream_feature_refresh(
    rows: DataFrame, prices_path: str, features_path: str, checkpoint: str,
    compute: Callable[[DataFrame], DataFrame], lookback: int,
    keys: Sequence[str] = ("symbol", "date"), seq: str | None = None,
) -> StreamingQuery:
    """Upsert prices, then recompute features of the touched series only.

    A changed row affects later rows of its series, so everything from the
    first touched date on is recomputed with `lookback` rows of history.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = with_month(latest_per_key(batch, list(keys), seq) if seq else batch).persist()
        merge_into(spark, prices_path, batch, keys, "month", seq)
        touched = batch.groupBy("symbol").agg(F.min("date").alias("first_date"))
        stored = spark.read.parquet(prices_path).drop("month", *([seq] if seq else []))
        history = lookback_rows(stored, touched, lookback)
        fresh = with_month(compute(history).filter(F.col("date") >= F.col("first_date")).drop("first_date")).persist()
        merge_into(spark, features_path, fresh, keys, "month")
        fresh.unpersist()
        batch.unpersist()

    return (
        rows.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
