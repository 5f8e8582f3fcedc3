"""Forward-return targets, labels and the dataset built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import Series, complete_rows, divide, finite, flag
from seriesmill.operators.alignment import drop_null_columns, drop_weekends, ffill, month_end_sample
from seriesmill.operators.rehab import rehab_features

SERIES = Series()
LABELS = ("BigMove", "BigMoveUp", "BigMoveDown")
#: fixed list of macro columns that may be carried forward
FFILL_COLUMNS = ("ISM_PMI", "UMich_Sentiment", "Yield_Curve", "Put_Call_Ratio")


def forward_return(df, h=21, price="close", out="Target_1M", *, drop_tail=True, series=SERIES) -> DataFrame:
    df = df.withColumn(out, divide(series.lead(price, h) - F.col(price), price))
    return df.filter(F.col(out).isNotNull()) if drop_tail else df


def log_forward_return(df, h=21, price="close", out="Log_Target_1M", series=SERIES) -> DataFrame:
    return df.withColumn(out, F.ln(divide(series.lead(price, h), price)))


def target_from_trailing(df, trailing="Return_1M", h=21, out="Target_1M", series=SERIES) -> DataFrame:
    return df.withColumn(out, series.lead(trailing, h))


def next_month_return_monthly(df, price="close", out="Target_1M", series=SERIES) -> DataFrame:
    """On a month-end panel: next row over this one."""
    return forward_return(df, 1, price, out, series=series)


def next_month_return_daily(df, price="close", out="Target_1M", symbol="symbol", date="date") -> DataFrame:
    """Return to this month's end, or to the next one's on a month-end day.

    Month-end prices are the last known price of each month, joined on
    (series, month end).
    """
    ends = df.groupBy(symbol, F.last_day(date).alias("_end")).agg(
        F.max_by(price, F.when(F.col(price).isNotNull(), F.col(date))).alias("_future")
    )
    target_end = F.when(
        F.col(date) == F.last_day(date), F.last_day(F.add_months(date, 1))
    ).otherwise(F.last_day(date))
    joined = df.withColumn("_end", target_end).join(ends, [symbol, "_end"])
    return (
        joined.withColumn(out, divide(F.col("_future") - F.col(price), price))
        .filter(F.col(out).isNotNull())
        .drop("_end", "_future")
    )


def big_move_labels(df, target="Target_1M", threshold=0.03) -> DataFrame:
    y = finite(target)
    return df.withColumns(
        {
            "BigMove": flag(F.abs(y) > threshold),
            "BigMoveUp": flag(y > threshold),
            "BigMoveDown": flag(y < -threshold),
        }
    )


def dataset_summary(df, n_features: int, embargo: int = 21, by=(), date="date") -> DataFrame:
    n = F.count("*")

    def total(c):
        return F.sum(F.col(c).cast("bigint"))

    return df.groupBy(*by).agg(
        n.alias("n_rows"),
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.lit(n_features).alias("n_features"),
        F.lit(embargo).alias("embargo_rows"),
        total("BigMove").alias("n_big"),
        total("BigMoveUp").alias("n_up"),
        total("BigMoveDown").alias("n_down"),
        divide(100.0 * total("BigMove"), n).alias("pct_big"),
    )


def feature_columns(df: DataFrame, target="Target_1M", keys=("symbol", "date"), price="Price") -> list[str]:
    """Names usable as features: no keys, targets, labels or prices."""
    out = {target, *LABELS, price, f"Log_{target}", *keys}
    return [c for c in df.columns if c not in out]


def build_dataset(
    features: DataFrame, *, frequency="daily", target_mode="forward_21d", horizon=21,
    threshold=0.03, rehab=True, price="Price", target="Target_1M", series=SERIES,
) -> DataFrame:
    """Feature table -> observation rows -> target -> labels, leaks dropped.

    Columns without any value go first, else no row would be complete.
    """
    df = drop_null_columns(drop_weekends(features).drop("MA_Dist_200", target, f"Log_{target}"))
    if rehab:  # leaves complete rows only, so there is nothing to carry forward
        df = rehab_features(df, price=price, series=series)
    else:
        df = ffill(df, [c for c in FFILL_COLUMNS if c in df.columns], series)
        df = complete_rows(df, df.columns)
    if frequency == "monthly":
        names = [c for c in df.columns if c not in ("symbol", "date", price)]
        df = month_end_sample(df, names, price)
        if target_mode != "next_month":
            raise ValueError("monthly observations need target_mode='next_month'")
        df = next_month_return_monthly(df, price, target, series)
    elif target_mode == "next_month":
        df = next_month_return_daily(df, price, target)
    else:
        df = forward_return(df, horizon, price, target, series=series)
    return big_move_labels(df.drop(price), target, threshold)
