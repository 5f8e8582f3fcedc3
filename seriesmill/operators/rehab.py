"""Stationary transforms, context features and interactions of a feature table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import (
    Series, complete_rows, finite, flag, running_moments, with_exprs,
)

SERIES = Series()

#: fixed names of the 21-row differences
DIFF_COLUMNS = {
    "HY_Spread": "HY_Spread_Diff",
    "Yield_Curve": "Yield_Curve_Chg",
    "USD_Trend": "USD_Trend_Chg",
    "Oil_Deviation": "Oil_Deviation_Chg",
}
RETURN_COLUMNS = ("Return_3M", "Return_6M", "Return_12M")
DROPPED = ("HY_Spread", "Yield_Curve", "Put_Call_Ratio", "USD_Trend", "Oil_Deviation",
           "UMich_Sentiment", *RETURN_COLUMNS, "RV_Ratio", "Log_Target_1M")


def diff21(df, n: int = 21, series=SERIES) -> DataFrame:
    return df.withColumns(
        {new: series.change(old, n) for old, new in DIFF_COLUMNS.items() if old in df.columns}
    )


def pct21(df, column="UMich_Sentiment", out="UMich_Sentiment_Chg", n: int = 21, series=SERIES) -> DataFrame:
    return df.withColumn(out, series.pct(column, n)) if column in df.columns else df


def return_zscore(df, n: int = 252, columns=RETURN_COLUMNS, series=SERIES) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    df = running_moments(df, series, [(f"_mean_{c}", f"_std_{c}", c, n, n) for c in present])
    return with_exprs(
        df, {f"{c}_Z": f"CASE WHEN abs(`{c}`) < double('Infinity') THEN (`{c}` - `_mean_{c}`) / (`_std_{c}` + 1e-8D) END" for c in present}
    ).drop(*[f"_{k}_{c}" for c in present for k in ("mean", "std")])


def month_cyclic(df, date="date") -> DataFrame:
    angle = F.month(date) * (2 * math.pi / 12)
    return df.withColumns({"Month_Sin": F.sin(angle), "Month_Cos": F.cos(angle)})


def month_of_year(df, date="date") -> DataFrame:
    return df.withColumn("Month_of_Year", F.month(date))


def breadth_thrust(df, column="Sectors_Above_50MA", n: int = 5, series=SERIES) -> DataFrame:
    return df.withColumn("Breadth_Thrust", series.change(column, n))


def breadth_regime(df, column="Sectors_Above_50MA", threshold: float = 0.5) -> DataFrame:
    return df.withColumn("Breadth_Regime", flag(F.col(column) > threshold))


def interactions(df) -> DataFrame:
    gap = F.col("Imp_Real_Gap")
    new = {}
    if "Return_1M" in df.columns:
        new["Vol_Trend_Interact"] = gap * F.col("Return_1M")
    if "Breadth_Thrust" in df.columns:
        new["Breadth_Vol_Interact"] = F.col("Breadth_Thrust") * gap
    return df.withColumns(new) if new else df


def rehab_features(
    df: DataFrame, *, legacy: bool = False, keep_price: bool = True, price: str = "Price",
    breadth_threshold: float = 0.5, keys=("symbol", "date"), series=SERIES,
) -> DataFrame:
    """All transforms; incomplete rows (warm-up) are dropped at the end.

    `legacy` keeps an integer month instead of its angle and drops the z-scores.
    """
    df = return_zscore(pct21(diff21(df, series=series), series=series), series=series)
    df = month_of_year(df) if legacy else month_cyclic(df)
    if "Sectors_Above_50MA" in df.columns:
        df = breadth_regime(breadth_thrust(df, series=series), threshold=breadth_threshold)
    if "Imp_Real_Gap" in df.columns:
        df = interactions(df)
    drop = [c for c in DROPPED if c in df.columns]
    if legacy:
        drop += [f"{c}_Z" for c in RETURN_COLUMNS]
        if not keep_price:
            drop.append(price)
    df = df.drop(*drop)
    doubles = [c for c, t in df.dtypes if t == "double" and c not in keys]
    return complete_rows(df.withColumns({c: finite(c) for c in doubles}), df.columns)


def changed_columns(before: DataFrame, after: DataFrame) -> tuple[list[str], list[str]]:
    """Names added and dropped, both sorted."""
    old, new = set(before.columns), set(after.columns)
    return sorted(new - old), sorted(old - new)


def zscore126_detrend20(
    df, spread="HY_Spread", ratio="Put_Call_Ratio", n: int = 126, m: int = 20, series=SERIES
) -> DataFrame:
    """Diagnostic variants: z-score of the spread, ratio over its own mean."""
    df = running_moments(df, series, [("_mean", "_std", spread, n, n)])
    return df.withColumns(
        {
            f"{spread}_Z": (finite(spread) - F.col("_mean")) / (F.col("_std") + 1e-8),
            "PCR_Detrend": finite(ratio) / (series.mean(ratio, m) + 1e-8),
        }
    ).drop("_mean", "_std")


def null_counts(df: DataFrame, columns, more_than: int = 500) -> DataFrame:
    """Columns with more than `more_than` nulls."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns]))
    ).filter(F.col("nulls") > more_than)
