"""Calendar alignment, gap handling and data-quality reports of panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.columns import Series, complete_rows, count_if, divide, finite, flag

SERIES = Series()


def calendar_positions(calendar: DataFrame) -> DataFrame:
    """`(date, position)` of a calendar.  Its length is bounded by the days."""
    return calendar.select("date").distinct().withColumn(
        "position", F.row_number().over(Window.orderBy("date")) - 1
    )


def calendar_align(
    panel: DataFrame, calendar: DataFrame, values: Sequence[str], symbol: str = "symbol"
) -> DataFrame:
    """Every series on every calendar day; off-calendar rows are dropped.

    Each row fills the gap up to the next row of its series, so the grid is
    written by one pass over the panel without pairing symbols and days.  Of rows
    with the same series and date the greatest values count as one row.
    """
    panel = panel.groupBy(symbol, "date").agg(F.max(F.struct(*values)).alias("_v")).select(symbol, "date", "_v.*")
    days = calendar_positions(calendar)
    n_days = days.select(F.count("*")).scalar()
    by_symbol = Window.partitionBy(symbol).orderBy(F.col("position").asc_nulls_last())
    rows = panel.select(symbol, "date", *values).join(days, "date", "left").withColumn(
        "_rn", F.row_number().over(by_symbol)
    )
    # a series without any calendar day keeps one row and comes out empty
    rows = rows.filter(F.col("position").isNotNull() | (F.col("_rn") == 1))
    rows = rows.withColumns(
        {
            "_from": F.when(F.col("_rn") == 1, 0).otherwise(F.col("position")).cast("bigint"),
            "_to": F.coalesce(F.lead("position").over(by_symbol), n_days).cast("bigint") - 1,
        }
    )
    grid = rows.withColumn("_p", F.explode(F.sequence("_from", "_to")))
    return grid.select(
        symbol,
        F.col("_p").cast("int").alias("position"),
        *[F.when(F.col("_p") == F.col("position"), F.col(v)).alias(v) for v in values],
    ).join(days, "position").select(symbol, "date", *values)


def outer_join_series(series: Mapping[str, DataFrame]) -> DataFrame:
    """Full outer join on date of `(date, value)` series, one column each.

    One union and one aggregation instead of a chain of joins.
    """
    parts = [
        df.select("date", F.lit(name).alias("_name"), F.col("value").cast("double"))
        for name, df in series.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("date").agg(
        *[F.max(F.when(F.col("_name") == n, F.col("value"))).alias(n) for n in series]
    )


def ffill(df: DataFrame, columns: Sequence[str], series: Series = SERIES) -> DataFrame:
    """Carry the last known value of the listed columns forward."""
    return df.withColumns({c: series.last_known(c) for c in columns})


def asof_release(
    calendar: DataFrame, releases: DataFrame, *, strict: bool = True, out: str = "value"
) -> DataFrame:
    """Last release `(date, value)` known on every calendar day.

    `strict` keeps the rule that releases on days outside the calendar are
    lost; otherwise they count from the next calendar day.  Both sides are
    dated tables with one row per day at most.
    """
    days = calendar.select("date").distinct()
    union = (
        days.select("date", F.lit(True).alias("_day"), F.lit(None).cast("double").alias("_v"))
        .unionByName(releases.select("date", F.lit(False).alias("_day"), F.col("value").alias("_v")))
        .groupBy("date")
        .agg(F.max("_day").alias("_day"), F.max("_v").alias("_v"))
    )
    if strict:
        union = union.filter("_day")
    known = F.last("_v", ignorenulls=True).over(
        Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    )
    return union.withColumn(out, known).filter("_day").select("date", out)


def release_lag(
    df: DataFrame, columns: Sequence[str], rows: int = 22, series: Series = SERIES
) -> DataFrame:
    """Shift by the publication delay, then carry forward."""
    shifted = df.withColumns({c: series.lag(c, rows) for c in columns})
    return ffill(shifted, columns, series)


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """QC_<column>_missing = 1 where the value is missing (use before ffill)."""
    return df.withColumns({f"QC_{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def median_impute(
    df: DataFrame, columns: Sequence[str], default: float = 0.7, *, expanding: bool = False,
    series: Series = SERIES,
) -> DataFrame:
    """Fill nulls with the median of the series, or `default` without values.

    The whole-history median looks ahead; `expanding=True` uses past rows only.
    """
    window = series.so_far if expanding else series.whole
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.median(c).over(window), F.lit(default)) for c in columns}
    )


def breadth_proxy(
    df: DataFrame, column: str, price: str, n: int = 50, series: Series = SERIES
) -> DataFrame:
    """Replace a series without any value by 100 * (price > mean of n rows)."""
    empty = F.count(column).over(series.whole) == 0
    proxy = F.when(F.col(price) > series.mean(price, n), 100.0).otherwise(0.0)
    return df.withColumns(
        {column: F.when(empty, proxy).otherwise(F.col(column)), f"QC_{column}_proxy": flag(empty)}
    )


def quality_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: percent missing, percent zero, min, max; one pass."""
    stats = []
    for c in columns:
        stats += [
            divide(100.0 * count_if(F.col(c).isNull()), F.count("*")).alias(f"_m_{c}"),
            divide(100.0 * count_if(F.col(c) == 0), F.count("*")).alias(f"_z_{c}"),
            F.min(c).cast("double").alias(f"_lo_{c}"),
            F.max(c).cast("double").alias(f"_hi_{c}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_m_{c}").alias("missing_pct"),
                F.col(f"_z_{c}").alias("zero_pct"),
                F.col(f"_lo_{c}").alias("min_value"),
                F.col(f"_hi_{c}").alias("max_value"),
            )
            for c in columns
        ]
    )
    return df.agg(*stats).select(F.inline(rows))


def previous_arrival(
    df: DataFrame, value: str, seq: str, by: Sequence[str], out: str, piece_rows: int = 1_000_000
) -> DataFrame:
    """Value of the row that arrived just before, within a group of any size.

    Arrival numbers are cut into pieces; the last value of a piece is handed to
    the first row of the next one.
    """
    by = list(by)
    df = df.withColumn("_piece", F.floor(F.col(seq) / F.lit(piece_rows)))
    inside = Window.partitionBy(*by, "_piece").orderBy(seq)
    last = df.groupBy(*by, "_piece").agg(F.max_by(value, seq).alias("_last"))
    handed = last.select(
        *by, "_piece",
        F.lag("_last").over(Window.partitionBy(*by).orderBy("_piece")).alias("_handed"),
    )
    return (
        df.withColumn("_prev", F.lag(value).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(handed, [*by, "_piece"])
        .withColumn(out, F.when(F.col("_first"), F.col("_handed")).otherwise(F.col("_prev")))
        .drop("_piece", "_prev", "_first", "_handed")
    )


def validate_calendar(
    arrivals: DataFrame, seq: str = "ingest_seq", symbol: str = "symbol", keep: int = 10
) -> DataFrame:
    """Violations per series: `order`, `duplicate`, `weekend`.

    Returns the count and the first offending dates (at most `keep`).  No row
    for a series means a valid calendar.
    """
    ordered = previous_arrival(arrivals.select(symbol, "date", seq), "date", seq, [symbol], "_before")
    order = ordered.filter(F.col("date") < F.col("_before")).select(
        symbol, F.lit("order").alias("violation"), "date", F.col(seq).alias("_at")
    )
    dates = arrivals.groupBy(symbol, "date").agg(F.count("*").alias("_n"), F.min(seq).alias("_at"))
    repeated = dates.filter("_n > 1").select(
        symbol, F.lit("duplicate").alias("violation"), "date", "_at"
    )
    weekend = dates.filter(F.weekday("date") >= 5).select(
        symbol, F.lit("weekend").alias("violation"), "date", "_at"
    )
    found = order.unionByName(repeated).unionByName(weekend)
    counts = found.groupBy(symbol, "violation").agg(F.count("*").alias("violations"))
    first = Window.partitionBy(symbol, "violation").orderBy("_at")
    examples = (
        found.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= keep)
        .groupBy(symbol, "violation")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "date"))).alias("_e"))
        .select(
            symbol, "violation",
            F.array_join(F.transform("_e", lambda e: e["date"].cast("string")), ",").alias("examples"),
        )
    )
    return counts.join(examples, [symbol, "violation"])


def drop_weekends(df: DataFrame, date: str = "date") -> DataFrame:
    return df.filter(F.weekday(date) < 5)


def date_slice(df: DataFrame, start: str, date: str = "date") -> DataFrame:
    """Rows from `start` on; apply after window features, they need history."""
    return df.filter(F.col(date) >= F.lit(start).cast("date"))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value (one pass, one row to the driver)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def drop_incomplete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return complete_rows(df, columns or df.columns)


def incomplete_report(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """Rows before and after dropping incomplete ones, first and last valid date."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("rows_before"),
        count_if(complete).alias("rows_after"),
        (F.count("*") - count_if(complete)).alias("rows_dropped"),
        F.min(F.when(complete, F.col(date))).alias("first_valid"),
        F.max(F.when(complete, F.col(date))).alias("last_valid"),
    )


def inf_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = columns or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: finite(c) for c in columns})


def month_end_sample(
    df: DataFrame, features: Sequence[str], price: str, symbol: str = "symbol", date: str = "date"
) -> DataFrame:
    """Last known value of each column per month, dated at the calendar month end.

    Months need a price and at least one feature.
    """
    def last(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c)

    monthly = df.groupBy(symbol, F.last_day(date).alias(date)).agg(
        *[last(c) for c in [*features, price]]
    )
    return monthly.filter(F.col(price).isNotNull() & F.coalesce(*features).isNotNull())
