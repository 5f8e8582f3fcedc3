"""Reading, merging and exporting of stored series, features and runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seriesmill.functions.columns import finite


def read_feature_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Dated table from parquet, CSV or ORC.  CSV needs a schema: no inference."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        raise ValueError("a CSV table needs an explicit schema")
    if fmt == "csv":
        reader = reader.option("header", True).option("dateFormat", "yyyy-MM-dd")
    return reader.load(path)


def read_since(df: DataFrame, since: str | None = None, date: str = "date") -> DataFrame:
    """Rows from a date on; the filter reaches the scan."""
    return df if since is None else df.filter(F.col(date) >= F.lit(since).cast("date"))


def read_before(df: DataFrame, until: str, date: str = "date") -> DataFrame:
    """Rows before a date."""
    return df.filter(F.col(date) < F.lit(until).cast("date"))


def read_symbols(
    df: DataFrame, symbols: Sequence[str] | None = None, since: str | None = None,
    symbol: str = "symbol", date: str = "date",
) -> DataFrame:
    if symbols:
        df = df.filter(F.col(symbol).isin(list(symbols)))
    return read_since(df, since, date)


def long_to_wide(
    df: DataFrame, symbols: Sequence[str], value: str = "value", symbol: str = "symbol",
    date: str = "date",
) -> DataFrame:
    """One column per listed symbol; duplicates of a cell are averaged."""
    return df.groupBy(date).pivot(symbol, list(symbols)).agg(F.avg(value))


def wide_to_long(
    df: DataFrame, columns: Sequence[str], date: str = "date", symbol: str = "symbol",
    value: str = "value",
) -> DataFrame:
    """(symbol, date, value) of all usable cells; null, NaN and Inf are dropped."""
    melted = df.select(date, *[finite(F.col(c).cast("double")).alias(c) for c in columns]).unpivot(
        [date], list(columns), symbol, value
    )
    return melted.filter(F.col(value).isNotNull()).select(symbol, date, value)


def latest_per_key(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last arrival of every key (combines before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")


def upsert_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """Keyed merge: fields the new row has win, even when null; others stay.

    Of several new rows of a key one counts: the last by `seq`, or without it the greatest.  With
    `seq` a new row that arrived before the stored one changes nothing.
    """
    keys = list(keys)
    rest = [c for c in new.columns if c not in keys]
    if seq:
        new = latest_per_key(new, keys, seq)
    elif rest:
        new = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
    else:
        new = new.distinct()
    marked = new.withColumn("_new", F.lit(True))
    o, n = old.alias("o"), marked.alias("n")
    condition: Column = F.lit(True)
    for k in keys:
        condition = condition & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    arrived = F.col("n._new").isNotNull()
    if seq and seq in old.columns:
        arrived = arrived & (F.col(f"o.{seq}").isNull() | (F.col(f"n.{seq}") >= F.col(f"o.{seq}")))
    cells = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    for c in [*old.columns, *[c for c in new.columns if c not in old.columns]]:
        if c in keys:
            continue
        if c not in new.columns:
            cells.append(F.col(f"o.{c}").alias(c))
        elif c not in old.columns:
            cells.append(F.when(arrived, F.col(f"n.{c}")).alias(c))
        else:
            cells.append(F.when(arrived, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return o.join(n, condition, "full_outer").select(*cells)


def write_partitioned(df: DataFrame, path: str, partition: Sequence[str], mode: str = "overwrite") -> None:
    """Write; `overwrite` replaces only the partitions that occur in `df`."""
    (
        df.repartition(*partition, *[c for c in ("symbol",) if c in df.columns and c not in partition])
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition)
        .parquet(path)
    )


def merge_into(
    spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], partition: str, seq: str | None = None
) -> None:
    """Upsert a batch into a parquet table partitioned by `partition`.

    Only partitions the batch touches are read and rewritten: their names, one for each month or
    the like, are fetched and become a partition filter.  Merging the same batch again gives the
    same table.
    """
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # first batch: no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        write_partitioned(upsert_by_key(batch.limit(0), batch, keys, seq), path, [partition])
        return
    touched = [row[0] for row in batch.select(F.col(partition).cast("string")).distinct().collect()]
    current = stored.filter(F.col(partition).cast("string").isin(touched))
    merged = upsert_by_key(current, batch.withColumn(partition, F.col(partition).cast(stored.schema[partition].dataType)), keys, seq)
    write_partitioned(merged, path, [partition])


def high_water_mark(df: DataFrame, date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.max(date).alias("last_date"))


def load_run(predictions: DataFrame, run_id: str) -> DataFrame:
    """Predictions of one run (run_id is the partition column of the store)."""
    return predictions.filter(F.col("run_id") == run_id).drop("run_id")


def load_latest_run(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions of the run created last (ties: the greater run_id)."""
    latest = runs.select(F.max_by("run_id", F.struct("created_at", "run_id"))).scalar()
    # a subquery on the partition column prunes
    return predictions.filter(F.col("run_id") == latest)


def source_report(
    df: DataFrame, priority: Sequence[str], series: str = "series", source: str = "source",
    value: str = "value",
) -> DataFrame:
    """Per series the first source, in priority order, that has any value."""
    rank = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col(source))
    counts = df.groupBy(series, source).agg(F.count(value).alias("_n"))
    usable = F.when((F.col("_n") > 0) & (rank > 0), rank)
    return counts.groupBy(series).agg(
        F.min_by(source, usable).alias("chosen"),
        F.coalesce(F.min_by("_n", usable), F.lit(0)).alias("values"),
    )


def first_valid_source(
    df: DataFrame, priority: Sequence[str], series: str = "series", source: str = "source",
    value: str = "value",
) -> DataFrame:
    report = source_report(df, priority, series, source, value).select(
        series, F.col("chosen").alias(source)
    )
    return df.join(report, [series, source], "left_semi")


def predictions_export(validation: DataFrame, test: DataFrame) -> DataFrame:
    """Both sets with a `type` tag; sort when writing."""
    return validation.withColumn("type", F.lit("validation")).unionByName(
        test.withColumn("type", F.lit("test"))
    )


def enrich_left_join(
    main: DataFrame, extras: Mapping[str, DataFrame], keys: Sequence[str] = ("date",),
    seq: str = "ingest_seq",
) -> DataFrame:
    """Left join of extra tables; the first arrival of a key counts, and
    columns that already exist get the source name as suffix."""
    keys = list(keys)
    for name, extra in extras.items():
        values = [c for c in extra.columns if c not in keys and c != seq]
        first = extra.groupBy(*keys).agg(F.min_by(F.struct(*values), seq).alias("_f"))
        cells = [
            F.col(f"_f.{c}").alias(f"{c}_{name}" if c in main.columns else c) for c in values
        ]
        main = main.join(first.select(*keys, *cells), keys, "left")
    return main


def refresh_window(
    panel: DataFrame, last_date: Column | str, lookback_rows: int, symbol: str = "symbol",
    date: str = "date",
) -> DataFrame:
    """New rows plus the `lookback_rows` rows before them of every series."""
    last = F.lit(last_date).cast("date") if isinstance(last_date, str) else last_date
    old = F.col(date) <= last
    back = Window.partitionBy(symbol).orderBy(F.col(date).desc())
    newer = F.count(F.when(~old, 1)).over(Window.partitionBy(symbol))
    return (
        panel.withColumns({"_rn": F.row_number().over(back), "_new": newer})
        .filter(~old | (F.col("_rn") - F.col("_new") <= lookback_rows))
        .drop("_rn", "_new")
    )


def incremental_refresh(
    stored: DataFrame,
    panel: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    lookback_rows: int,
    keys: Sequence[str] = ("symbol", "date"),
    date: str = "date",
) -> DataFrame:
    """Recompute features after the stored high-water mark only, then upsert."""
    last = stored.select(F.coalesce(F.max(date), F.lit("0001-01-01").cast("date"))).scalar()
    fresh = compute(refresh_window(panel, last, lookback_rows, date=date)).filter(
        F.col(date) > last
    )
    return upsert_by_key(stored, fresh, keys)
