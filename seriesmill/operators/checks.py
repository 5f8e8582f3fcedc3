"""Data and leakage checks; results are rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill.functions.columns import Series, corr, count_if, divide, finite
from seriesmill.functions.lineage import forget, outlive, release, scratch, written
from seriesmill.operators.policy import evaluate_policy
from seriesmill.functions.prefix import running
from seriesmill.operators.ranking import GROUP_ROWS, average_rank, quantiles, spearman, with_rank, with_ranks

#: fixed name parts of columns derived from the target
LEAK_PATTERNS = ("BigMove", "BigMoveUp", "BigMoveDown", "Log_Target", "Target_")
#: fixed 5% critical value of the Dickey-Fuller t with constant
DF_CRITICAL = -2.86
#: rows that one task pairs, and those of one bucket of hashes
TASK_ROWS, BUCKET_ROWS = 500_000, 16_000


def _rows_per_column(stats: DataFrame, columns: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One aggregated row to one row per column; fields: name -> prefix."""
    structs = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{p}{c}").alias(n) for n, p in fields.items()])
        for c in columns
    ]
    return stats.select(F.inline(F.array(*structs)))


def null_percentages(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent null of the columns that have any."""
    stats = df.agg(*[divide(100.0 * count_if(F.col(c).isNull()), F.count("*")).alias(f"p_{c}") for c in columns])
    return _rows_per_column(stats, columns, {"pct": "p_"}).filter("pct > 0")


def row_null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.agg(
        F.count("*").alias("n_rows"), F.max(nulls).alias("max_nulls"), count_if(nulls == 0).alias("complete_rows"))


def leading_nulls(df: DataFrame, columns: Sequence[str], by=("symbol",)) -> DataFrame:
    """First valid date and number of nulls before it, per series and column."""
    pos = df.withColumn("_p", Series(by).position())
    aggs = []
    for c in columns:
        known = F.col(c).isNotNull()
        aggs += [F.min(F.when(known, F.col("date"))).alias(f"d_{c}"),
                 F.coalesce(F.min(F.when(known, F.col("_p"))) - 1, F.count("*")).cast("bigint").alias(f"n_{c}")]
    structs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"d_{c}").alias("first_valid"), F.col(f"n_{c}").alias("leading"))
        for c in columns])
    return pos.groupBy(*by).agg(*aggs).select(*by, F.inline(structs))


def data_range(df: DataFrame, n_features: int, by=()) -> DataFrame:
    first, last = F.min("date"), F.max("date")
    return df.groupBy(*by).agg(
        first.alias("first_date"), last.alias("last_date"), F.count("*").alias("n_rows"),
        F.lit(n_features).alias("n_features"), (F.datediff(last, first) / 365.25).alias("years"))


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal values share their mean rank."""
    _, place, ties = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(ties) - (ties - 1) / 2.0)[place]


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Correlation of ranks, 0 when a side does not vary."""
    a, b = (r - r.mean() for r in (average_ranks(x), average_ranks(y)))
    size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return float((a * b).sum() / size) if size else 0.0


def target_autocorr(df: DataFrame, target="y_true", max_lag=25, by=("symbol",), least=10) -> DataFrame:
    """Rank correlation of the target with itself k rows before, per series.

    A task takes one series at a time, which the calendar bounds; rows are not copied for the lags.
    All lags of a series appear, those without enough pairs as 0.
    """
    by = list(by)
    rows = df.filter(F.col(target).isNotNull()).select(*by, "date", F.col(target).cast("double").alias("_y"))
    lags = range(1, max_lag + 1)

    def correlate(series: pa.Table) -> pa.Table:
        y = series.sort_by("date")["_y"].to_numpy()
        pairs = [max(len(y) - k, 0) for k in lags]
        found = [rank_correlation(y[k:], y[:-k]) if n > least else 0.0 for k, n in zip(lags, pairs)]
        out = {c: pa.concat_arrays([series[c].combine_chunks()[:1]] * max_lag) for c in by}
        return pa.table(out | {"lag": pa.array(lags, pa.int32()), "pairs": pa.array(pairs, pa.int64()), "autocorr": pa.array(found, pa.float64())})

    schema = T.StructType([rows.schema[c] for c in by]).add("lag", T.IntegerType()).add("pairs", T.LongType()).add("autocorr", T.DoubleType())
    return rows.groupBy(*by).applyInArrow(correlate, schema)


def known_leaks(columns: Sequence[str], target: str) -> list[str]:
    return [c for c in columns if c != target and any(p in c for p in LEAK_PATTERNS)]


def leakage_correlation(df: DataFrame, features: Sequence[str], target: str, top: int = 5, least=10, limit=0.5) -> DataFrame:
    """Rank correlation of features with the target, strongest first.

    Features with the name of a known leak are listed before the others, also beyond `top`, and
    are suspicious whatever their correlation.
    """
    leaks = known_leaks(features, target)
    rows = written(df.select(F.col(target).alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
                   .filter(F.col("y").isNotNull()))
    counts = rows.agg(*[count_if(F.col(f"x{i}").isNull()) for i in range(len(features))], F.count("*")).first()
    nulls, n = counts[:-1], counts[-1]
    whole = [i for i, n in enumerate(nulls) if not n]
    holed = [i for i, n in enumerate(nulls) if n]
    parts = []
    if n > GROUP_ROWS:
        # one feature at a time, whose files go before the next
        spark, ranked = df.sparkSession, rows
        if whole:
            with scratch(spark):
                ranked = with_rank(rows.select(F.lit(0).alias("_all"), "y", *[f"x{i}" for i in whole]), "y", ["_all"], "b")
                ranked = outlive(written(ranked.select(average_rank("b").alias("_b"), *[f"x{i}" for i in whole])))
        for i in [*whole, *holed]:
            with scratch(spark):
                if i in whole:
                    r = with_rank(ranked.select(F.lit(0).alias("_all"), "_b", F.col(f"x{i}").alias("x")), "x", ["_all"], "a")
                    score = F.coalesce(corr(average_rank("a"), F.col("_b")), F.lit(0.0))
                else:
                    pairs = rows.select(F.lit(0).alias("_all"), "y", F.col(f"x{i}").alias("x")).filter(F.col("x").isNotNull())
                    r, score = with_ranks(pairs, {"a": "x", "b": "y"}, ["_all"]), spearman("a", "b")
                pairs, score = r.agg(F.count("*"), score).first()
            if pairs:
                parts.append(spark.range(1).select(F.lit(i).alias("_f"), F.lit(pairs).cast("bigint").alias("pairs"), F.lit(score).alias("correlation")))
        if whole:
            forget(ranked)
        whole, holed = [], [] if parts else holed
    if whole:
        # the same rows count for these features, so the target is ranked once
        ranked = with_rank(rows.select(F.lit(0).alias("_all"), "y", *[f"x{i}" for i in whole]), "y", ["_all"], "b")
        cells = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f"x{i}").alias("x")) for i in whole])
        r = with_rank(ranked.select(average_rank("b").alias("_b"), F.inline(cells)), "x", ["_f"], "a")
        parts.append(r.groupBy("_f").agg(F.count("*").alias("pairs"), F.coalesce(corr(average_rank("a"), F.col("_b")), F.lit(0.0)).alias("correlation")))
    if holed:
        cells = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f"x{i}").alias("x")) for i in holed])
        r = with_ranks(rows.select("y", F.inline(cells)).filter(F.col("x").isNotNull()), {"a": "x", "b": "y"}, ["_f"])
        parts.append(r.groupBy("_f").agg(F.count("*").alias("pairs"), spearman("a", "b").alias("correlation")))
    scored = reduce(DataFrame.unionByName, parts)
    names = F.array(*[F.lit(c) for c in features])
    scored = scored.select(F.element_at(names, F.col("_f") + 1).alias("feature"), "pairs", "correlation")
    return (
        scored.withColumn("known_leak", F.col("feature").isin(leaks))
        .filter((F.col("pairs") > least) | F.col("known_leak"))
        .withColumn("suspicious", F.col("known_leak") | (F.abs("correlation") > limit))
        .orderBy(F.col("known_leak").desc(), F.abs("correlation").desc(), "feature")
        .limit(top + len(leaks))
        .drop("known_leak")
    )


def pearson_ranking(df: DataFrame, features: Sequence[str], target: str, top: int = 20) -> DataFrame:
    """Linear correlation with the target, all features in one pass."""
    stats = df.agg(*[corr(c, target).alias(f"c_{c}") for c in features])
    rows = _rows_per_column(stats, features, {"correlation": "c_"}).filter(F.col("correlation").isNotNull())
    size = F.abs("correlation")
    level = F.when(size > 0.95, "identical").when(size > 0.8, "severe").when(size > 0.5, "suspicious").otherwise("ok")
    return rows.withColumn("level", level).orderBy(size.desc(), "column_name").limit(top)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per pair of columns (the upper triangle), in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    stats = df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return stats.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)])))


def _shuffled_pairs(here: DataFrame, seed: int, keys: Sequence[str], n: int) -> DataFrame:
    """Sums over the pairs of one seed, a row for each task.

    Hashes are even, so rows are dealt by the first bits of the hash, and counts by these bits tell which places
    a bucket holds: the rows of these places go to the same task. There both sides are put in order, and their rows pair up.
    """
    bits = min(max((n // BUCKET_ROWS).bit_length(), 1), 16)
    mixed = here.withColumn("_mixed", F.md5(F.concat_ws("|", F.lit(str(int(seed))), *keys)))
    bucket = F.shiftright(F.conv(F.substring("_mixed", 1, 4), 16, 10).cast("int"), 16 - bits).alias("b")
    # one row of bounded length
    counts = mixed.groupBy(bucket).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("b", "n"))).first()[0]
    held = np.zeros(2**bits, dtype=np.int64)
    for c in counts:
        held[c["b"]] = c["n"]
    upto = np.cumsum(held)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, y = batch["_rank"], batch["y_true"]
            place = batch["_place"].to_numpy() - 1
            mixed = np.frombuffer(b"".join(batch["_mixed"].to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
            zero = np.zeros(len(place), dtype=np.int64)
            for there, at, order, rest in ((False, np.searchsorted(upto, place, side="right"), place, zero),
                                           (True, mixed[:, 0] >> np.uint64(64 - bits), mixed[:, 0].view(np.int64), mixed[:, 1].view(np.int64))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), pa.array(np.full(len(place), there)), pa.array(order), pa.array(rest), rank, y],
                    names=["_bucket", "_there", "_order", "_rest", "_rank", "y_true"])

    middle = (n + 1) / 2.0

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        there, order, rest, rank, y = (rows[c].to_numpy() for c in ("_there", "_order", "_rest", "_rank", "y_true"))
        a, b = np.flatnonzero(~there), np.flatnonzero(there)
        a = a[np.argsort(order[a])]
        # buckets are the first bits of the unsigned hash, and go by place
        b = b[np.lexsort((rest[b].view(np.uint64), order[b].view(np.uint64)))]
        t, p, gain = (rank[a] - middle) / n, (rank[b] - middle) / n, np.sign(y[b]) * y[a]
        gain = gain[y[b] != 0]
        # gains that are all the same deviate by nothing
        mean = gain[0] + (gain - gain[0]).mean() if len(gain) else 0.0
        yield pa.RecordBatch.from_pydict({
            "together": [float((t * p).sum())], "spread": [float((t * t).sum())], "gains": [len(gain)], "mean": [float(mean)], "squares": [float(((gain - mean) ** 2).sum())]})

    cells = mixed.select("_place", F.unhex("_mixed").alias("_mixed"), "_rank", "y_true").mapInArrow(
        sides, "_bucket int, _there boolean, _order bigint, _rest bigint, _rank double, y_true double")
    return cells.repartition(-(-2 * n // TASK_ROWS), "_bucket").mapInArrow(pairs, "together double, spread double, gains bigint, mean double, squares double")


def null_model_shuffle(df: DataFrame, target="y_true", seeds=range(5), keys=("symbol", "date"), limit=0.07) -> DataFrame:
    """Forecast by a permutation of the target: nothing should be left.

    A seeded hash of the row key orders the rows; the row at a place receives
    the target of the row at that place of the shuffled order.  Both sides hold the same values, so
    ranks are found once, before anything is copied for the seeds; seeds come one after the other, and the files of
    a step go before the next.
    """
    spark, keys, scores = df.sparkSession, list(keys), []
    rows = df.select(*keys, finite(target).cast("double").alias("y_true")).filter(F.col("y_true").isNotNull()).withColumn("_all", F.lit(0))
    with scratch(spark):
        with scratch(spark):
            ranked = with_rank(rows, "y_true", ["_all"], "r")
            ranked = outlive(written(ranked.select(*keys, "_all", "y_true", average_rank("r").alias("_rank"))))
        with scratch(spark):
            # places by key are those of every seed
            here = outlive(written(running(ranked, ["_all"], keys, {"_place": ("count", "y_true")}, written).drop("_all")))
        forget(ranked)
        n = here.count()
        for seed in seeds if n else ():
            with scratch(spark):
                parts = written(_shuffled_pairs(here, seed, keys, n))
                gains, level = F.col("gains"), parts.filter("gains > 0").agg(F.min("mean")).first()[0]
                away, total = F.col("mean") - F.lit(level).cast("double"), F.sum("gains")
                sums = parts.agg(F.sum("together").alias("together"), F.sum("spread").alias("spread"), total.alias("gains"),
                                 F.try_divide(F.sum(gains * away), total).alias("away")).first()
                away = away - F.lit(sums["away"]).cast("double")
                squares = parts.agg(F.sum(F.col("squares") + gains * away * away)).first()[0]
            std = np.sqrt(squares / sums["gains"]) if sums["gains"] else None
            sharpe = None if std is None else float((level + sums["away"]) / std * np.sqrt(252)) if std else 0.0
            scores.append((sums["together"] / sums["spread"] if sums["spread"] else 0.0, sharpe))
    return spark.createDataFrame(scores, "ic double, sharpe double").agg(
        F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"),
        F.avg("sharpe").alias("sharpe_mean"), F.stddev_pop("sharpe").alias("sharpe_std"),
        (F.abs(F.avg("ic")) < limit).alias("passed"))


def null_model_constant(df: DataFrame, by=("symbol",)) -> DataFrame:
    """A forecast of zero must not trade."""
    r = evaluate_policy(df.withColumn("y_pred", F.lit(0.0)), by, "long_short", ranks=False)
    return r.select(*by, "trade_count", "total_return",
                    ((F.col("trade_count") == 0) | (F.abs("total_return") < 0.01)).alias("passed"))


def null_model_perfect(df: DataFrame, by=("symbol",)) -> DataFrame:
    """The target as its own forecast must score perfectly."""
    r = evaluate_policy(df.withColumn("y_pred", F.col("y_true")), by, "long_short")
    return r.select(*by, "ic", "hit_rate", ((F.col("ic") > 0.99) & (F.col("hit_rate") > 0.99)).alias("passed"))


def check_row(name: str, value: Column, passed: Column) -> list[Column]:
    return [F.lit(name).alias("check"), value.cast("double").alias("value"), passed.alias("passed")]


def sanity_suite(df: DataFrame, folds: DataFrame, features: Sequence[str], target="y_true", by=("symbol",), shuffle=True) -> DataFrame:
    """All checks as rows `(check, value, passed, critical)`.

    `df` holds forecasts, `folds` an embargo audit.
    """
    from seriesmill.operators.alignment import quality_report

    spark, missing, found = df.sparkSession, F.coalesce(F.max("missing_pct"), F.lit(0.0)), {}
    v = F.col("v")
    checks = {
        "embargo_ok": lambda df: (folds.agg(count_if(~F.col("passed")).alias("v")), v == 0),
        "missing_values": lambda df: (quality_report(df, features).agg(missing.alias("v")), v == 0),
        "enough_rows": lambda df: (df.agg(F.count("*").alias("v")), v > 252),
        "no_leakage_corr": lambda df: (leakage_correlation(df, features, target, len(features)).agg(count_if(F.col("suspicious")).alias("v")), v == 0),
        "autocorr_checked": lambda df: (target_autocorr(df, target, 1, by).agg(F.avg("autocorr").alias("v")), F.lit(True)),
        "constant_pred_ok": lambda df: (null_model_constant(df, by).agg(count_if(~F.col("passed")).alias("v")), v == 0),
        "perfect_pred_ok": lambda df: (null_model_perfect(df, by).agg(count_if(~F.col("passed")).alias("v")), v == 0),
    }
    if shuffle:
        checks["shuffled_ic_ok"] = lambda df: (null_model_shuffle(df, target).withColumn("v", F.col("ic_mean")), F.col("passed"))
    # each check is one row; its files go before the next
    with scratch(spark):
        for name, check in checks.items():
            with scratch(spark):
                if name == "missing_values":  # read by this check and those after it
                    df = outlive(written(df))
                rows, passed = check(df)
                found[name] = tuple(rows.select(*check_row(name, v, passed)).first())
                del rows
    order = ["missing_values", "enough_rows", *[n for n in checks if n not in ("missing_values", "enough_rows")]]
    out = spark.createDataFrame([found[n] for n in order], "check string, value double, passed boolean")
    critical = F.col("check").isin("embargo_ok", "shuffled_ic_ok", "perfect_pred_ok", "missing_values")
    return out.withColumn("critical", critical)


def feature_health(df: DataFrame, features: Sequence[str], target: str, by=("symbol",)) -> DataFrame:
    """Unit root, persistence and signal per series and feature.

    The unit root test is a Dickey-Fuller regression without further lags and
    a fixed 5% critical value.
    """
    by = list(by)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
    key = [*by, "feature"]
    s, whole = Series(key), Window.partitionBy(*key)
    long = df.select(*by, "date", F.col(target).alias("y"), F.inline(cells)).filter(F.col("x").isNotNull())
    long = long.withColumns({"_x1": s.lag("x", 1), "_m": F.avg("x").over(whole)})
    long = long.withColumn("_dx", F.col("x") - F.col("_x1"))
    # signal looks at rows that also have a target
    long = long.withColumn("_xy", F.when(F.col("y").isNotNull(), F.col("x")))
    long = with_ranks(long, {"a": "_xy", "b": "y"}, key, is_series=True)
    a, b = F.col("x") - F.col("_m"), F.col("_x1") - F.col("_m")
    n = F.regr_count(F.col("_dx"), F.col("_x1"))
    sxx, syy = F.regr_sxx(F.col("_dx"), F.col("_x1")), F.regr_syy(F.col("_dx"), F.col("_x1"))
    r2 = F.regr_r2(F.col("_dx"), F.col("_x1"))
    error = F.sqrt(F.try_divide((1 - r2) * syy, (n - 2) * sxx))
    stats = long.groupBy(*key).agg(
        F.try_divide(F.regr_slope(F.col("_dx"), F.col("_x1")), error).alias("df_t"),
        F.try_divide(F.sum(a * b), F.sum(a * a)).alias("acf_1"),
        spearman("a", "b").alias("ic"),
    )
    stationary = F.coalesce(F.col("df_t") < DF_CRITICAL, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(~stationary, "Non-Stat"), F.when(F.col("acf_1") > 0.95, "RandomWalk"),
        F.when(F.abs("ic") < 0.01, "NoSignal")))
    return stats.withColumn("verdict", F.when(F.size(reasons) == 0, "PASS").otherwise(
        F.concat(F.lit("FAIL: "), F.array_join(reasons, ","))))


def extreme_targets(df: DataFrame, target="y_true", limit=0.5, by=()) -> DataFrame:
    y = F.col(target)
    return df.groupBy(*by).agg(
        count_if(y > 0).alias("positive"), count_if(y < 0).alias("negative"), F.min(y).alias("min_target"),
        F.max(y).alias("max_target"), count_if(F.abs(y) > limit).alias("extreme"))


def value_anomalies(df: DataFrame, columns: Sequence[str], few: int = 10, bins: int = 10) -> DataFrame:
    """Values, distinct ones, infinities, moments, exact quartiles and counts in equal bins per column.

    Bins `bin_0`.. lie between the smallest and the largest finite value and are closed on the right, the first one also on
    the left.  Rows are written once; what is fetched is one row for all columns.
    """
    spark, inf = df.sparkSession, F.lit(float("inf"))
    rows = written(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    release(spark)
    aggs = []
    for c in columns:
        v = F.col(c)
        aggs += [F.count(v).alias(f"n_{c}"), count_if(F.abs(v) == inf).alias(f"i_{c}"), F.avg(v).alias(f"m_{c}"), F.stddev_samp(v).alias(f"s_{c}"),
                 F.min(v).alias(f"lo_{c}"), F.max(v).alias(f"hi_{c}"), F.min(finite(v)).alias(f"from_{c}"), F.max(finite(v)).alias(f"to_{c}")]
    stats = rows.agg(*aggs).first().asDict()
    for c in columns:
        # one column at a time, so that only its values are shuffled at once
        stats[f"d_{c}"] = rows.agg(F.count_distinct(c)).first()[0]
        release(spark)
    upto = []
    for c in columns:
        low, high = stats.pop(f"from_{c}"), stats.pop(f"to_{c}")
        for k in range(bins):
            edge = None if low is None else high if k + 1 == bins else low + (k + 1) * ((high - low) / bins)
            upto.append(count_if(F.col(c).between(F.lit(low).cast("double"), F.lit(edge).cast("double"))).alias(f"{k}_{c}"))
    upto = rows.agg(*upto).first()
    for c in columns:
        for k in range(bins):
            stats[f"b{k}_{c}"] = upto[f"{k}_{c}"] - (upto[f"{k - 1}_{c}"] if k else 0)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("x")) for c in columns])
    quartiles = quantiles(rows.select(F.inline(cells)), "x", ["column_name"], {"p25": 0.25, "median": 0.5, "p75": 0.75})
    one = spark.range(1).select(*[F.lit(v).cast("bigint" if isinstance(v, int) else "double").alias(k) for k, v in stats.items()])
    out = _rows_per_column(one, columns, {
        "n_values": "n_", "distinct_values": "d_", "infinite": "i_", "mean": "m_", "std": "s_", "min_value": "lo_", "max_value": "hi_",
        **{f"bin_{k}": f"b{k}_" for k in range(bins)}})
    return out.withColumn("few_values", F.col("distinct_values") < few).join(quartiles, "column_name", "left")


def value_histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Counts in equal bins between minimum and maximum of each column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])
    limits = df.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in columns],
                    *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns])
    # a broadcast of one row a column; values are counted by bin before any shuffle
    limits = F.broadcast(_rows_per_column(limits, columns, {"lo": "lo_", "hi": "hi_"}))
    values = df.select(F.inline(cells)).filter(F.col("x").isNotNull())
    width = F.floor(F.try_divide((F.col("x") - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    place = F.coalesce(F.least(width, F.lit(bins - 1)), F.lit(0)).cast("int")
    return values.join(limits, "column_name").groupBy("column_name", place.alias("bin")).agg(F.count("*").alias("count"))


def range_check(df: DataFrame, expected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments next to expected limits `(column_name, min_ok, max_ok, mean_low, mean_high)`."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"),
                 F.stddev_samp(c).alias(f"s_{c}")]
    got = _rows_per_column(df.agg(*aggs), columns, {"mean": "m_", "min_value": "lo_", "max_value": "hi_", "std": "s_"})
    inside = ((F.col("min_value") >= F.col("min_ok")) & (F.col("max_value") <= F.col("max_ok"))
              & F.col("mean").between(F.col("mean_low"), F.col("mean_high")))
    return got.join(expected, "column_name").select("column_name", "mean", "min_value", "max_value", "std", inside.alias("passed"))
