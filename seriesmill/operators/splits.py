"""Embargoed splits, walk-forward folds, sequences and scalers.

Positions count rows per series.  Split bounds are windows over the same
series, fold tables hold one row per fold, so nothing is range-joined.
"""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.columns import Series, count_if, flag, float_ratio

#: fixed rows per month and year of a frequency
ROWS = {"daily": (21, 252), "monthly": (1, 12)}
EMBARGO = {"daily": 21, "monthly": 1}


def _date(text: str):
    return F.lit(text).cast("date")


def static_bounds(
    panel: DataFrame, test_start: str, train_years=10, val_months=6, embargo=None,
    train_start: str | None = None, frequency="daily", by=("symbol",),
) -> DataFrame:
    """One row per series: first and last position of every split, or why not."""
    month, year = ROWS[frequency]
    gap = EMBARGO[frequency] if embargo is None else embargo
    pos = panel.withColumn("_p", Series(by).position() - 1)
    first_test = F.min(F.when(F.col("date") >= _date(test_start), F.col("_p")))
    first_train = F.min(F.when(F.col("date") >= _date(train_start or "0001-01-01"), F.col("_p")))
    b = pos.groupBy(*by).agg(
        first_test.alias("test_lo"), (F.count("*") - 1).cast("int").alias("test_hi"), first_train.alias("_start"))
    b = b.withColumn("val_hi", F.col("test_lo") - gap - 1)
    b = b.withColumn("val_lo", F.greatest(F.lit(0), F.col("val_hi") - val_months * month + 1))
    b = b.withColumn("train_hi", F.col("val_lo") - gap - 1)
    rolling = F.greatest(F.lit(0), F.col("train_hi") - train_years * year + 1)
    b = b.withColumn("train_lo", F.col("_start") if train_start else rolling)
    reason = (
        F.when(F.col("test_lo").isNull(), "no test rows")
        .when(F.col("val_hi") < 0, "no room before test")
        .when(F.col("train_hi") < 0, "no room before validation")
        .when(F.col("train_lo").isNull() | (F.col("train_lo") > F.col("train_hi")), "no training rows")
    )
    return b.select(*by, "train_lo", "train_hi", "val_lo", "val_hi", "test_lo", "test_hi", reason.alias("problem"))


def static_split(panel: DataFrame, test_start: str, by=("symbol",), **options) -> DataFrame:
    """Panel with `position` and `split`; embargoed and older rows are left out,
    as are series with too little data (see `static_bounds`)."""
    bounds = static_bounds(panel, test_start, by=by, **options).filter(F.col("problem").isNull())
    pos = panel.withColumn("position", Series(by).position() - 1).join(bounds, list(by))
    p = F.col("position")
    split = (
        F.when(p.between(F.col("train_lo"), F.col("train_hi")), "train")
        .when(p.between(F.col("val_lo"), F.col("val_hi")), "val")
        .when(p >= F.col("test_lo"), "test")
    )
    return pos.withColumn("split", split).filter(F.col("split").isNotNull()).drop(
        "train_lo", "train_hi", "val_lo", "val_hi", "test_lo", "test_hi", "problem")


def walk_forward_folds(
    panel: DataFrame, start: str, train_years=10, val_months=6, embargo=None, step_months=1,
    train_start: str | None = None, frequency="daily", by=("symbol",),
) -> DataFrame:
    """Fold table: positions and dates of train, val and test per fold.

    Test windows are consecutive spans of `step_months` from `start`; in months
    shorter than its day a span starts on the last day.  A row knows its window
    by month arithmetic, so windows are found by one grouping.
    Windows without rows or without room before them get no fold number.
    """
    month, year = ROWS[frequency]
    gap = EMBARGO[frequency] if embargo is None else embargo
    by = list(by)
    s = Series(by)
    first = _date(start)
    months = (F.year("date") - F.year(first)) * 12 + F.month("date") - F.month(first)
    starts_on = F.least(F.dayofmonth(first), F.dayofmonth(F.last_day("date")))
    months = months - F.when(F.dayofmonth("date") < starts_on, 1).otherwise(0)
    dated = panel.select(*by, "date").withColumns(
        {"_p": s.position() - 1,
         "_w": F.when(F.col("date") >= first, F.floor(months / F.lit(step_months)))})
    starts = F.min(F.when(F.col("date") >= _date(train_start), F.col("_p"))).over(s.whole) if train_start else F.lit(0)
    dated = dated.withColumn("_start", starts)
    w = dated.filter(F.col("_w").isNotNull()).groupBy(*by, "_w").agg(
        F.min("_p").alias("test_lo"), F.max("_p").alias("test_hi"), F.first("_start").alias("_start"))
    before_test = F.col("test_lo") - gap - 1
    if val_months:
        w = w.withColumn("val_hi", before_test)
        w = w.withColumn("val_lo", F.greatest(F.lit(0), F.col("val_hi") - val_months * month + 1))
        w = w.filter("val_hi >= 0").withColumn("train_hi", F.col("val_lo") - gap - 1)
    else:
        w = w.withColumns({"val_lo": F.lit(None).cast("int"), "val_hi": F.lit(None).cast("int"), "train_hi": before_test})
    rolling = F.greatest(F.lit(0), F.col("train_hi") - train_years * year + 1)
    w = w.withColumn("train_lo", F.col("_start") if train_start else rolling)
    w = w.filter((F.col("train_hi") >= 0) & (F.col("train_lo") <= F.col("train_hi")))
    w = w.withColumn("fold_id", F.row_number().over(Window.partitionBy(*by).orderBy("_w")) - 1)
    bounds = ["train_lo", "train_hi", "val_lo", "val_hi", "test_lo", "test_hi"]
    # dates of the positions, by one equi-join on (series, position)
    marks = w.select(*by, "fold_id", F.posexplode(F.array(*bounds)).alias("_i", "_p")).join(
        dated.select(*by, "_p", "date"), [*by, "_p"], "left")
    dates = marks.groupBy(*by, "fold_id").agg(
        *[F.max(F.when(F.col("_i") == i, F.col("date"))).alias(f"{b}_date") for i, b in enumerate(bounds)])
    counts = {
        "n_train": F.col("train_hi") - F.col("train_lo") + 1,
        "n_val": F.coalesce(F.col("val_hi") - F.col("val_lo") + 1, F.lit(0)),
        "n_test": F.col("test_hi") - F.col("test_lo") + 1,
    }
    return w.select(*by, "fold_id", *bounds).withColumns(counts).join(dates, [*by, "fold_id"])


def with_folds(panel: DataFrame, folds: DataFrame, by=("symbol",), splits=("train", "val", "test")) -> DataFrame:
    """Panel rows with their `position` and `_in`, the (fold_id, split) that hold the row; rows of no fold are left out.

    A row meets the spans of its series, which the calendar bounds, as one array; neither rows nor positions are copied for the folds.
    """
    by = list(by)
    spans = F.array(*[F.struct(F.col("fold_id"), F.lit(s).alias("split"), F.col(f"{s}_lo").alias("lo"), F.col(f"{s}_hi").alias("hi")) for s in splits])
    held = folds.select(*by, F.inline(spans)).filter(F.col("lo").isNotNull()).groupBy(*by).agg(
        F.collect_list(F.struct("fold_id", "split", "lo", "hi")).alias("_spans"))
    own = F.filter("_spans", lambda x: F.col("position").between(x["lo"], x["hi"]))
    rows = panel.withColumn("position", Series(by).position() - 1).join(held, by)
    rows = rows.withColumn("_in", F.transform(own, lambda x: F.struct(x["fold_id"].alias("fold_id"), x["split"].alias("split"))))
    rest = [c for c in panel.columns if c not in by]
    return rows.filter(F.size("_in") > 0).select(*by, "position", *rest, "_in")


def copied(rows: DataFrame) -> DataFrame:
    """A row of `with_folds` once for each of its folds."""
    return rows.select(*[c for c in rows.columns if c != "_in"], F.inline("_in"))


def fold_rows(panel: DataFrame, folds: DataFrame, by=("symbol",), splits=("train", "val", "test")) -> DataFrame:
    """Rows of every fold and split (each row once per fold that holds it)."""
    return copied(with_folds(panel, folds, by, splits))


def embargo_check(folds: DataFrame, embargo=21) -> DataFrame:
    """Gaps between consecutive splits in rows, and whether they suffice."""
    has_val = F.col("val_lo").isNotNull()
    first = F.when(has_val, F.col("val_lo")).otherwise(F.col("test_lo")) - F.col("train_hi") - 1
    second = F.when(has_val, F.col("test_lo") - F.col("val_hi") - 1)
    return folds.withColumns({"gap_after_train": first, "gap_after_val": second}).withColumn(
        "passed", (first >= embargo) & F.coalesce(second >= embargo, F.lit(True)))


def embargo_audit(folds: DataFrame, embargo=21, by=("symbol",)) -> DataFrame:
    """Per fold: gap train to test, ordering and overlap."""
    gap = F.col("test_lo") - F.col("train_hi") - 1
    overlap = F.greatest(
        F.lit(0),
        F.least("train_hi", "test_hi") - F.greatest("train_lo", "test_lo") + 1)
    return folds.select(
        *by, "fold_id", F.col("train_lo_date").alias("train_start"), F.col("train_hi_date").alias("train_end"),
        F.col("test_lo_date").alias("test_start"), F.col("test_hi_date").alias("test_end"), "n_train", "n_test",
        gap.alias("gap"), (gap >= embargo).alias("embargo_ok"),
        (F.col("train_hi_date") < F.col("test_lo_date")).alias("date_ok"), overlap.alias("overlap"),
        ((gap >= embargo) & (F.col("train_hi_date") < F.col("test_lo_date")) & (overlap == 0)).alias("passed"),
    )


def tuning_folds(
    panel: DataFrame, tune_start: str, tune_end: str, train_years=5, val_months=6, step_months=6,
    embargo=21, max_folds=10, least_train=100, least_val=20, frequency="daily", by=("symbol",),
) -> DataFrame:
    """First usable folds inside the tuning window, at most `max_folds` each.

    A series without any falls back to one static split (fold_id -1).
    """
    by = list(by)
    inside = panel.filter(F.col("date").between(_date(tune_start), _date(tune_end)))
    months = train_years * 12 + val_months
    year, month = int(tune_start[:4]), int(tune_start[5:7]) - 1 + months
    year, month = year + month // 12, month % 12 + 1
    start = f"{year:04d}-{month:02d}-{min(int(tune_start[8:10]), monthrange(year, month)[1]):02d}"
    folds = walk_forward_folds(
        inside, start, train_years, val_months, embargo, step_months, frequency=frequency, by=by)
    ok = folds.filter((F.col("n_train") > least_train) & (F.col("n_val") > least_val)
                      & (F.col("val_hi_date") <= _date(tune_end)))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("fold_id"))
    bounds = ["train_lo", "train_hi", "val_lo", "val_hi"]
    kept = ok.withColumn("_k", place).filter(F.col("_k") <= max_folds).select(*by, "fold_id", *bounds)
    fallback = static_bounds(inside, start, train_years, val_months, embargo, frequency=frequency, by=by)
    missing = fallback.filter(F.col("problem").isNull()).join(kept.select(*by).distinct(), by, "left_anti")
    return kept.unionByName(missing.select(*by, F.lit(-1).alias("fold_id"), *bounds))


def train_plus_val(rows: DataFrame, split="split") -> DataFrame:
    return rows.withColumn(split, F.when(F.col(split) == "val", "train").otherwise(F.col(split)))


def train_val_cut(rows: DataFrame, share=0.8, by=("symbol",), split="split") -> DataFrame:
    """Cut training rows of a series by position into train and val."""
    by = list(by)
    w = Window.partitionBy(*by, split)
    place = F.row_number().over(w.orderBy("date"))
    last = F.floor(F.count("*").over(w) * share)
    late = (F.col(split) == "train") & (place > last)
    return rows.withColumn("_late", late).withColumn(
        split, F.when(F.col("_late"), "val").otherwise(F.col(split))).drop("_late")


def make_sequences(rows: DataFrame, features: Sequence[str], steps: int, by=("symbol", "split"), out="sequence") -> DataFrame:
    """Arrays of the last `steps` feature rows, never across the keys in `by`."""
    w = Series(by).frame(steps)
    seq = F.collect_list(F.array(*features)).over(w)
    return rows.withColumn(out, seq).filter(F.size(out) == steps)


def _trained(rows: DataFrame, split: str, strict: bool) -> DataFrame:
    """Rows that training statistics are taken from; without the others a fold that has none gets no statistics."""
    return rows.filter(F.col(split) == "train") if strict else rows


def fold_scaler(rows: DataFrame, features: Sequence[str], by=("fold_id",), split="split", strict=False) -> DataFrame:
    """Standardise with mean and population deviation of training rows only.

    A deviation of 0 counts as 1 and folds without training rows are missing values. `strict` takes the
    formula as it is: such folds are left out, and 0 divides as floats do.
    """
    by = list(by)
    train = F.col(split) == "train"
    stats = _trained(rows, split, strict).groupBy(*by).agg(
        *[F.avg(F.when(train, F.col(c))).alias(f"_m_{c}") for c in features],
        *[F.stddev_pop(F.when(train, F.col(c))).alias(f"_s_{c}") for c in features],
    )
    def over(c: str):
        gap, std = F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")
        return float_ratio(gap, std) if strict else gap / F.when(std == 0, 1.0).otherwise(std)

    scaled = {c: over(c) for c in features}
    return rows.join(stats, by).withColumns(scaled).select(*rows.columns)


def target_scaler(rows: DataFrame, target="y_true", mode="standardize", by=("fold_id",), split="split", strict=False) -> DataFrame:
    """Add `y_mean`, `y_std` of training rows and the scaled target `y_scaled`.

    A missing or tiny deviation counts as 1 and folds without training rows are missing values. `strict`
    takes the formula as it is: such folds are left out, one training row has no deviation, 0 divides as floats do.
    """
    by = list(by)
    y = F.when(F.col(split) == "train", F.col(target))
    std = F.stddev_samp(y)
    if not strict:
        std = F.coalesce(std, F.lit(1.0))
        std = F.when(std < 1e-8, 1.0).otherwise(std)
    mean = F.avg(y) if mode == "standardize" else F.lit(0.0)
    stats = _trained(rows, split, strict).groupBy(*by).agg(mean.alias("y_mean"), std.alias("y_std"))
    return rows.join(stats, by).withColumn("y_scaled", float_ratio(F.col(target) - F.col("y_mean"), "y_std"))


def inverse_target(df: DataFrame, pred="y_pred") -> DataFrame:
    return df.withColumn(pred, F.col(pred) * F.col("y_std") + F.col("y_mean"))


def sample_weights(df: DataFrame, target="y_true", alpha=4.0, threshold=0.03, out="weight") -> DataFrame:
    return df.withColumn(out, 1.0 + alpha * flag(F.abs(target) > threshold))


def class_weight(df: DataFrame, label="label", by=(), none=1.0) -> DataFrame:
    """Negatives per positive, `none` without positives."""
    pos = count_if(F.col(label) == 1)
    return df.groupBy(*by).agg(
        F.when(pos == 0, none).otherwise((F.count("*") - pos) / F.nullif(pos, F.lit(0))).alias("pos_weight"))
