"""Ranks and exact quantiles of groups of any size.

A plain ranking window sorts a whole group in one task.  Here rows are dealt by range of (group,
value) and, within equal values, by row, so that neither a large group nor a value that many rows
share makes a large task.  Rows are ranked within their piece.  What lies before a piece, and how far
a value goes on into its neighbours, follows from prefix sums over the pieces of a group, at most
two rows a piece, which are broadcast.  Ranks thus come back by position; nothing is joined by value.

`value_counts` is for callers that want one row for each distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.columns import corr
from seriesmill.functions.lineage import forget, outlive, scratch, written
from seriesmill.functions.prefix import PIECE, continued, dealt, running

#: rows of a group that one task ranks
GROUP_ROWS = 1_000_000
#: share of the rows of a group, as its inverse, by which a first guess of a quantile may be off
ACCURACY = 10_000


def value_counts(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """One row per (group, distinct value): `ties` and `below`, the rows of the group with a smaller value.

    Groups must not be null.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    summed = running(counts, by, [value], {"_upto": ("sum", "ties")})
    return summed.select(*by, value, "ties", (F.col("_upto") - F.col("ties")).alias("below"))


def _same(by: Sequence[str], left: str, right: str) -> Column:
    cond = F.col(f"{left}.{PIECE}") == F.col(f"{right}.{PIECE}")
    for k in by:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _neighbours(pieces: DataFrame, value: str, by: list[str]) -> DataFrame:
    """For each piece of a group that has several: rows before it, and where its end values begin and end.

    `_before` and `_rows` count rows of the group; `_low` and `_high` are the end values of the
    piece, `_low_from` the rows below the first, `_high_to` the rows up to the second, in the group.
    """
    groups = continued(pieces, by) if by else pieces.select(F.lit(1).alias("_any")).limit(1)
    known = pieces.filter(F.col(value).isNotNull()).select(PIECE, *by, value)
    same_group = F.lit(True)
    for k in by:
        same_group = same_group & F.col(f"p.{k}").eqNullSafe(F.col(f"g.{k}"))
    if by:
        known = known.alias("p").join(F.broadcast(groups.alias("g")), same_group, "left_semi")
    bounds = known.groupBy(PIECE, *by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    held = known.alias("p").join(F.broadcast(bounds.alias("b")), _same(by, "p", "b"))
    v = F.col(f"p.{value}")
    counts = held.groupBy(*[F.col(f"p.{k}").alias(k) for k in (PIECE, *by)]).agg(
        F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.count("*").alias("_n"),
        F.count_if(v == F.col("_low")).alias("_n_low"), F.count_if(v == F.col("_high")).alias("_n_high"))
    order = Window.partitionBy(*by).orderBy(PIECE)
    earlier, later = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    single = F.col("_low") == F.col("_high")
    counts = counts.withColumns({
        "_before": F.sum("_n").over(earlier) - F.col("_n"), "_rows": F.sum("_n").over(Window.partitionBy(*by)),
        "_goes_back": F.coalesce(F.lag("_high").over(order) == F.col("_low"), F.lit(False)),
        "_goes_on": F.coalesce(F.lead("_low").over(order) == F.col("_high"), F.lit(False))})
    # a piece of one value that goes on has no begin (or end) of its own for it
    counts = counts.withColumns({
        "_begin": F.when(~(single & F.col("_goes_back")), F.col("_before") + F.col("_n") - F.col("_n_high")),
        "_end": F.when(~(single & F.col("_goes_on")), F.col("_before") + F.col("_n_low"))})
    counts = counts.withColumns({"_begin": F.last("_begin", ignorenulls=True).over(earlier), "_end": F.first("_end", ignorenulls=True).over(later)})
    return counts.select(
        PIECE, *by, "_before", "_rows", "_low", "_high",
        F.when(F.col("_goes_back"), F.lag("_begin").over(order)).otherwise(F.col("_before")).alias("_low_from"),
        F.when(F.col("_goes_on"), F.lead("_end").over(order)).otherwise(F.col("_before") + F.col("_n")).alias("_high_to"),
    )


def _by_position(df: DataFrame, value: str, by: list[str], prefix: str) -> DataFrame:
    """`df` with the ranks of one value."""
    names = df.columns
    # the row number spreads rows of one value; ranks do not depend on it
    pieces = dealt(df.withColumn("_row", F.monotonically_increasing_id()), by, [value, "_row"], written)
    inside = Window.partitionBy(PIECE, *by)
    v = F.col(value)
    local = pieces.withColumns({
        "_upto": F.count(v).over(inside.orderBy(value)), "_same": F.count(v).over(Window.partitionBy(PIECE, *by, value)), "_here": F.count(v).over(inside)})
    joined = local.alias("r").join(F.broadcast(_neighbours(pieces, value, by).alias("n")), _same(by, "r", "n"), "left")
    v, before = F.col(f"r.{value}"), F.coalesce("_before", F.lit(0))
    below = F.when(v == F.col("_low"), F.col("_low_from")).otherwise(before + F.col("_upto") - F.col("_same"))
    upto = F.when(v == F.col("_high"), F.col("_high_to")).otherwise(before + F.col("_upto"))
    return joined.select(
        *[F.col(f"r.`{c}`") for c in names],
        *[F.when(v.isNotNull(), x).alias(f"{prefix}_{c}") for c, x in (("below", below), ("ties", upto - below), ("total", F.coalesce("_rows", "_here")))])


def _window_ranks(df: DataFrame, values: dict[str, str], by: Sequence[str]) -> DataFrame:
    group = ", ".join(f"`{k}`" for k in by) or "0"
    cells = []
    for prefix, value in values.items():
        v = f"`{value}`"
        known = f"CASE WHEN {v} IS NOT NULL THEN"
        cells += [
            f"{known} CAST(rank() OVER (PARTITION BY {group} ORDER BY {v} ASC NULLS LAST) - 1 AS BIGINT) END AS {prefix}_below",
            f"{known} count({v}) OVER (PARTITION BY {group}, {v}) END AS {prefix}_ties",
            f"{known} count({v}) OVER (PARTITION BY {group}) END AS {prefix}_total",
        ]
    return df.selectExpr("*", *cells)


def with_ranks(df: DataFrame, values: dict[str, str], by: Sequence[str], *, is_series: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add `<prefix>_below`, `<prefix>_ties`, `<prefix>_total` per {prefix: value}.

    Rows whose value is null get nulls.  `is_series=True` promises that a group
    is (part of) one dated series and so is bounded by the calendar; then
    ranking windows are used.  Otherwise the rows are written, so that all counts see the same
    values, and their groups counted: with at most `group_rows` rows in each, windows serve as well;
    beyond that rows are dealt by range and written once for each value.
    """
    by = list(by)
    if is_series:
        return _window_ranks(df, values, by)
    # counted, and dealt by range, which looks at the rows twice
    out = written(df)
    largest = out.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= group_rows:
        return _window_ranks(out, values, by)
    *first, (prefix, value) = values.items()
    for early, its_value in first:
        # the files of one ranking go before the next
        with scratch(df.sparkSession):
            pieces = _by_position(out, its_value, by, early)
            forget(out)
            out = outlive(written(pieces))
    pieces = _by_position(out, value, by, prefix)
    forget(out)
    out = pieces
    added = [f"{p}_{c}" for p in values for c in ("below", "ties", "total")]
    return out.select(*df.columns, *added)


def with_rank(df, value, by, prefix, *, is_series=False, group_rows=GROUP_ROWS) -> DataFrame:
    return with_ranks(df, {prefix: value}, by, is_series=is_series, group_rows=group_rows)


def average_rank(prefix: str) -> Column:
    return F.col(f"{prefix}_below") + (F.col(f"{prefix}_ties") + 1) / 2.0


def spearman(x_prefix: str, y_prefix: str) -> Column:
    """Aggregate: rank correlation of two ranked columns, 0 when undefined."""
    return F.coalesce(corr(average_rank(x_prefix), average_rank(y_prefix)), F.lit(0.0))


def quantile(value: str, prefix: str, p: float) -> Column:
    """Aggregate: linearly interpolated quantile of a ranked column.

    Only conditional maxima are needed, so it combines before the shuffle.
    """
    v, below, ties = f"`{value}`", f"{prefix}_below", f"{prefix}_ties"
    place = f"round({float(p)!r}D * ({prefix}_total - 1), 9)"

    def at(i: str) -> str:
        return f"max(CASE WHEN {below} <= {i}({place}) AND {i}({place}) < {below} + {ties} THEN {v} END)"

    low, high = at("floor"), at("ceil")
    return F.expr(f"{low} + ({high} - {low}) * max({place} - floor({place}))")


def quantiles(df: DataFrame, value: str, by: Sequence[str], places: dict[str, float], *, accuracy: int = ACCURACY) -> DataFrame:
    """Exact, linearly interpolated quantiles {name: share} of groups of any size, one row a group.

    Rows are read twice and never shuffled or written, which serves rows that are copies made while reading.
    The first reading guesses limits around each quantile.  The second counts the values between
    limits one by one and those elsewhere together, so the places of the quantiles are exact.  Where the rows
    at a place are not between its limits, and where NaN or wide integers are among the values, rows are ranked.
    """
    by = list(by)
    ranked = lambda: with_rank(df, value, by, "g").groupBy(*by).agg(*[quantile(value, "g", p).alias(c) for c, p in places.items()])
    if dict(df.dtypes)[value] not in ("double", "float", "int", "smallint", "tinyint"):
        return ranked()
    v, off = F.col("_v"), 3.0 / accuracy
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    shares = [min(max(p + d, 0.0), 1.0) for p in places.values() for d in (-off, off)]
    guess = written(rows.groupBy(*by).agg(
        F.percentile_approx(F.nanvl(v, F.lit(None)), shares, accuracy).alias("_ends"), F.count_if(F.isnan(v)).alias("_nan")))
    if not guess.filter("_nan > 0").isEmpty():
        return ranked()
    limits = [(F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]) for i in range(len(places))]
    known = guess.filter(F.col("_ends").isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_ends")
    met = F.lit(True)
    for i, k in enumerate(by):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near, passed = F.lit(False), F.lit(0)
    for low, high in limits:
        near, passed = near | v.between(low, high), passed + (v > high).cast("int")
    # values between the same limits come after the others that are as far
    cells = rows.filter(v.isNotNull()).join(known, met).select(*by, passed.alias("_passed"), near.alias("_near"), F.when(near, v).alias("_v"))
    cells = written(cells.groupBy(*by, "_passed", "_near", "_v").agg(F.count("*").alias("g_ties")))
    order = Window.partitionBy(*by).orderBy("_passed", "_near", "_v")
    counted = cells.withColumns({
        "g_below": F.sum("g_ties").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("g_ties"),
        "g_total": F.sum("g_ties").over(Window.partitionBy(*by))})
    found = written(counted.groupBy(*by).agg(*[quantile("_v", "g", p).alias(c) for c, p in places.items()]))
    if not found.filter(reduce(or_, [F.col(c).isNull() for c in places])).isEmpty():
        return ranked()
    missing = guess.filter(F.col("_ends").isNull()).select(*by, *[F.lit(None).cast("double").alias(c) for c in places])
    return found.unionByName(missing)


def quantile_bin(prefix: str, bins: int | Column) -> Column:
    """Raw bin 0.. of a ranked row between interpolated quantile edges.

    Bins are closed on the right and include the lowest value.  An edge lies
    below a value exactly when its place lies before the first row holding that
    value, so the edges themselves are not needed.
    """
    below, total = F.col(f"{prefix}_below"), F.col(f"{prefix}_total")
    bins = F.lit(bins) if isinstance(bins, int) else bins
    # places are j * (total - 1) / bins; count those smaller than `below`
    passed = F.ceil(F.try_divide(below * bins, total - 1))
    return F.greatest(F.least(passed, bins) - 1, F.lit(0)).cast("int")
