"""Column helpers: null rules, rolling windows, compounding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

ColumnLike = str | Column


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: ColumnLike) -> Column:
    """NaN and +/-Inf become null, the only missing marker used here.

    NaN sorts above every number, so one comparison rejects it too.
    """
    c = as_col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def divide(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b with null for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(as_col(a), as_col(b))


def clip(c: ColumnLike, low: float, high: float) -> Column:
    """Clip that keeps nulls (least/greatest alone would skip them)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def flag(condition: Column) -> Column:
    """1/0 integer; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0).cast("int")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def mean_if(condition: Column, value: ColumnLike) -> Column:
    return F.avg(F.when(condition, as_col(value)))


def share(condition: Column) -> Column:
    """Fraction of rows for which the condition holds (null counts as false)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def safe_ratio(a: ColumnLike, b: ColumnLike, default: float = 0.0) -> Column:
    return F.coalesce(divide(a, b), F.lit(default))


def float_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b as floats divide: a zero divisor gives an infinity, 0 / 0 gives NaN (ANSI mode would raise)."""
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    by_zero = F.when(a.isNotNull(), F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def round6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles for output; tiny values become plain zero."""
    half = 0.5 * 10.0 ** -digits
    todo = set(columns)
    return df.select(
        *[
            F.when(F.abs(F.col(c)) < half, 0.0).otherwise(F.round(F.col(c), digits)).alias(c)
            if c in todo
            else F.col(c)
            for c in df.columns
        ]
    )


def corr(x: ColumnLike, y: ColumnLike) -> Column:
    """Aggregate: Pearson correlation, null when a side does not vary.

    The built-in one raises in ANSI mode for a constant column.
    """
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


class Series:
    """Windows along one series: rows of `by` in `order` order.

    All windows share partition and sort keys, so any number of expressions
    costs one exchange and one sort.
    """

    def __init__(self, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("date",)):
        self.by, self.order = tuple(by), tuple(order)

    @property
    def rows(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.by)

    @property
    def so_far(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def sql_rows(self) -> str:
        names = [", ".join(f"`{c}`" for c in cols) for cols in (self.by, self.order)]
        return f"(PARTITION BY {names[0]} ORDER BY {names[1]})"

    @property
    def sql_so_far(self) -> str:
        return self.sql_rows[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def frame(self, n: int) -> WindowSpec:
        return self.rows.rowsBetween(-(n - 1), 0)

    def lag(self, c: ColumnLike, n: int = 1) -> Column:
        return F.lag(as_col(c), n).over(self.rows)

    def lead(self, c: ColumnLike, n: int = 1) -> Column:
        return F.lead(as_col(c), n).over(self.rows)

    def change(self, c: ColumnLike, n: int) -> Column:
        return as_col(c) - self.lag(c, n)

    def pct(self, c: ColumnLike, n: int = 1) -> Column:
        return divide(c, self.lag(c, n)) - 1

    def rolling(
        self,
        agg: Callable[[Column], Column],
        c: ColumnLike,
        n: int,
        min_periods: int | None = None,
    ) -> Column:
        """Aggregate over the last n rows, null until enough values are there."""
        c, w = as_col(c), self.frame(n)
        return F.when(F.count(c).over(w) >= (min_periods or n), agg(c).over(w))

    def mean(self, c: ColumnLike, n: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.avg, finite(c), n, min_periods)

    def std(self, c: ColumnLike, n: int, min_periods: int | None = None) -> Column:
        return self.rolling(F.stddev_samp, finite(c), n, min_periods)

    def last_known(self, c: ColumnLike) -> Column:
        return F.last(as_col(c), ignorenulls=True).over(self.so_far)

    def position(self) -> Column:
        return F.row_number().over(self.rows)

    def compound(self, r: ColumnLike) -> Column:
        """Running product of 1 + r, right for zero and negative factors too."""
        factor = 1 + as_col(r)
        log = F.when(factor != 0, F.ln(F.abs(factor)))
        size = F.exp(F.coalesce(F.sum(log).over(self.so_far), F.lit(0.0)))
        negatives = F.count(F.when(factor < 0, 1)).over(self.so_far)
        zeros = F.count(F.when(factor == 0, 1)).over(self.so_far)
        sign = F.when(negatives % 2 == 1, -1.0).otherwise(1.0)
        return F.when(zeros > 0, 0.0).otherwise(size * sign)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without nulls in `columns`.

    One condition per column: the optimizer derives constraints from each on
    its own, while one condition over many columns makes it try all
    combinations of their aliases.
    """
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return df.filter(condition)


def with_exprs(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add many columns from SQL text in one call (cheap to build)."""
    keep = [f"`{c}`" for c in df.columns if c not in columns]
    return df.selectExpr(*keep, *[f"{sql} AS `{name}`" for name, sql in columns.items()])


#: windows of up to so many rows are summed row by row
FRAME_ROWS = 256


def window_sums(df: DataFrame, series: Series, sums: dict[str, str], n: int) -> DataFrame:
    """Sums of SQL expressions over the last n rows; null counts as zero.

    Short windows are plain frames: they share the sort of the series, while blocks need three more
    sorts, which a task holds in memory at the same time.  For longer ones a series is cut into blocks
    of n rows; a window is the end of one block and the start of the next, so two partial sums are
    added per row whatever n is.  Nothing is subtracted, so a value has no effect on windows that do
    not hold it.
    """
    keys = ", ".join(f"`{c}`" for c in series.by)
    rows = series.sql_rows
    if n <= FRAME_ROWS:
        frame = f"{rows[:-1]} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return with_exprs(df, {c: f"coalesce(sum({sql}) OVER {frame}, 0D)" for c, sql in sums.items()})
    df = with_exprs(df, {"_b": f"floor((row_number() OVER {rows} - 1) / {n})", "_r": f"(row_number() OVER {rows} - 1) % {n}"})

    def block(way: str) -> str:
        order = ", ".join(f"`{c}` {way}" for c in series.order)
        return f"(PARTITION BY {keys}, _b ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    zero = {c: f"coalesce({sql}, 0D)" for c, sql in sums.items()}
    df = with_exprs(df, {f"_h_{c}": f"sum({sql}) OVER {block('ASC')}" for c, sql in zero.items()})
    df = with_exprs(df, {f"_t_{c}": f"sum({sql}) OVER {block('DESC')}" for c, sql in zero.items()})
    out = {
        c: f"`_h_{c}` + CASE WHEN _r = {n - 1} THEN 0D ELSE lag(`_t_{c}`, {n - 1}, 0D) OVER {rows} END"
        for c in sums
    }
    return with_exprs(df, out).drop("_b", "_r", *[f"_{k}_{c}" for c in sums for k in "ht"])


def frame_sums(df: DataFrame, series: Series, sums: dict[str, tuple[str, int]], block: int) -> DataFrame:
    """Sums `{name: (sql, n)}` over the last n rows, of several lengths from `block` to twice that.

    As in `window_sums`, with one block length for all: a window is the start of its block, the
    whole block before where it reaches further, and the end of the block where it begins.
    """
    if not all(block <= n <= 2 * block for _, n in sums.values()):
        raise ValueError("windows must hold one to two blocks")
    keys = ", ".join(f"`{c}`" for c in series.by)
    rows = series.sql_rows
    df = with_exprs(df, {"_b": f"floor((row_number() OVER {rows} - 1) / {block})", "_r": f"(row_number() OVER {rows} - 1) % {block}"})

    def part(way: str, ends: str = "CURRENT ROW") -> str:
        order = ", ".join(f"`{c}` {way}" for c in series.order)
        return f"(PARTITION BY {keys}, _b ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {ends})"

    zero = {c: f"coalesce({sql}, 0D)" for c, (sql, _) in sums.items()}
    heads = {f"_h_{c}": f"sum({sql}) OVER {part('ASC')}" for c, sql in zero.items()}
    whole = {f"_w_{c}": f"sum({sql}) OVER {part('ASC', 'UNBOUNDED FOLLOWING')}" for c, sql in zero.items()}
    df = with_exprs(df, heads | whole)
    df = with_exprs(df, {f"_t_{c}": f"sum({sql}) OVER {part('DESC')}" for c, sql in zero.items()})
    out = {
        c: f"`_h_{c}` + CASE WHEN _r = {n - 1} THEN 0D ELSE lag(`_t_{c}`, {n - 1}, 0D) OVER {rows} END"
        f" + CASE WHEN _r < {n - 1 - block} THEN lag(`_w_{c}`, {block}, 0D) OVER {rows} ELSE 0D END"
        for c, (_, n) in sums.items()
    }
    return with_exprs(df, out).drop("_b", "_r", *[f"_{k}_{c}" for c in sums for k in "htw"])


def running_mean(
    df: DataFrame, series: Series, specs: Sequence[tuple[str, str, int]]
) -> DataFrame:
    """Add rolling means `(out, column, n)`.

    A window counts only when its n values are all present and finite.
    """
    for n in sorted({s[2] for s in specs}):
        columns = sorted({c for _, c, m in specs if m == n})
        known = {c: f"CASE WHEN abs(`{c}`) < double('Infinity') THEN CAST(`{c}` AS DOUBLE) END" for c in columns}
        sums = {f"_s_{c}": x for c, x in known.items()} | {f"_n_{c}": f"CASE WHEN {x} IS NOT NULL THEN 1D END" for c, x in known.items()}
        df = window_sums(df, series, sums, n)
        df = with_exprs(df, {name: f"CASE WHEN `_n_{c}` = {n} THEN `_s_{c}` / {n} END" for name, c, m in specs if m == n})
        df = df.drop(*sums)
    return df


def running_moments(
    df: DataFrame, series: Series, specs: Sequence[tuple[str, str, str, int, int]]
) -> DataFrame:
    """Add rolling mean and sample deviation for long windows.

    `specs` are `(mean_out, std_out, column, n, min_periods)`.  A series is cut
    into blocks of n rows; a window is the end of one block and the start of
    the next, so two partial results are merged per row whatever n is.  Sums
    from the start of a block are taken about its first value, sums to its end
    about its last value; neither is a difference of larger sums, so series
    may drift or jump far from where they began.  NaN and infinities are missing values.
    """
    if not specs:
        return df
    rows = series.sql_rows
    read = {c: f"_x_{c}" for _, _, c, _, _ in specs}
    df = with_exprs(df, {"_t": f"row_number() OVER {rows} - 1"} | {x: f"CASE WHEN abs(`{c}`) < double('Infinity') THEN `{c}` END" for c, x in read.items()})
    specs = [(m, std, read[c], n, need) for m, std, c, n, need in specs]
    lengths = sorted({s[3] for s in specs})
    df = with_exprs(df, {f"_k{n}": f"floor(_t / {n})" for n in lengths})
    keys = ", ".join(f"`{c}`" for c in series.by)

    def block(n: int, way: str, ends: str = "CURRENT ROW") -> str:
        order = ", ".join(f"`{c}` {way}" for c in series.order)
        return f"(PARTITION BY {keys}, _k{n} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {ends})"

    bases = {}
    for m, _, c, n, _ in specs:
        whole = block(n, "ASC", "UNBOUNDED FOLLOWING")
        bases[f"_b_{m}"] = f"first(`{c}`) IGNORE NULLS OVER {whole}"
        bases[f"_e_{m}"] = f"last(`{c}`) IGNORE NULLS OVER {whole}"
    df = with_exprs(df, bases)
    sums = {}
    for m, _, c, n, _ in specs:
        for tag, base, way in (("p", "b", "ASC"), ("t", "e", "DESC")):
            x = f"(`{c}` - `_{base}_{m}`)"
            sums[f"_n{tag}_{m}"] = f"count(`{c}`) OVER {block(n, way)}"
            sums[f"_s{tag}_{m}"] = f"coalesce(sum({x}) OVER {block(n, way)}, 0D)"
            sums[f"_q{tag}_{m}"] = f"coalesce(sum({x} * {x}) OVER {block(n, way)}, 0D)"
    df = with_exprs(df, sums)
    # the end of the block before; nothing of it is left at the end of a block
    before = {}
    for m, _, _, n, _ in specs:
        before[f"_ba_{m}"] = f"lag(`_e_{m}`, {n - 1}) OVER {rows}"
        for kind, zero in (("n", "0L"), ("s", "0D"), ("q", "0D")):
            before[f"_{kind}a_{m}"] = (
                f"CASE WHEN _t % {n} = {n - 1} THEN {zero} "
                f"ELSE lag(`_{kind}t_{m}`, {n - 1}, {zero}) OVER {rows} END"
            )
    df = with_exprs(df, before)
    parts = {}
    for m, *_ in specs:
        for tag, base in (("a", f"_ba_{m}"), ("p", f"_b_{m}")):
            n, s, q = (f"`_{kind}{tag}_{m}`" for kind in "nsq")
            parts[f"_m{tag}_{m}"] = f"CASE WHEN {n} > 0 THEN `{base}` + {s} / {n} END"
            parts[f"_v{tag}_{m}"] = f"CASE WHEN {n} > 0 THEN greatest({q} - {s} * {s} / {n}, 0D) ELSE 0D END"
    df = with_exprs(df, parts)
    out = {}
    for m, std, _, _, need in specs:
        na, nb = f"`_na_{m}`", f"`_np_{m}`"
        gap = f"coalesce(`_ma_{m}` - `_mp_{m}`, 0D)"
        n = f"({na} + {nb})"
        mean = f"coalesce(`_mp_{m}` + coalesce(`_ma_{m}` - `_mp_{m}`, 0D) * {na} / {n}, `_ma_{m}`)"
        squares = f"(`_va_{m}` + `_vp_{m}` + {gap} * {gap} * {na} * {nb} / {n})"
        out[m] = f"CASE WHEN {n} >= {max(need, 1)} THEN {mean} END"
        out[std] = f"CASE WHEN {n} >= {max(need, 2)} THEN sqrt({squares} / ({n} - 1)) END"
    df = with_exprs(df, out)
    names = [f"_{k}{t}_{m}" for m, *_ in specs for k in "nsq" for t in "pta"]
    names += [f"_{k}{t}_{m}" for m, *_ in specs for k in "mv" for t in "ap"]
    names += [f"_{k}_{m}" for m, *_ in specs for k in ("b", "e", "ba")]
    return df.drop("_t", *read.values(), *names, *[f"_k{n}" for n in lengths])
