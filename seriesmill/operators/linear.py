"""Linear models per group from sums of products.

A fit needs the rows once: means and centred products come from one aggregation (which
combines before the shuffle), the small systems are solved in batches of the
sums table, and coefficients come back by a join on the group.  The same sums
serve any number of penalties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seriesmill.functions.columns import Series, count_if, finite, safe_ratio
from seriesmill.functions.lineage import written
from seriesmill.operators.ranking import quantiles

#: fixed candidates
ALPHA_GRID = (0.1, 1.0, 10.0, 50.0, 100.0, 300.0, 500.0, 1000.0)


def complete_condition(features: Sequence[str], target: str | None = None) -> Column:
    """All values there and finite."""
    cond = F.lit(True)
    for c in [*features, *([target] if target else [])]:
        cond = cond & finite(F.col(c).cast("double")).isNotNull()
    return cond


def _pairs(names: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(names)) for j in range(i, len(names))]


def gram(rows: DataFrame, features: Sequence[str], target: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row per group: rows `_n`, means `_m<i>` and centred products `_c<i>_<j>` of features and target.

    Covariances are merged from centred parts, so a large level costs no digits.  With `weight`
    the means and products are weighted; the mean of a group is taken off first.
    """
    by, names = list(by), [*features, target]
    rows = rows.filter(complete_condition(names))
    x = [F.col(c).cast("double") for c in names]
    if weight is None:
        n = F.count("*").cast("double")
        products = [(F.covar_pop(x[i], x[j]) * n).alias(f"_c{i}_{j}") for i, j in _pairs(names)]
        return rows.groupBy(*by).agg(n.alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)], *products)
    w = F.col(weight).cast("double")
    # about the plain mean of each group, which is one row a group
    centre = rows.groupBy(*by).agg(*[F.avg(c).alias(f"_o{i}") for i, c in enumerate(x)])
    if by:
        rows = rows.join(centre, by)
    else:
        only = centre.first()
        rows = rows.withColumns({c: F.lit(only[c]).cast("double") for c in centre.columns})
    d = [c - F.col(f"_o{i}") for i, c in enumerate(x)]
    total = F.sum(w)
    sums = rows.groupBy(*by).agg(
        total.alias("_n"), *[F.first(f"_o{i}").alias(f"_o{i}") for i in range(len(names))],
        *[F.sum(w * c).alias(f"_s{i}") for i, c in enumerate(d)], *[F.sum(w * d[i] * d[j]).alias(f"_q{i}_{j}") for i, j in _pairs(names)])
    return _centred(sums, len(names), by)


def _centred(sums: DataFrame, width: int, by: Sequence[str]) -> DataFrame:
    """Means and centred products from sums about an offset `_o<i>`."""
    n = F.nullif(F.col("_n"), F.lit(0.0))
    means = [(F.col(f"_o{i}") + F.try_divide(F.col(f"_s{i}"), n)).alias(f"_m{i}") for i in range(width)]
    products = [(F.col(f"_q{i}_{j}") - F.try_divide(F.col(f"_s{i}") * F.col(f"_s{j}"), n)).alias(f"_c{i}_{j}") for i, j in _pairs(range(width))]
    return sums.select(*by, F.col("_n"), *means, *products)


def walk_forward_gram(
    panel: DataFrame, folds: DataFrame, features: Sequence[str], target: str, by=("symbol",),
) -> DataFrame:
    """The table of `gram` for the training span of every fold of every series.

    Running sums about the mean of the series are read at the two ends of a span, so rows
    are not repeated per fold however many folds overlap.
    """
    by, names = list(by), [*features, target]
    s = Series(by)
    ok = complete_condition(names)
    offsets = {f"_o{i}": F.coalesce(F.avg(F.when(ok, F.col(c).cast("double"))).over(s.whole), F.lit(0.0)) for i, c in enumerate(names)}
    panel = panel.withColumns(offsets)
    d = [F.col(c).cast("double") - F.col(f"_o{i}") for i, c in enumerate(names)]
    sums = {"_n": F.lit(1.0)} | {f"_s{i}": c for i, c in enumerate(d)} | {f"_q{i}_{j}": d[i] * d[j] for i, j in _pairs(names)}
    held = [f"_o{i}" for i in range(len(names))]
    running = panel.select(
        *by, (s.position() - 1).alias("_at"), *held,
        *[F.coalesce(F.sum(F.when(ok, c)).over(s.so_far), F.lit(0.0)).alias(n) for n, c in sums.items()])
    ends = folds.select(
        *by, "fold_id",
        F.inline(F.array(
            F.struct(F.col("train_hi").alias("_at"), F.lit(1.0).alias("_sign")),
            F.struct((F.col("train_lo") - 1).alias("_at"), F.lit(-1.0).alias("_sign")))))
    spans = ends.join(running, [*by, "_at"]).groupBy(*by, "fold_id").agg(
        *[F.first(o).alias(o) for o in held], *[F.sum(F.col(n) * F.col("_sign")).alias(n) for n in sums])
    return _centred(spans, len(names), [*by, "fold_id"])


def solve(sums: DataFrame, p: int, by: Sequence[str], alphas: Sequence[float] = (0.0,)) -> DataFrame:
    """`(by, alpha, intercept, coef)`: ridge with a free intercept per alpha.

    A group without a complete row has null coefficients.
    """
    by = list(by)
    types = dict(sums.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in by], "alpha double, intercept double, coef array<double>"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            mean = np.stack([pdf[f"_m{i}"].to_numpy(float) for i in range(p + 1)], axis=1)
            products = np.empty((n, p + 1, p + 1))
            for i in range(p + 1):
                for j in range(i, p + 1):
                    products[:, i, j] = products[:, j, i] = pdf[f"_c{i}_{j}"].to_numpy(float)
            usable = (pdf["_n"].to_numpy(float) > 0) & np.isfinite(products).all(axis=(1, 2)) & np.isfinite(mean).all(axis=1)
            a, b = products[usable][:, :p, :p], products[usable][:, :p, p]
            for alpha in alphas:
                # the least-norm solution where columns depend on each other
                coef = np.einsum("gij,gj->gi", np.linalg.pinv(a + alpha * np.eye(p), rcond=1e-15 * max(p, 1), hermitian=True), b)
                out = pdf[by].copy()
                out["alpha"] = float(alpha)
                intercept = np.full(n, np.nan)
                intercept[usable] = mean[usable][:, p] - (coef * mean[usable][:, :p]).sum(axis=1)
                out["intercept"] = pd.Series(intercept, index=out.index).astype(object).where(usable, None)
                cells = iter(coef.tolist())
                out["coef"] = pd.Series([next(cells) if u else None for u in usable], index=out.index, dtype=object)
                yield out

    return sums.mapInPandas(fit, schema)


def predict(rows: DataFrame, coefs: DataFrame, features: Sequence[str], by: Sequence[str], out="y_pred") -> DataFrame:
    if not by:  # one fit for all rows
        only = coefs.first()
        value = F.lit(only["intercept"]).cast("double")
        for i, c in enumerate(features):
            value = value + F.lit(only["coef"][i] if only["coef"] else None).cast("double") * F.col(c)
        return rows.withColumn(out, value)
    value = F.col("intercept")
    for i, c in enumerate(features):
        value = value + F.col("coef")[i] * F.col(c)
    # of known size, so that rows are not shuffled to meet a few fits
    joined = rows.join(written(coefs), list(by)).withColumn(out, value)
    return joined.drop("intercept", "coef")


def ridge_fit(rows, features, target="y_true", by=("fold_id",), alphas=(1.0,), split="split", weight=None) -> DataFrame:
    sums = gram(rows.filter(F.col(split) == "train"), features, target, by, weight)
    return solve(sums, len(features), by, alphas)


def ridge_fit_predict(rows, features, target="y_true", by=("fold_id",), alpha=1.0, split="split", out="y_pred") -> DataFrame:
    """Fit on training rows, predict all rows.  alpha 0 is least squares."""
    return predict(rows, ridge_fit(rows, features, target, by, (alpha,), split).drop("alpha"), features, by, out)


def ols_fit_predict(rows, features, target="y_true", by=("fold_id",), split="split", out="y_pred") -> DataFrame:
    return ridge_fit_predict(rows, features, target, by, 0.0, split, out)


def big_move_objective(t: Column, p: Column, threshold: float) -> Column:
    """Aggregate: mse - 0.5 * (F1 of big ups + F1 of big downs)."""
    def f1(actual, predicted):
        both = count_if(actual & predicted)
        return safe_ratio(2.0 * both, count_if(actual) + count_if(predicted))

    ups, downs = f1(t > threshold, p > threshold), f1(t < -threshold, p < -threshold)
    return F.avg((t - p) * (t - p)) - 0.5 * (ups + downs)


def ridge_alpha_search(
    rows, features, target="y_true", by=("fold_id",), alphas=ALPHA_GRID, threshold=0.03, split="split",
) -> DataFrame:
    """Penalty with the smallest objective on validation rows, per group."""
    by = list(by)
    coefs = ridge_fit(rows, features, target, by, alphas, split)
    val = predict(rows.filter(F.col(split) == "val"), coefs, features, by, "_pred")
    scored = val.groupBy(*by, "alpha").agg(
        big_move_objective(F.col(target), F.col("_pred"), threshold).alias("objective"))
    return scored.groupBy(*by).agg(
        F.min_by("alpha", F.struct(F.round("objective", 10), "alpha")).alias("best_alpha"), F.min("objective").alias("objective"))


def regime_thresholds(rows, column, by=("fold_id",), split="split") -> DataFrame:
    """Median of the regime column over training rows."""
    return quantiles(rows.filter(F.col(split) == "train"), column, list(by), {"threshold": 0.5})


def with_side(rows, column, by=("fold_id",), split="split") -> DataFrame:
    """Add `side`: 0 at or below the trained threshold, 1 above."""
    if not by:  # one threshold for all rows
        one = regime_thresholds(rows.withColumn("_one", F.lit(0)), column, ["_one"], split).first()
        limit = F.lit(one["threshold"] if one else None).cast("double")
        return rows.withColumns({"threshold": limit, "side": F.when(F.col(column) <= limit, 0).otherwise(1)})
    t = regime_thresholds(rows, column, by, split)
    return rows.join(t, list(by)).withColumn("side", F.when(F.col(column) <= F.col("threshold"), 0).otherwise(1))


def regime_gated_ridge(rows, features, column, target="y_true", by=("fold_id",), alpha=1.0, split="split") -> DataFrame:
    """One ridge per regime, routed by the trained threshold."""
    sided = with_side(rows, column, by, split)
    return ridge_fit_predict(sided, features, target, [*by, "side"], alpha, split)


def feature_importance(coefs: DataFrame, features: Sequence[str], top: int | None = None, by=("fold_id",)) -> DataFrame:
    names = F.array(*[F.lit(c) for c in features])
    long = coefs.select(*by, F.posexplode("coef").alias("_i", "importance")).select(
        *by, F.element_at(names, F.col("_i") + 1).alias("feature"), "importance")
    ordered = long.orderBy(F.col("importance").desc(), "feature", *by)
    return ordered.limit(top) if top else ordered


def mean_importance(coefs: DataFrame, features: Sequence[str], by=("fold_id",)) -> DataFrame:
    """Importance of a gated model: the average of its parts."""
    return feature_importance(coefs, features, None, by).groupBy("feature").agg(F.avg("importance").alias("importance"))


def weighted_blend(long: DataFrame, weights: dict[str, float], keys=("symbol", "date"), model="model", pred="y_pred") -> DataFrame:
    """Weighted mean of the models that have a prediction, renormalised."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col(model) == name, value).otherwise(w)
    w = F.when(F.col(pred).isNotNull(), w)
    return long.groupBy(*keys).agg(F.try_divide(F.sum(w * F.col(pred)), F.sum(w)).alias("blend"))


def stack_lambda_search(
    df: DataFrame, by: Sequence[str], criterion="monthly_sharpe", grid=(0.0, 0.25, 0.5, 0.75, 1.0),
    base="ridge_pred", resid="resid_pred",
) -> DataFrame:
    """Mixing weight of the residual model, the first best of the grid.

    `monthly_sharpe` needs `by` to name a dated series; the other criteria
    take groups of any size.
    """
    from seriesmill.operators import metrics, policy

    by = list(by)
    rows = df.withColumn("lambda", F.explode(F.array(*[F.lit(g) for g in grid])))
    rows = rows.withColumn("y_pred", F.col(base) + F.col("lambda") * F.col(resid))
    key = [*by, "lambda"]
    if criterion == "rmse":
        scores = metrics.point_metrics(rows, key).select(*key, (-F.col("rmse")).alias("score"))
    elif criterion == "ic":
        scores = metrics.information_coefficient(rows, key).select(*key, F.col("ic").alias("score"))
    elif criterion == "decile_spread":
        scores = metrics.decile_spread(rows, key).select(*key, F.col("spread").alias("score"))
    elif criterion == "monthly_sharpe":
        scores = policy.evaluate_policy(rows, key, execution="monthly", ranks=False).select(*key, F.col("sharpe").alias("score"))
    else:
        raise ValueError(f"unknown criterion {criterion}")
    best = policy.first_best(F.col("score"), "lambda")
    return scores.groupBy(*by).agg(F.coalesce(best, F.lit(0.0)).alias("best_lambda"), F.max("score").alias("best_score"))


def grouped_fit_predict(
    rows: DataFrame, fit_fn: Callable, predict_fn: Callable, features: Sequence[str], by: Sequence[str] = ("symbol",),
    target="y_true", split="split", keys=("symbol", "date"), out="y_pred", folds: DataFrame | None = None, tasks: int | None = None,
) -> DataFrame:
    """Any user model, fitted on the training rows of each group by itself.

    A group reaches one task, so `by` must name a dated series (optionally one
    fold of it); pooled fits of any size belong to the functions above.  With `folds` the rows are those of
    a panel, `by` names a series and `fold_id`, and a series is handed over once for all of its folds, by `tasks` tasks.
    """
    types = dict(rows.dtypes)
    columns = list(dict.fromkeys([*keys, *by, split, target]))
    names = list(features)
    if folds is not None:
        return _folds_fit_predict(rows, folds, fit_fn, predict_fn, names, [k for k in by if k != "fold_id"], target, split, columns, out, tasks)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in columns], f"`{out}` double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        train = pdf[pdf[split] == "train"].dropna(subset=[*names, target])
        pred = np.full(len(pdf), np.nan)
        if len(train):
            model = fit_fn(train[names].to_numpy(float), train[target].to_numpy(float))
            pred = predict_fn(model, pdf[names].to_numpy(float))
        return pdf[columns].assign(**{out: pred})

    return rows.select(*dict.fromkeys([*columns, *names])).groupBy(*by).applyInPandas(one, schema)


def _series_bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """First rows of the series of a sorted table, and its end."""
    change = np.zeros(max(len(table) - 1, 0), dtype=bool)
    for k in keys:
        c = table[k].combine_chunks()
        change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(change) + 1, [len(table)]))


def _folds_fit_predict(
    panel: DataFrame, folds: DataFrame, fit_fn: Callable, predict_fn: Callable, names: list[str], series: list[str],
    target: str, split: str, columns: list[str], out: str, tasks: int | None,
) -> DataFrame:
    """The rows of every fold as `splits.fold_rows` gives them, with the forecasts of the fold's model; no row is copied before its forecast."""
    schema = T.StructType([T.StructField(c, T.StringType() if c == split else (folds if c == "fold_id" else panel).schema[c].dataType) for c in columns]).add(out, T.DoubleType())
    kinds = ("train", "val", "test")
    # a row for each span of a fold comes before those of its series
    spans = folds.select(*series, F.inline(F.array(*[F.struct(
        F.col("fold_id").alias("_fold"), F.lit(i).alias("_kind"), F.col(f"{k}_lo").cast("long").alias("_lo"), F.col(f"{k}_hi").cast("long").alias("_hi"))
        for i, k in enumerate(kinds)]))).filter(F.col("_lo").isNotNull() & F.col("_hi").isNotNull())
    own = [c for c in columns if c not in (split, "fold_id")]
    rows = panel.select(*dict.fromkeys([*own, *series, "date"]), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)], F.col(target).cast("double").alias("_y"))
    both = rows.withColumn("_kind", F.lit(-1)).unionByName(spans, allowMissingColumns=True)
    for k in series:
        both = both.filter(F.col(k).isNotNull())
    both = both.repartition(tasks, *series) if tasks else both.repartition(*series)
    both = both.sortWithinPartitions(*series, F.col("_kind") < 0, "date")

    def fitted(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        x = np.column_stack([t[f"_x{i}"].to_numpy() for i in range(len(names))])
        y, kind, lo, hi = (t[c].to_numpy() for c in ("_y", "_kind", "_lo", "_hi"))
        fold = t["_fold"].combine_chunks()
        known = ~(np.isnan(x).any(axis=1) | np.isnan(y))
        places, marks, codes, preds = [], [], [], []
        for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            start = first + int(np.count_nonzero(kind[first:end] >= 0))
            of: dict = {}
            for i, f in zip(range(first, start), fold[first:start].to_pylist()):
                a, b = max(start + int(lo[i]), start), min(start + int(hi[i]) + 1, end)
                if a < b:
                    of.setdefault(f, []).append((int(kind[i]), a, b, i))
            for held in of.values():
                held.sort()
                at = np.concatenate([np.arange(a, b) for _, a, b, _ in held])
                train = np.concatenate([np.arange(a, b) for k, a, b, _ in held if k == 0] or [np.empty(0, dtype=int)])
                train = train[known[train]]
                pred = np.full(len(at), np.nan)
                if len(train):
                    pred = np.asarray(predict_fn(fit_fn(x[train], y[train]), x[at]), dtype=float)
                places.append(at)
                preds.append(pred)
                for k, a, b, i in held:
                    codes.append(np.full(b - a, k, dtype=np.int32))
                    marks.append(np.full(b - a, i))
        if not places:
            return pa.RecordBatch.from_pylist([], arrow)
        at, pred = pa.array(np.concatenate(places)), np.concatenate(preds)
        made = {c: t[c].take(at).combine_chunks() for c in own}
        made["fold_id"] = fold.take(pa.array(np.concatenate(marks)))
        made[split] = pa.array(kinds).take(pa.array(np.concatenate(codes)))
        made[out] = pa.array(pred, mask=np.isnan(pred))
        if pa.types.is_floating(made[target].type):
            made[target] = pc.if_else(pc.is_nan(made[target]), None, made[target])
        return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in arrow], schema=arrow)

    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            piece = pa.Table.from_batches([batch])
            held = (piece if held is None else pa.concat_tables([held, piece])).combine_chunks()
            bounds = _series_bounds(held, series)
            # the last series may go on
            if len(bounds) > 2:
                yield fitted(held, bounds[:-1])
                held = held.slice(bounds[-2])
        if held is not None and len(held):
            yield fitted(held, _series_bounds(held, series))

    return both.mapInArrow(each, schema)
