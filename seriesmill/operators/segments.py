"""Fits of all walk-forward folds from one pass over the rows.

Folds overlap, so a row belongs to many training spans.  Each series is cut at the ends of its
spans; a row is summed once, into the segment it lies in.  Runs of 2, 4, 8.. segments are added up
like the nodes of a binary tree, and a span is put together from the few largest nodes that
cover it.  Sums are only ever added, never subtracted, so a wild value outside a span leaves no
trace in it.  What grows with the rows is one window and one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.lineage import stable
from seriesmill.operators.linear import ALPHA_GRID, _centred, _pairs, big_move_objective, complete_condition, predict, solve
from seriesmill.operators.splits import fold_rows

#: levels of the tree; a longer span takes several nodes of the top one
LEVELS = 10


def with_segments(panel: DataFrame, folds: DataFrame, by=("symbol",), date="date") -> tuple[DataFrame, DataFrame]:
    """Panel rows with `_segment`, and folds with their first and last segment `_from`, `_to`.

    Rows outside of all training spans have segments of their own.  Needs the dates of the spans.
    """
    by = list(by)
    # a cut before the first row of a span (0) and after its last one (2); rows lie between (1)
    cuts = folds.select(*by, F.inline(F.array(
        F.struct(F.col("train_lo_date").alias(date), F.lit(0).alias("_side")),
        F.struct(F.col("train_hi_date").alias(date), F.lit(2).alias("_side"))))).distinct()
    in_order = Window.partitionBy(*by).orderBy(date, "_side")
    marked = panel.withColumn("_side", F.lit(1)).unionByName(cuts, allowMissingColumns=True)
    before = F.count(F.when(F.col("_side") != 1, 1)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = marked.withColumn("_segment", before)
    # the cut before a span opens its first segment, the one after it ends the segment before
    places = cuts.withColumn("_place", F.row_number().over(in_order).cast("long"))
    spans = folds
    for end, bound, side in (("_from", "train_lo_date", 0), ("_to", "train_hi_date", 2)):
        own = places.filter(F.col("_side") == side).select(*by, F.col(date).alias(bound), (F.col("_place") - side // 2).alias(end))
        spans = spans.join(own, [*by, bound])
    return numbered.filter("_side = 1").drop("_side"), spans


def _cover(levels: int) -> str:
    """Nodes (level, index) that cover the segments `_from`.. `_to`, each segment once.

    On a level the nodes inside the span are `a`.. `b`; only an odd first and an even last one
    are not part of a larger node inside.
    """
    a, b = "shiftright(_from + shiftleft(1L, l) - 1, l)", "(shiftright(_to + 1, l) - 1)"
    ends = f"array_distinct(array_compact(array(CASE WHEN {a} <= {b} AND {a} % 2 = 1 THEN {a} END, CASE WHEN {a} <= {b} AND {b} % 2 = 0 THEN {b} END)))"
    top = f"CASE WHEN {a} <= {b} THEN sequence({a}, {b}) ELSE CAST(array() AS array<bigint>) END"
    return f"flatten(transform(sequence(0, {levels}), l -> transform(CASE WHEN l < {levels} THEN {ends} ELSE {top} END, i -> struct(l AS _level, i AS _node))))"


def segment_gram(
    panel: DataFrame, folds: DataFrame, features: Sequence[str], target: str, by=("symbol",), keys=("fold_id",), levels: int = LEVELS,
) -> DataFrame:
    """The table of `linear.gram` for the training rows of every fold, pooled over series.

    `keys` are the columns of `folds` that name a fold; add `by` for folds of one series.  The
    few rows of `folds` are read several times, so let them be written ones.  Folds without a complete training row have no row count.
    """
    by, keys, names = list(by), list(keys), [*features, target]
    width = range(len(names))
    spans_of = folds.select(*dict.fromkeys([*by, *keys, "train_lo_date", "train_hi_date"]))
    rows, spans = with_segments(panel.select(*dict.fromkeys([*by, "date", *names])), spans_of, by)
    x = [F.col(c).cast("double") for c in names]
    n = F.count("*").cast("double")
    own = [F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)] + [(F.covar_pop(x[i], x[j]) * n).alias(f"_c{i}_{j}") for i, j in _pairs(names)]
    segments = stable(rows.filter(complete_condition(names)).groupBy(*by, "_segment").agg(n.alias("_n"), *own))
    # sums about the mean of all rows, which are few from here on
    centre = segments.agg(*[F.try_divide(F.sum(F.col(f"_m{i}") * F.col("_n")), F.sum("_n")).alias(f"_o{i}") for i in width]).first()
    offset = [F.lit(centre[f"_o{i}"] or 0.0) for i in width]
    d = [F.col(f"_m{i}") - offset[i] for i in width]
    sums = {"_n": F.col("_n")} | {f"_s{i}": F.col("_n") * d[i] for i in width} | {f"_q{i}_{j}": F.col(f"_c{i}_{j}") + F.col("_n") * d[i] * d[j] for i, j in _pairs(names)}
    add = [F.sum(c).alias(c) for c in sums]
    nodes = segments.select(*by, "_segment", *[c.alias(k) for k, c in sums.items()])
    nodes = nodes.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_node", F.expr("shiftright(_segment, _level)"))
    nodes = nodes.groupBy(*by, "_level", "_node").agg(*add)
    needed = spans.select(*dict.fromkeys([*by, *keys]), F.expr(f"inline({_cover(levels)})"))
    pooled = needed.join(nodes, [*by, "_level", "_node"], "left").groupBy(*keys).agg(*add)
    held = pooled.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in sums], *[o.alias(f"_o{i}") for i, o in enumerate(offset)])
    return _centred(held, len(names), keys)


def walk_forward_fit(panel, folds, features, target="y_true", by=("symbol",), keys=("fold_id",), alphas=(1.0,)) -> DataFrame:
    """`(keys, alpha, intercept, coef)`: ridge of the training rows of every fold, for every penalty."""
    return solve(segment_gram(panel, folds, features, target, by, keys), len(features), list(keys), alphas)


def walk_forward_predict(panel, folds, features, target="y_true", by=("symbol",), keys=("fold_id",), alpha=1.0, splits=("val", "test"), out="y_pred") -> DataFrame:
    """Rows of the named splits of every fold, predicted by its fit; no row is copied for a fit."""
    coefs = walk_forward_fit(panel, folds, features, target, by, keys, (alpha,)).drop("alpha")
    return predict(fold_rows(panel, folds, by, splits), coefs, features, keys, out)


def walk_forward_alpha_search(panel, folds, features, target="y_true", by=("symbol",), keys=("fold_id",), alphas=ALPHA_GRID, threshold=0.03) -> DataFrame:
    """Penalty with the smallest objective on the validation rows of each fold."""
    keys = list(keys)
    coefs = walk_forward_fit(panel, folds, features, target, by, keys, alphas)
    value = F.col("intercept")
    for i, c in enumerate(features):
        value = value + F.col("coef")[i] * F.col(c)
    # every row meets its penalties as an array, and is not joined once for each
    grids = coefs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("alpha", "intercept", "coef"))).alias("_fits"))
    val = fold_rows(panel, folds, by, ("val",)).select(*dict.fromkeys([*keys, *features, target])).join(grids, keys)
    scored = val.select(*keys, target, *features, F.inline("_fits")).withColumn("_pred", value)
    scores = scored.groupBy(*keys, "alpha").agg(big_move_objective(F.col(target), F.col("_pred"), threshold).alias("objective"))
    return scores.groupBy(*keys).agg(F.min_by("alpha", F.struct(F.round("objective", 10), "alpha")).alias("best_alpha"), F.min("objective").alias("objective"))
