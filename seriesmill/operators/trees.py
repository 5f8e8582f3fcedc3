"""Tree models with Spark ML, gated and stacked with the linear ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.columns import safe_ratio
from seriesmill.functions.lineage import stable, written
from seriesmill.operators.linear import big_move_objective, complete_condition, ridge_fit_predict, with_side

SEED = 42
#: bins of a feature, as in Spark's trees
BINS = 32
#: a forest is fitted to cells of bins if these hold so many rows on average
CELL_ROWS = 4
#: tasks that a cell of many rows is dealt to, rows drawn together in one, and cells of a tree in one file
PARTS, DRAWN, FILED = 8, 1 << 13, 1 << 19
#: trees of a forest that are fitted at the same time
THREADS = 8
#: fixed candidates
LAMBDA_GRID = (0.0, 0.25, 0.5, 0.75, 1.0)
DEFAULTS = {
    "random_forest": dict(numTrees=100, maxDepth=10),
    "gbt": dict(maxIter=150, stepSize=0.1, maxDepth=4),
    "residual": dict(maxIter=100, stepSize=0.1, maxDepth=3),
}


def _edges(rows: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Where the bins of each feature begin: at every value if there are few, else at quantiles of all rows."""
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(
        *[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"q{i}") for i, c in enumerate(features)],
        *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(features)]).first()
    edges = []
    for i, c in enumerate(features):
        at = sorted(set(found[f"q{i}"] or []))
        if found[f"n{i}"] <= 1.5 * BINS:  # an estimate, so the values are few in any case
            values = sorted(float(r[0]) for r in rows.select(c).distinct().collect())
            at = values[1:] if len(values) <= BINS else at
        edges.append(at)
    return edges


def _binning(rows: DataFrame, features: Sequence[str]) -> tuple[list, list[str]]:
    """Transformers that bin rows of a written table, and the columns of bins."""
    edges = _edges(rows, features)
    bins = [f"_b{i}" for i in range(len(features))]
    limits = [[float("-inf"), *e, float("inf")] if e else [float("-inf"), 0.0, float("inf")] for e in edges]
    return [
        Bucketizer(splitsArray=limits, inputCols=list(features), outputCols=bins, handleInvalid="keep"),
        VectorAssembler(inputCols=bins, outputCol="_x", handleInvalid="keep"),
    ], bins


def _plain(bins: Sequence[str]) -> list:
    """Bins are numbers in order, not the categories that the bucketizer says they are."""
    return [F.col(b).alias(b, metadata={}) for b in bins]


def _cells(rows: DataFrame, features: Sequence[str], target: str, weight: str | None, keys: Sequence[str] = ()) -> tuple[list, DataFrame]:
    """Transformers that bin rows, and one weighted row `_x`, `_y`, `_w` for each cell of bins with rows.

    Trees see bins only, and the rows of a cell share all splits.  The spread of targets within a cell
    is the same for every split, so weight and mean of a cell give the gains, and with them the trees, that its rows
    would.  The rows are read for bins and sums, not for each level of each tree.
    """
    rows = written(rows)
    binning, bins = _binning(rows, features)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = binning[0].transform(rows).groupBy(*bins, *keys).agg(F.sum(w).alias("_w"), F.sum(w * F.col(target)).alias("_s"))
    cells = written(cells.filter("_w > 0").select(*_plain(bins), (F.col("_s") / F.col("_w")).alias("_y"), "_w"))
    return binning, binning[1].transform(cells).select("_x", "_y", "_w")


def _drawn(n_bins: int, trees: int, rate: float, seed: int):
    """Sums of weight and weighted target of each cell in each tree, from rows sorted by cell.

    Every row is drawn anew for each tree, a Poisson number of times, as in Spark's forests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            for low in range(0, batch.num_rows, DRAWN):
                columns = [c.to_numpy() for c in batch.slice(low, DRAWN).columns]
                at, y, w = np.stack(columns[:n_bins]), columns[-2], columns[-1]
                first = np.flatnonzero(np.append(True, (at[:, 1:] != at[:, :-1]).any(axis=0)))
                times = rng.poisson(rate, (len(y), trees)) * w[:, None]
                sums = [np.add.reduceat(x, first, axis=0) for x in (times, times * y[:, None])]
                ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * trees)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(b[first]) for b in at), *(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in sums)],
                    names=[*(f"_b{i}" for i in range(n_bins)), "_w", "_s"])

    return run


def _samples(rows: DataFrame, bins: list[str], target: str, weight: str | None, trees: int, rate: float, seed: int) -> DataFrame:
    """One row for each tree and cell of binned rows that it drew: `_tree`, bins, mean target `_y`, weight `_w`."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = rows.select(*_plain(bins), F.col(target).cast("double").alias("_y"), w.alias("_w"))
    # the order decides which row gets which number, so it is that of the values; a cell of many rows is no single task's
    dealt = rows.repartition(*bins, F.pmod(F.xxhash64("_y"), F.lit(PARTS))).sortWithinPartitions(*bins, "_y", "_w")
    schema = ", ".join([*(f"{b} double" for b in bins), "_w array<double>", "_s array<double>"])
    one = dealt.mapInArrow(_drawn(len(bins), trees, rate, seed), schema)
    one = one.select(*bins, F.posexplode(F.arrays_zip("_w", "_s"))).filter("col._w > 0")
    whole = one.groupBy(F.col("pos").alias("_tree"), *bins).agg(F.sum("col._w").alias("_w"), F.sum("col._s").alias("_s"))
    return whole.select("_tree", *bins, (F.col("_s") / F.col("_w")).alias("_y"), "_w")


def _forest(rows: DataFrame, features: Sequence[str], target: str, weight: str | None, params: dict) -> PipelineModel:
    """Random forest whose trees read the cells of bins that their own draw of rows left.

    As for boosted trees, weight and mean of a cell give the splits of its rows.  Each row is still drawn by itself for each tree,
    but once, into the sums of its cell; levels of trees read cells.  Where cells hold few rows, Spark's forest reads the rows.
    """
    rows = written(rows)
    model = RandomForestRegressor(**{"seed": SEED, **DEFAULTS["random_forest"], **params})
    trees = model.getNumTrees()
    binning, bins = _binning(rows, features)
    binned = binning[0].transform(rows)
    n = binned.select(*bins).distinct().count()
    if not model.getBootstrap() or rows.count() < CELL_ROWS * n:
        vectors = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
        model.setFeaturesCol("_x").setLabelCol(target)
        return PipelineModel([vectors, (model.setWeightCol(weight) if weight else model).fit(vectors.transform(rows))])
    cells = _samples(binned, bins, target, weight, trees, model.getSubsamplingRate(), model.getSeed())
    # Spark samples rows for its splits, so their order is fixed
    dealt = cells.repartition("_tree", F.pmod(F.xxhash64(*bins), F.lit(n // FILED + 1)))
    cells = written(dealt.sortWithinPartitions("_tree", *bins), "_tree")
    subset = model.getFeatureSubsetStrategy()
    if subset == "auto":
        subset = "onethird" if trees > 1 else "all"
    one = model.copy().setNumTrees(1).setBootstrap(False).setSubsamplingRate(1.0).setFeatureSubsetStrategy(subset)
    one.setFeaturesCol("_x").setLabelCol("_y").setWeightCol("_w")

    def fit(t: int):
        own = binning[1].transform(cells.filter(F.col("_tree") == t))
        return one.copy().setSeed(model.getSeed() + t).fit(own).trees[0]

    with ThreadPool(min(THREADS, trees)) as pool:
        fitted = pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(trees), 1)
    context = rows.sparkSession.sparkContext
    kind = context._jvm.org.apache.spark.ml.regression
    grown = context._gateway.new_array(kind.DecisionTreeRegressionModel, trees)
    for t, tree in enumerate(fitted):
        grown[t] = tree._java_obj
    forest = RandomForestRegressionModel(kind.RandomForestRegressionModel(model.uid, grown, len(bins)))
    # the mean of trees divides by the parameter
    return PipelineModel([*binning, forest._set(numTrees=trees, featuresCol="_x")])


def _used(train: DataFrame, features, target: str, weight: str | None) -> DataFrame:
    used = dict.fromkeys([*features, target, *([weight] if weight else [])])
    return train.filter(complete_condition(features, target)).select(*used)


def _boosted(binning: list, cells: DataFrame, kind: str, params: dict) -> PipelineModel:
    model = GBTRegressor(featuresCol="_x", labelCol="_y", weightCol="_w", seed=SEED, **{**DEFAULTS[kind], **params})
    return PipelineModel([*binning, model.fit(cells)])


def fit_tree(train: DataFrame, features, target="y_true", kind="gbt", weight: str | None = None, **params) -> PipelineModel:
    """Regressor fitted to complete rows; parameters override the defaults of the kind."""
    rows = _used(train, features, target, weight)
    if kind != "random_forest":
        return _boosted(*_cells(rows, features, target, weight), kind, params)
    return _forest(rows, features, target, weight, params)


def predict_tree(model: PipelineModel, rows: DataFrame, features, out="y_pred") -> DataFrame:
    """All rows; the forecast of an incomplete one is null."""
    done = F.when(complete_condition(features), F.col("prediction"))
    return model.transform(rows).withColumn(out, done).select(*[c for c in rows.columns if c != out], out)


def tree_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Share of the impurity decrease of every feature, largest first."""
    shares = model.stages[-1].featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(features, shares, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def tree_fit_predict(rows, features, target="y_true", kind="gbt", split="split", out="y_pred", **params) -> DataFrame:
    model = fit_tree(rows.filter(F.col(split) == "train"), features, target, kind, **params)
    return predict_tree(model, rows, features, out)


def tree_per_fold(rows, features, folds: Sequence, target="y_true", kind="gbt", fold="fold_id", **params) -> DataFrame:
    """An independent pooled tree model per listed fold."""
    parts = [tree_fit_predict(rows.filter(F.col(fold) == f), features, target, kind, **params) for f in folds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tree_param_search(rows, features, grid: dict[str, Sequence], target="y_true", kind="gbt", threshold=0.03, split="split") -> DataFrame:
    """Objective of every parameter combination on validation rows, best first."""
    train, val = rows.filter(F.col(split) == "train"), written(rows.filter(F.col(split) == "val"))
    names = list(grid)
    # one binning serves all combinations
    prepared = _cells(_used(train, features, target, None), features, target, None) if kind != "random_forest" else None
    scored = None
    for values in product(*grid.values()):
        params = dict(zip(names, values))
        model = _boosted(*prepared, kind, params) if prepared else fit_tree(train, features, target, kind, **params)
        one = predict_tree(model, val, features, "_pred").agg(
            big_move_objective(F.col(target), F.col("_pred"), threshold).alias("objective"))
        one = one.select(*[F.lit(v).alias(n) for n, v in params.items()], "objective")
        scored = one if scored is None else scored.unionByName(one)
    return scored.orderBy("objective", *names)


def bigmove_classifier(rows, features, label="label", split="split", **params) -> DataFrame:
    """Boosted classifier; positives weigh negatives-per-positive of training."""
    train = rows.filter((F.col(split) == "train") & complete_condition(features, label))
    pos = F.count(F.when(F.col(label) == 1, 1))
    weight = train.agg(safe_ratio(F.count("*") - pos, pos, 1.0)).scalar()
    weighted = train.select(*dict.fromkeys([*features, label])).withColumn("_w", F.when(F.col(label) == 1, weight).otherwise(1.0))
    # rows of a cell and label share their gradient, so a cell has a row for each label
    binning, cells = _cells(weighted, features, label, "_w", [label])
    options = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 4, **params}
    model = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", seed=SEED, **options).fit(cells)
    scored = PipelineModel([*binning, model]).transform(rows)
    known = complete_condition(features)
    return scored.withColumns(
        {"prob": F.when(known, vector_to_array("probability")[1]), "pred": F.when(known, F.col("prediction").cast("int"))}
    ).select(*[c for c in rows.columns if c not in ("prob", "pred")], "prob", "pred")


def regime_gated_hybrid(rows, features, column, target="y_true", alpha=1.0, split="split", low="ridge", high="gbt", **params) -> DataFrame:
    """Two model types at the median of a regime column."""
    sided = with_side(rows, column, [], split)
    return _two_models(sided, features, target, alpha, split, {0: low, 1: high}, params).drop("threshold")


def trend_gated_hybrid(rows, features, column, target="y_true", alpha=1.0, split="split", **params) -> DataFrame:
    """Linear model above zero of the trend column, trees at or below."""
    sided = rows.withColumn("side", F.when(F.col(column) > 0, 0).otherwise(1))
    return _two_models(sided, features, target, alpha, split, {0: "ridge", 1: "gbt"}, params)


def _two_models(sided, features, target, alpha, split, kinds: dict[int, str], params) -> DataFrame:
    out = None
    for side, kind in kinds.items():
        part = sided.filter(F.col("side") == side)
        if kind == "ridge":
            done = ridge_fit_predict(part, features, target, [], alpha, split)
        else:
            done = tree_fit_predict(part, features, target, kind, split, **params)
        out = done if out is None else out.unionByName(done)
    return out


def best_lambda(rows, target="y_true", grid=LAMBDA_GRID, base="ridge_pred", resid="resid_pred") -> float:
    """Mixing weight of the smallest squared error on the given rows, the first of equals."""
    errors = [F.avg((F.col(target) - F.col(base) - lam * F.col(resid)) ** 2).alias(f"e{i}") for i, lam in enumerate(grid)]
    row = rows.agg(*errors).first()
    known = [(round(e, 12), lam) for e, lam in zip(row, grid, strict=True) if e is not None]
    return min(known)[1] if known else 0.0


def residual_stack(rows, features, target="y_true", alpha=1.0, split="split", lam: float | None = None, **params) -> DataFrame:
    """Ridge, then trees on its residual with the ridge forecast as a feature.

    Both parts stay as columns; `final_pred = ridge_pred + lambda * resid_pred`, where lambda is
    chosen on validation rows unless given.
    """
    base = ridge_fit_predict(rows, features, target, [], alpha, split, "ridge_pred")
    base = stable(base.withColumn("_resid", F.col(target) - F.col("ridge_pred")))
    stacked = tree_fit_predict(base, [*features, "ridge_pred"], "_resid", "residual", split, "resid_pred", **params)
    if lam is None:
        lam = best_lambda(stacked.filter(F.col(split) == "val"), target)
    return stacked.drop("_resid").withColumns(
        {"lambda": F.lit(float(lam)), "final_pred": F.col("ridge_pred") + lam * F.col("resid_pred")})
