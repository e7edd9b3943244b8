"""Tree ensembles on Spark ML with expanding-window search.

A search point is fitted on blocks before each fold and judged by MAE on the fold, as one
distributed job per fit; a few fits run side by side so that small ones share a cluster.
"""

from __future__ import annotations

import itertools
import json
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpanel.operators.validate import require_columns, require_feature_order

N_FOLDS = 5
SEED = 42

# The searched grids.  A null depth means unlimited, which Spark caps at 30.
FOREST_GRID = {
    "numTrees": [100, 300, 500],
    "maxDepth": [5, 10, 20, 30],
    "minInstancesPerNode": [1, 2, 5],
    "featureSubsetStrategy": ["sqrt", "0.5", "all"],
}
BOOSTED_GRID = {
    "maxIter": [200, 500],
    "stepSize": [0.05, 0.1],
    "maxDepth": [3, 5, 7],
    "subsamplingRate": [0.8, 1.0],
    "featureSubsetStrategy": ["0.8", "all"],
}
BOOSTED_RANDOM = {
    "maxIter": [300, 500, 800],
    "stepSize": [0.01, 0.03, 0.05, 0.1],
    "maxDepth": [3, 4, 5, 6],
    "minInstancesPerNode": [1, 3, 5],
    "minInfoGain": [0.0, 0.1, 0.3],
    "subsamplingRate": [0.7, 0.8, 1.0],
    "featureSubsetStrategy": ["0.7", "0.8", "all"],
}
RANDOM_POINTS = 75


def grid_points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def random_points(grid: dict[str, list], n: int = RANDOM_POINTS, seed: int = SEED) -> list[dict]:
    """Points of the grid without repetition, in a reproducible random order."""
    points = grid_points(grid)
    return random.Random(seed).sample(points, min(n, len(points)))


def _estimator(kind: str, params: dict, target: str):
    make = RandomForestRegressor if kind == "forest" else GBTRegressor
    return make(featuresCol="features", labelCol=target, predictionCol="predicted", seed=SEED, **params)


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def search(
    train: DataFrame,
    features: list[str],
    kind: str,
    points: list[dict],
    target: str = "target",
    n_folds: int = N_FOLDS,
    parallelism: int = 4,
) -> list[dict]:
    """Points with their mean fold MAE and the folds behind it, best first.

    ``train`` carries ``block`` cut for the same ``n_folds`` (see ``expanding_blocks``);
    another count raises, since blocks beyond it would never be used.
    """
    last = train.agg(F.max("block")).first()[0]
    if last is not None and last != n_folds:
        raise ValueError(f"blocks are cut for {last} folds, not {n_folds}")
    rows = assembled(train, features).select("features", target, "block").persist()

    def fold_mae(task: tuple[int, int]) -> tuple[int, int, float | None]:
        index, fold = task
        model = _estimator(kind, points[index], target).fit(rows.filter(F.col("block") < fold))
        tested = model.transform(rows.filter(F.col("block") == fold))
        return index, fold, tested.agg(F.avg(F.abs(F.col("predicted") - F.col(target)))).first()[0]

    tasks = list(itertools.product(range(len(points)), range(1, n_folds + 1)))
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            done = list(pool.map(inheritable_thread_target(train.sparkSession)(fold_mae), tasks))
    finally:
        rows.unpersist()
    results = []
    for index, params in enumerate(points):
        maes = [mae for i, _, mae in done if i == index and mae is not None]
        mae = sum(maes) / len(maes) if maes else float("inf")
        results.append({"params": params, "cv_mae": mae, "folds_used": len(maes)})
    return sorted(results, key=lambda r: (r["cv_mae"], json.dumps(r["params"], sort_keys=True)))


def early_stopped(train: DataFrame, val: DataFrame, features: list[str], params: dict, target: str = "target"):
    """Boosted trees that stop adding iterations once the validation rows stop improving."""
    both = train.withColumn("_is_val", F.lit(False)).unionByName(val.withColumn("_is_val", F.lit(True)))
    booster = _estimator("boosted", params, target).setValidationIndicatorCol("_is_val")
    return booster.fit(assembled(both, features))


def fit_final(rows: DataFrame, features: list[str], kind: str, params: dict, target: str = "target") -> PipelineModel:
    """Fit on all the given rows (train and validation together) as a savable pipeline."""
    stages = [VectorAssembler(inputCols=features, outputCol="features"), _estimator(kind, params, target)]
    return Pipeline(stages=stages).fit(rows.select(*features, target))


def feature_importance(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    pairs = sorted(zip(features, map(float, weights)), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame(pairs, "feature string, importance double")


def predict_rows(model: PipelineModel, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Batch prediction after the feature-order check; a null feature makes the row fail."""
    require_columns(rows, keys + features, "model")
    require_feature_order(rows, features, keys)
    return model.transform(rows).select(*keys, F.col("predicted").alias("predicted_demand"))
