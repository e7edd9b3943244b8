"""Model artefacts: the pipeline itself, its metadata and its feature importance."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_model(
    spark: SparkSession,
    model: PipelineModel | DataFrame,
    path: str,
    features: list[str],
    val_metrics: dict,
    params: dict,
    fit_rows: int,
    train_end: str,
    val_end: str,
    importance: DataFrame,
) -> None:
    metadata = {
        "features": features,
        "spark_version": pyspark.__version__,
        "training_date": datetime.now(timezone.utc).isoformat(),
        "val_metrics": val_metrics,
        "train_end": train_end,
        "val_end": val_end,
        "best_params": params,
        "final_fit_rows": fit_rows,
    }
    if isinstance(model, DataFrame):  # a table of trees
        model.write.mode("overwrite").parquet(f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta"
    )
    importance.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/feature_importance")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def load_trees(spark: SparkSession, path: str) -> DataFrame:
    """The table of trees that ``save_model`` wrote."""
    return spark.read.parquet(f"{path}/model")


def load_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first().value)
