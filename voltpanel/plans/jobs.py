"""The daily jobs: forecast the next day, evaluate the last thirty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltpanel.operators import forest, live, scoring
from voltpanel.operators.features import live_demand_features
from voltpanel.operators.keyed import upsert
from voltpanel.operators.validate import split_ready
from voltpanel.schemas import INFERENCE_FEATURES

KEYS = ["zone", "target_date"]
FEED_TIMEZONE = "America/New_York"


def today_in(timezone: str = FEED_TIMEZONE) -> Column:
    """Today's date where the feed is published, whatever the session's time zone."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(timezone), F.localtimestamp()))


def inference_table(demand: DataFrame, timeline: DataFrame) -> DataFrame:
    """Model rows for every zone and target date the demand and the forecast allow."""
    forecast = live.live_forecast_features(timeline)
    inertia = live.live_thermal_inertia(timeline, forecast)
    return live.inference_rows(live_demand_features(demand), forecast, inertia)


def prediction_rows(predicted: DataFrame, inputs: DataFrame, version: str) -> DataFrame:
    """Predictions with their version and the model inputs as JSON."""
    snapshot = inputs.select(*KEYS, F.to_json(F.struct(*INFERENCE_FEATURES)).alias("features"))
    return predicted.join(snapshot, KEYS).select(
        *KEYS, "predicted_demand", F.lit(version).alias("model_version"), "features"
    )


def daily_forecast(
    demand: DataFrame, timeline: DataFrame, model: DataFrame, target_date: str, version: str
) -> DataFrame:
    """Predictions for one target date by the zones' forests (``sinks.models.load_trees``).

    Zones whose anchor day has not arrived are held over for the next run, and zones with
    an incomplete row have no prediction; neither stops the others. ``forecast_status``
    names both.
    """
    ready, _ = split_ready(demand, target_date)
    inputs = (
        inference_table(ready, timeline)
        .filter(F.col("target_date") == F.to_date(F.lit(target_date)))
        .dropna(subset=INFERENCE_FEATURES)
    )
    return prediction_rows(forest.predict_rows(model, inputs, INFERENCE_FEATURES, KEYS), inputs, version)


def forest_predictor(demand: DataFrame, timeline: DataFrame, model: DataFrame, version: str) -> Callable[[DataFrame], DataFrame]:
    """What ``streaming.holdover.run_forecast`` asks for: prediction rows of given (zone, target
    date) rows, whatever their dates; rows with a missing feature have none."""

    def predict(pairs: DataFrame) -> DataFrame:
        inputs = inference_table(demand, timeline).join(pairs, KEYS, "left_semi").dropna(subset=INFERENCE_FEATURES)
        return prediction_rows(forest.predict_rows(model, inputs, INFERENCE_FEATURES, KEYS), inputs, version)

    return predict


def forecast_status(demand: DataFrame, timeline: DataFrame, target_date: str) -> DataFrame:
    """One row per zone: predicted, held_over or incomplete, with the features its row misses.

    A zone without any row for the date misses all features.
    """
    ready, held = split_ready(demand, target_date)
    rows = inference_table(ready, timeline).filter(F.col("target_date") == F.to_date(F.lit(target_date)))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in INFERENCE_FEATURES]))
    known = ready.select("zone").distinct().join(rows.drop("target_date"), "zone", "left").select("zone", missing.alias("missing"))
    told = known.select("zone", F.when(F.size("missing") == 0, "predicted").otherwise("incomplete").alias("status"), "missing")
    none = F.expr("cast(array() as array<string>)")
    told = told.unionByName(held.select("zone", F.lit("held_over").alias("status"), none.alias("missing")).distinct())
    return told.select("zone", F.to_date(F.lit(target_date)).alias("target_date"), "status", "missing")


def daily_evaluation(
    predictions: DataFrame, demand: DataFrame, stored: DataFrame, today: str, days_back: int = 30
) -> tuple[DataFrame, DataFrame]:
    """Refreshed score table, and the summary of the last 7 and 30 scored rows per zone."""
    joined = predictions.join(
        demand.select("zone", F.col("date").alias("target_date"), F.col("demand").alias("actual_demand"), "is_imputed"),
        KEYS,
    )
    fresh = scoring.score_rows(scoring.in_trailing_window(joined, today, days_back))
    return upsert(stored, fresh, KEYS), scoring.trailing_scores(fresh, today, days_back)
