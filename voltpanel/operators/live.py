"""Rows for a model at serving time: one row per zone and target date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltpanel.functions import (
    cooling_degrees,
    half_even,
    heating_degrees,
    hours_from_seconds,
    is_federal_holiday,
    is_weekend,
    mean_temperature,
)
from voltpanel.operators.keyed import join_by_day
from voltpanel.schemas import INFERENCE_FEATURES


def daylight_hours(timeline: DataFrame) -> DataFrame:
    return timeline.withColumn("daylight_hours", hours_from_seconds(F.col("sunset") - F.col("sunrise")))


def live_forecast_features(timeline: DataFrame) -> DataFrame:
    """Weather timeline rows renamed to model columns; degree days before rounding."""
    tavg = mean_temperature(F.col("tempmin"), F.col("tempmax"))
    return timeline.select(
        F.col("date").alias("target_date"),
        F.col("tempmin").alias("tmin_fc"),
        F.col("tempmax").alias("tmax_fc"),
        half_even(tavg, 1).alias("tavg_fc"),
        F.col("dew").alias("dew_point_fc"),
        F.col("humidity").alias("rh_mean_fc"),
        F.col("precip").alias("prcp_fc"),
        F.col("snow").alias("snow_fc"),
        F.coalesce("snowdepth", F.lit(0.0)).alias("snwd_fc"),
        F.col("solarenergy").alias("solar_rad_fc"),
        F.col("cloudcover").alias("cloud_cover_fc"),
        half_even(heating_degrees(tavg), 1).alias("hdd_fc"),
        half_even(cooling_degrees(tavg), 1).alias("cdd_fc"),
        hours_from_seconds(F.col("sunset") - F.col("sunrise")).alias("daylight_hours_next"),
    )


def live_thermal_inertia(observed: DataFrame, forecast: DataFrame) -> DataFrame:
    """Mean of two observed days and the (already rounded) forecast day.

    Degree days here are clipped from the three-day mean, whereas the training columns
    average clipped days; ``skew`` reports show where the two differ.  Null unless both
    observed days exist.
    """
    temperature = mean_temperature(F.col("tempmin"), F.col("tempmax"))
    serves = F.explode(F.array(F.lit(1), F.lit(2))).alias("ahead")
    before = (
        observed.select("date", temperature.alias("tavg"), serves)
        .groupBy(F.expr("date_add(date, ahead)").alias("target_date"))
        .agg(
            F.max(F.when(F.col("ahead") == 2, F.col("tavg"))).alias("_two_before"),
            F.max(F.when(F.col("ahead") == 1, F.col("tavg"))).alias("_one_before"),
        )
    )
    joined = forecast.select("target_date", "tavg_fc").join(before, "target_date", "left")
    mean = (F.col("_two_before") + F.col("_one_before") + F.col("tavg_fc")) / 3
    return joined.select(
        "target_date",
        half_even(mean, 1).alias("tavg_3day_fc"),
        half_even(cooling_degrees(mean), 1).alias("cdd_3day_fc"),
        half_even(heating_degrees(mean), 1).alias("hdd_3day_fc"),
    )


def inference_rows(history: DataFrame, forecast: DataFrame, inertia: DataFrame) -> DataFrame:
    """Merge the blocks and project to the model's ordered features.

    Both weather blocks are keyed by date, so they are first joined to each other and
    reach the zones as one bounded table.
    """
    weather = forecast.join(inertia, "target_date", "left")
    target = F.col("target_date")
    return (
        join_by_day(history, weather, "target_date", on="target_date")
        .withColumns({"is_weekend_next": is_weekend(target), "is_holiday_next": is_federal_holiday(target)})
        .select("zone", "target_date", *INFERENCE_FEATURES)
    )


def inertia_skew(training: DataFrame, live: DataFrame) -> DataFrame:
    """Days on which serving-time three-day degree days differ from the training ones."""
    shifted = training.select(F.date_add("period", 1).alias("target_date"), "zone", "cdd_3day_fc", "hdd_3day_fc")
    served = live.select(
        "target_date", F.col("cdd_3day_fc").alias("cdd_3day_live"), F.col("hdd_3day_fc").alias("hdd_3day_live")
    )
    both = join_by_day(shifted, served, "target_date", on="target_date").dropna()
    return both.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(F.col("cdd_3day_fc") != F.col("cdd_3day_live")).alias("cdd_differs"),
        F.count_if(F.col("hdd_3day_fc") != F.col("hdd_3day_live")).alias("hdd_differs"),
        F.max(F.abs(F.col("cdd_3day_fc") - F.col("cdd_3day_live"))).alias("max_cdd_gap"),
        F.max(F.abs(F.col("hdd_3day_fc") - F.col("hdd_3day_live"))).alias("max_hdd_gap"),
    )
