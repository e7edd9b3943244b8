"""Schemas, keys and ordered feature lists.

Lists that a trained model depends on are fixed values: both names and order count.
"""

from __future__ import annotations

KEY = ["zone", "period"]

WEATHER_READINGS = [
    "dew",
    "precip",
    "snow",
    "tempmax",
    "tempmin",
    "humidity",
    "snowdepth",
    "solarenergy",
    "cloudcover",
]
REQUIRED_READINGS = ["tempmin", "tempmax", "dew", "humidity", "precip", "snow", "solarenergy", "cloudcover"]

LAGS = [1, 2, 3, 7, 14, 21, 28, 365, 366]
ROLLING = [7, 30]
HISTORY_FEATURES = ["lag_0"] + [f"lag_{n}" for n in LAGS] + [f"rolling_{n}" for n in ROLLING]

STATION_COLUMNS = ["prcp", "snow", "snwd", "tmin", "tmax"]
SKY_COLUMNS = [
    "rh_mean",
    "rh_max",
    "dew_point",
    "solar_rad",
    "cloud_cover",
    "daylight_hours",
    "sunshine_hours",
]
CALENDAR_COLUMNS = ["is_weekend", "is_holiday", "day_of_week", "day_name"]
THERMAL_COLUMNS = ["tavg", "hdd", "cdd", "tavg_3day", "cdd_3day", "hdd_3day", "tavg_lag1"]
MODELLING_COLUMNS = (
    ["period", "value", "is_imputed"] + STATION_COLUMNS + SKY_COLUMNS + CALENDAR_COLUMNS + THERMAL_COLUMNS
)

FORECAST_WEATHER = [
    "tmin",
    "tmax",
    "tavg",
    "dew_point",
    "rh_mean",
    "rh_max",
    "prcp",
    "snow",
    "snwd",
    "solar_rad",
    "cloud_cover",
    "sunshine_hours",
    "hdd",
    "cdd",
    "tavg_3day",
    "cdd_3day",
    "hdd_3day",
]
EXACT_NEXT = ["is_weekend", "is_holiday", "day_of_week", "daylight_hours"]

TODAY_FEATURES = (
    STATION_COLUMNS
    + SKY_COLUMNS
    + [c for c in CALENDAR_COLUMNS if c != "day_name"]
    + THERMAL_COLUMNS
    + HISTORY_FEATURES
)
FORECAST_FEATURES = (
    HISTORY_FEATURES
    + [f"{c}_fc" for c in FORECAST_WEATHER]
    + ["is_weekend_next", "is_holiday_next", "daylight_hours_next"]
)
INFERENCE_FEATURES = [c for c in FORECAST_FEATURES if c not in ("rh_max_fc", "sunshine_hours_fc")]
SIMPLE_FEATURES = HISTORY_FEATURES + ["hdd_fc", "cdd_fc", "dew_point_fc", "solar_rad_fc"]
SELECTED_FEATURES = [c for c in TODAY_FEATURES if c not in ("snow", "snwd")]
FEATURE_SETS = {
    "all": TODAY_FEATURES,
    "forecast": FORECAST_FEATURES,
    "inference": INFERENCE_FEATURES,
    "simple": SIMPLE_FEATURES,
    "select": SELECTED_FEATURES,
}

SCORE_COLUMNS = [
    "target_date",
    "predicted_demand",
    "actual_demand",
    "error",
    "abs_error",
    "pct_error",
    "abs_pct_error",
    "model_version",
    "is_imputed",
]


# Table and payload schemas as DDL, so that no session is needed to name them.


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


DEMAND_DAILY = _ddl({"zone": "STRING", "date": "DATE", "demand": "DOUBLE", "is_imputed": "BOOLEAN"})
WEATHER_DAILY = _ddl(
    {"date": "DATE"} | {c: "DOUBLE" for c in WEATHER_READINGS} | {"sunrise": "BIGINT", "sunset": "BIGINT"}
)
WEATHER_FORECAST = _ddl({"target_date": "DATE"} | {c: "DOUBLE" for c in WEATHER_READINGS})
PREDICTIONS = _ddl(
    {
        "zone": "STRING",
        "target_date": "DATE",
        "predicted_demand": "DOUBLE",
        "model_version": "STRING",
        "features": "STRING",
    }
)
PREDICTION_SCORES = _ddl(
    {
        "zone": "STRING",
        "target_date": "DATE",
        "predicted_demand": "DOUBLE",
        "actual_demand": "DOUBLE",
        "error": "DOUBLE",
        "abs_error": "DOUBLE",
        "pct_error": "DOUBLE",
        "abs_pct_error": "DOUBLE",
        "model_version": "STRING",
        "is_imputed": "BOOLEAN",
    }
)

DEMAND_FEED_PAGE = (
    "response STRUCT<total: STRING, data: ARRAY<STRUCT<period: STRING, value: STRING, timezone: STRING, type: STRING>>>"
)
ARCHIVE_ARRAYS = (
    "daily STRUCT<time: ARRAY<STRING>, relative_humidity_2m_mean: ARRAY<DOUBLE>, "
    "relative_humidity_2m_max: ARRAY<DOUBLE>, dew_point_2m_mean: ARRAY<DOUBLE>, "
    "shortwave_radiation_sum: ARRAY<DOUBLE>, cloud_cover_mean: ARRAY<DOUBLE>, "
    "daylight_duration: ARRAY<DOUBLE>, sunshine_duration: ARRAY<DOUBLE>>"
)
WEATHER_TIMELINE = (
    "days ARRAY<STRUCT<datetime: STRING, tempmax: DOUBLE, tempmin: DOUBLE, dew: DOUBLE, humidity: DOUBLE, "
    "precip: DOUBLE, snow: DOUBLE, snowdepth: DOUBLE, solarenergy: DOUBLE, cloudcover: DOUBLE, "
    "sunriseEpoch: BIGINT, sunsetEpoch: BIGINT>>"
)
STATION_CSV = "DATE DATE, PRCP DOUBLE, SNOW DOUBLE, SNWD DOUBLE, TMIN DOUBLE, TMAX DOUBLE"
