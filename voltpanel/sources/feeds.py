"""Landed payloads to rows.  Fetching is someone else's job: these read what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpanel.functions import hours_from_seconds
from voltpanel.schemas import ARCHIVE_ARRAYS, DEMAND_FEED_PAGE, STATION_CSV, WEATHER_TIMELINE
from voltpanel.sources.tables import by_name, read_header_csv

# Payload column names and the names used in the tables.
ARCHIVE_NAMES = {
    "time": "date",
    "relative_humidity_2m_mean": "rh_mean",
    "relative_humidity_2m_max": "rh_max",
    "dew_point_2m_mean": "dew_point",
    "shortwave_radiation_sum": "solar_rad",
    "cloud_cover_mean": "cloud_cover",
}
TIMELINE_NAMES = {
    "datetime": "date",
    "sunriseEpoch": "sunrise",
    "sunsetEpoch": "sunset",
}


def read_demand_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEMAND_FEED_PAGE).option("mode", "FAILFAST").json(path)


def demand_pages_to_rows(pages: DataFrame) -> DataFrame:
    """All pages' records, each still text, next to the columns the pages carry (a zone)."""
    carried = [c for c in pages.columns if c != "response"]
    return pages.select(*carried, F.inline("response.data"))


def feed_completeness(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records received against the total the feed announced."""
    return pages.groupBy(*(by or [])).agg(
        F.max(F.col("response.total").cast("bigint")).alias("expected"),
        F.sum(F.size("response.data")).alias("received"),
    ).withColumn("is_complete", F.col("received") >= F.col("expected"))


def demand_rows(records: DataFrame, timezone: str = "Eastern", series_type: str | None = None) -> DataFrame:
    """Records of one time zone (and series type) as ``date, demand``.

    Values arrive as text; one that is not a number raises, it does not become null.
    """
    kept = records.filter(F.col("timezone") == timezone)
    if series_type is not None:
        kept = kept.filter(F.col("type") == series_type)
    zone = ["zone"] if "zone" in records.columns else []
    return kept.select(
        *zone, F.col("period").cast("date").alias("date"), F.col("value").cast("double").alias("demand")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE_ARRAYS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def archive_to_rows(payload: DataFrame) -> DataFrame:
    """Parallel arrays to one row per day; durations from seconds to hours."""
    fields = payload.schema["daily"].dataType.names
    zipped = F.arrays_zip(*[F.col(f"daily.{name}") for name in fields])
    rows = payload.select(F.inline(zipped)).toDF(*fields)
    return (
        rows.withColumnsRenamed(ARCHIVE_NAMES)
        .withColumns(
            {
                "date": F.col("date").cast("date"),
                "daylight_hours": hours_from_seconds(F.col("daylight_duration")),
                "sunshine_hours": hours_from_seconds(F.col("sunshine_duration")),
            }
        )
        .drop("daylight_duration", "sunshine_duration")
    )


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEATHER_TIMELINE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def timeline_to_rows(payload: DataFrame) -> DataFrame:
    """One row per day of a weather timeline; missing snow depth means none."""
    rows = payload.select(F.inline("days")).withColumnsRenamed(TIMELINE_NAMES)
    return rows.select(
        F.col("date").cast("date").alias("date"),
        "dew",
        "precip",
        "snow",
        "tempmax",
        "tempmin",
        "humidity",
        F.coalesce("snowdepth", F.lit(0.0)).alias("snowdepth"),
        "solarenergy",
        "cloudcover",
        "sunrise",
        "sunset",
    )


def read_station_csv(spark: SparkSession, path: str, schema=STATION_CSV) -> DataFrame:
    """Station weather by the names of the file's header, lower-cased."""
    return normalise_header(by_name(read_header_csv(spark, path), schema))


def normalise_header(rows: DataFrame) -> DataFrame:
    """Lower-case column names; of names that collide then, the first column stays.

    Columns get positional names before any is looked up, because a look-up of a
    colliding name would be ambiguous.
    """
    lowered = [c.lower() for c in rows.columns]
    positional = rows.toDF(*[f"_{i}" for i in range(len(lowered))])
    first = {name: i for i, name in reversed(list(enumerate(lowered)))}
    return positional.select(*[F.col(f"_{i}").alias(name) for name, i in sorted(first.items(), key=lambda p: p[1])])


def since(rows: DataFrame, first_day: str, day: str = "date") -> DataFrame:
    """Rows from a day on; on a stored table the predicate reaches the scan."""
    return rows.filter(F.col(day) >= F.lit(first_day).cast("date"))
