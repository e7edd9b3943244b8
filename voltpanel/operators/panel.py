"""Windows over one series, and calendar densification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series_window(day: str = "period") -> WindowSpec:
    """The one window all series operators share: by zone, in day-number order.

    The panel holds at most one row per zone and calendar day, so a window partition is
    bounded by the calendar (a century is 36,525 rows) however large the raw feed was.
    Using one specification everywhere lets a chain of operators share a single shuffle
    and sort; day numbers allow both ROWS and RANGE frames on it.
    """
    return Window.partitionBy("zone").orderBy(F.unix_date(F.col(day)))


def densify(panel: DataFrame) -> DataFrame:
    """One row per zone and calendar day between its first and last day.

    Each row stretches over the days up to the next one, so the calendar comes out of the
    series itself: no generated calendar, no join back.  Added days have a null value and
    ``is_missing`` 1.  A day that a zone has twice raises: every window after this relies
    on the key.
    """
    next_day = F.lead("period").over(series_window())
    repeated = F.raise_error(F.concat_ws(" ", F.lit("more than one row for"), "zone", F.col("period").cast("string")))
    last_covered = (
        F.when(next_day > F.col("period"), F.date_sub(next_day, 1))
        .when(next_day.isNull(), F.col("period"))
        .otherwise(repeated.cast("date"))
    )
    stretched = panel.select("zone", "value", "period", F.sequence("period", last_covered).alias("_days"))
    value = F.when(F.col("_day") == F.col("period"), F.col("value"))
    return (
        stretched.select("zone", "value", "period", F.explode("_days").alias("_day"))
        .select("zone", F.col("_day").alias("period"), value.alias("value"))
        .withColumn("is_missing", F.col("value").isNull().cast("int"))
    )
