"""Canonical tables derived from the test star schema.

The test tables hold no electricity or weather, so demand is order value per region (or
nation) and day, and weather is a seasonal curve moved by the day's line items.  Sums run
over whole hundredths and curve values are floored to 0.1, so that any engine derives the
same numbers bit for bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltpanel.functions import hours_from_seconds, is_weekend
from voltpanel.operators.features import modelling_table
from voltpanel.operators.impute import filled, ratio_impute
from voltpanel.operators.panel import series_window
from voltpanel.schemas import WEATHER_TIMELINE
from voltpanel.sources.feeds import timeline_to_rows
from voltpanel.sources.tables import read_table

TRAIN_END, VAL_END = "2000-01-01", "2001-01-01"
TODAY = "2001-08-02"
REVISED_STATUS = "P"


TEST_TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table with its declared schema: no footer is read while a query is built."""
    return read_table(spark, f"{sf_dir}/{name}.parquet", TEST_TABLES[name])


def customer_zones(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    zones = nation.select("n_nationkey", F.col("n_name").alias("zone"))
    if grain == "region":
        region = table(spark, sf_dir, "region")
        zones = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            "n_nationkey", F.col("r_name").alias("zone")
        )
    return customer.join(zones, customer.c_nationkey == zones.n_nationkey).select("c_custkey", "zone")


def order_rows(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    """``zone, period, status, cents`` per order."""
    orders = table(spark, sf_dir, "orders")
    zones = customer_zones(spark, sf_dir, grain)
    return orders.join(zones, orders.o_custkey == zones.c_custkey).select(
        "zone",
        F.to_date("o_orderdate").alias("period"),
        F.col("o_orderstatus").alias("status"),
        _hundredths(F.col("o_totalprice")).alias("cents"),
    )


def _hundredths(x: Column) -> Column:
    """Two-decimal amounts as whole hundredths: exact sums in any order, without decimals."""
    return F.rint(x * 100).cast("bigint")


def daily_sum(rows: DataFrame, by: tuple[str, ...] = ("zone", "period")) -> DataFrame:
    """Sums rounded half up to whole units."""
    return rows.groupBy(*by).agg(F.expr("(sum(cents) + 50) div 100").alias("value"))


def demand_raw(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    return daily_sum(order_rows(spark, sf_dir, grain))


def demand_provisional(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    """Demand as first published: orders still pending are not in it yet."""
    return daily_sum(order_rows(spark, sf_dir, grain).filter(F.col("status") != REVISED_STATUS))


def parent_series(raw: DataFrame) -> DataFrame:
    return raw.groupBy("period").agg(F.sum("value").alias("parent_value"))


def imputed(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    raw = demand_raw(spark, sf_dir, grain)
    return ratio_impute(raw, parent_series(raw))


def demand(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    return filled(imputed(spark, sf_dir, grain))


def _tenth(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10.0


def day_weather(spark: SparkSession, sf_dir: str, line_status: str | None = None) -> DataFrame:
    """All readings per ship day; one line status plays one of two overlapping sources."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), "l_quantity", "l_discount", "l_tax", "l_linestatus"
    )
    if line_status:
        lines = lines.filter(F.col("l_linestatus") == line_status)

    def mean(c: str) -> Column:
        return F.sum(_hundredths(F.col(c))) / 100.0 / F.count(c)

    means = lines.groupBy("date").agg(
        mean("l_quantity").alias("q"), mean("l_discount").alias("d"), mean("l_tax").alias("t")
    )
    season = F.cos(F.lit(2 * math.pi) * F.dayofyear("date") / 365.25)
    centre = F.lit(57.5) - 22.5 * season + 2.5 * (F.col("q") - 25.4)
    snowing = F.col("centre") < 40.0
    outage = (F.month("date") == 1) & (F.dayofmonth("date") == 17)
    return (
        means.withColumns({"centre": centre, "minutes": F.floor(360 - 80 * season) * 2})
        .withColumns(
            {
                "tmin": _tenth(F.col("centre") - 7),
                "tmax": _tenth(F.col("centre") + 7),
                "prcp": F.when(F.col("t") > 0.04, _tenth((F.col("t") - 0.04) * 60)).otherwise(0.0),
                "snow": F.when(snowing, _tenth(F.col("d") * 40)).otherwise(0.0),
                "snwd": F.when(outage, None).when(snowing, _tenth(F.col("d") * 90)).otherwise(0.0),
                "rh_mean": _tenth(55 + (F.col("d") - 0.05) * 400),
                "rh_max": _tenth(75 + (F.col("d") - 0.05) * 300),
                "dew_point": _tenth(F.col("centre") - 12 + (F.col("t") - 0.04) * 150),
                "solar_rad": _tenth(14 - 8 * season - (F.col("t") - 0.04) * 60),
                "cloud_cover": _tenth(50 + (F.col("t") - 0.04) * 600),
            }
        )
        .withColumns(
            {
                "daylight_duration": (F.col("minutes") * 60).cast("double"),
                "sunshine_duration": F.floor(F.col("minutes") * (1 - F.col("cloud_cover") / 200)) * 60.0,
                "sunrise": F.unix_date("date") * F.lit(86400).cast("bigint") + 43200 - F.col("minutes") * 30,
                "sunset": F.unix_date("date") * F.lit(86400).cast("bigint") + 43200 + F.col("minutes") * 30,
            }
        )
        .drop("q", "d", "t", "centre", "minutes")
    )


def station(weather: DataFrame) -> DataFrame:
    return weather.select("date", "prcp", "snow", "snwd", "tmin", "tmax")


def sky(weather: DataFrame) -> DataFrame:
    return weather.select(
        "date",
        "rh_mean",
        "rh_max",
        "dew_point",
        "solar_rad",
        "cloud_cover",
        hours_from_seconds(F.col("daylight_duration")).alias("daylight_hours"),
        hours_from_seconds(F.col("sunshine_duration")).alias("sunshine_hours"),
    )


def weather_readings(weather: DataFrame) -> DataFrame:
    """The same days under the names of the observed-weather table."""
    return weather.select(
        "date",
        F.col("dew_point").alias("dew"),
        F.col("prcp").alias("precip"),
        "snow",
        F.col("tmax").alias("tempmax"),
        F.col("tmin").alias("tempmin"),
        F.col("rh_mean").alias("humidity"),
        F.col("snwd").alias("snowdepth"),
        F.col("solar_rad").alias("solarenergy"),
        F.col("cloud_cover").alias("cloudcover"),
        "sunrise",
        "sunset",
    )


def modelling(spark: SparkSession, sf_dir: str, grain: str = "region") -> DataFrame:
    weather = day_weather(spark, sf_dir)
    return modelling_table(demand(spark, sf_dir, grain), station(weather), sky(weather))


# Payloads as a feed would land them.  Groups are calendar pieces, so a payload's arrays
# are bounded by the days in it.


def demand_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed page of JSON text per zone and month; order status plays the time zone."""
    timezone = (
        F.when(F.col("status") == "O", "Eastern").when(F.col("status") == "P", "Central").otherwise("Pacific")
    )
    records = daily_sum(order_rows(spark, sf_dir), ("zone", "period", "status")).select(
        "zone",
        F.date_format("period", "yyyy-MM").alias("page"),
        F.struct(
            F.col("period").cast("string").alias("period"),
            F.col("value").cast("string").alias("value"),
            timezone.alias("timezone"),
            F.lit("D").alias("type"),
        ).alias("record"),
    )
    pages = records.groupBy("zone", "page").agg(F.collect_list("record").alias("data"))
    total = F.sum(F.size("data")).over(Window.partitionBy("zone")).cast("string")
    payload = F.struct(F.struct(total.alias("total"), "data").alias("response"))
    return pages.select("zone", F.to_json(payload).alias("payload"))


def parsed(payloads: DataFrame, schema: str) -> DataFrame:
    carried = [c for c in payloads.columns if c != "payload"]
    return payloads.withColumn("_p", F.from_json("payload", schema)).select(*carried, "_p.*")


def archive_payload(weather: DataFrame) -> DataFrame:
    """One struct of parallel arrays per year, as JSON text."""
    names = {
        "time": F.col("date").cast("string"),
        "relative_humidity_2m_mean": F.col("rh_mean"),
        "relative_humidity_2m_max": F.col("rh_max"),
        "dew_point_2m_mean": F.col("dew_point"),
        "shortwave_radiation_sum": F.col("solar_rad"),
        "cloud_cover_mean": F.col("cloud_cover"),
        "daylight_duration": F.col("daylight_duration"),
        "sunshine_duration": F.col("sunshine_duration"),
    }
    day = F.struct(*[c.alias(n) for n, c in names.items()])
    years = weather.groupBy(F.year("date").alias("year")).agg(F.array_sort(F.collect_list(day)).alias("days"))
    return years.select(F.to_json(F.struct(F.struct(*[F.col(f"days.{n}").alias(n) for n in names]).alias("daily"))).alias("payload"))


def timeline_payload(weather: DataFrame) -> DataFrame:
    """One array of day structs per month, as JSON text; absent snow depth stays absent."""
    day = F.struct(
        F.col("date").cast("string").alias("datetime"),
        F.col("tempmax"),
        F.col("tempmin"),
        F.col("dew"),
        F.col("humidity"),
        F.col("precip"),
        F.col("snow"),
        F.col("snowdepth"),
        F.col("solarenergy"),
        F.col("cloudcover"),
        F.col("sunrise").alias("sunriseEpoch"),
        F.col("sunset").alias("sunsetEpoch"),
    )
    months = weather_readings(weather).groupBy(F.date_format("date", "yyyy-MM")).agg(F.collect_list(day).alias("days"))
    return months.select(F.to_json(F.struct("days")).alias("payload"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline_to_rows(parsed(timeline_payload(day_weather(spark, sf_dir)), WEATHER_TIMELINE))


# Stored tables.


def demand_table(panel: DataFrame) -> DataFrame:
    flag = F.col("is_imputed").cast("boolean") if "is_imputed" in panel.columns else F.lit(False)
    return panel.select(
        "zone", F.col("period").alias("date"), F.col("value").cast("double").alias("demand"), flag.alias("is_imputed")
    )


def persistence_table(panel: DataFrame, lag: int) -> DataFrame:
    """Stored predictions of a persistence model: the demand ``lag`` days before."""
    before = F.max("value").over(series_window().rangeBetween(-lag, -lag))
    inputs = F.struct(F.col("_before").alias(f"lag_{lag}"), is_weekend(F.col("period")).alias("is_weekend"))
    return (
        panel.withColumn("_before", before)
        .filter(F.col("_before").isNotNull())
        .select(
            "zone",
            F.col("period").alias("target_date"),
            F.col("_before").cast("double").alias("predicted_demand"),
            F.lit(f"persist_{lag}").alias("model_version"),
            F.to_json(inputs).alias("features"),
        )
    )
