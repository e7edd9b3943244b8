"""Exploratory statistics behind the features.

Grouped results go through partial aggregation; quantiles and windows run inside a zone,
whose rows are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltpanel.functions import pearson
from voltpanel.functions.thermal import COOLING_BASE, HEATING_BASE
from voltpanel.operators.panel import series_window

NUMERIC_COLUMNS = [
    "value",
    "prcp",
    "snow",
    "snwd",
    "tmin",
    "tmax",
    "rh_mean",
    "rh_max",
    "dew_point",
    "solar_rad",
    "cloud_cover",
    "daylight_hours",
    "sunshine_hours",
    "is_weekend",
    "is_holiday",
    "day_of_week",
    "tavg",
    "hdd",
    "cdd",
    "tavg_3day",
    "cdd_3day",
    "hdd_3day",
    "tavg_lag1",
]
REGIME_FEATURES = [
    "cdd",
    "hdd",
    "cdd_3day",
    "hdd_3day",
    "tavg",
    "dew_point",
    "solar_rad",
    "daylight_hours",
    "rh_mean",
    "cloud_cover",
    "prcp",
    "is_weekend",
    "is_holiday",
]
AUTOCORRELATION_LAGS = [1, 2, 7, 14, 30, 365]
SUMMER_MONTHS = [6, 7, 8]


def observed(table: DataFrame) -> DataFrame:
    return table.filter(F.col("is_imputed") == 0)


def yearly_level(table: DataFrame) -> DataFrame:
    return table.groupBy("zone", F.year("period").alias("year")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean_demand")
    )


def temperature_bins(table: DataFrame, width: int = 5, top: int = 100) -> DataFrame:
    """Demand by right-closed temperature bin over (0, top], with the step from the bin before."""
    upper = (F.ceil(F.col("tavg") / width) * width).cast("int")
    bins = (
        table.filter((F.col("tavg") > 0) & (F.col("tavg") <= top))
        .groupBy("zone", upper.alias("bin_upper"))
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean_demand"))
    )
    before = F.lag("mean_demand").over(Window.partitionBy("zone").orderBy("bin_upper"))
    return bins.select(
        "zone",
        (F.col("bin_upper") - width).alias("bin_lower"),
        "bin_upper",
        "n",
        "mean_demand",
        (F.col("mean_demand") - before).alias("change"),
    )


def yoy_overlay(table: DataFrame) -> DataFrame:
    """Day-of-year rows, one column ``y<year>`` for every year that the table holds."""
    year = F.concat(F.lit("y"), F.year("period")).alias("year")
    by_year = table.select("zone", F.dayofyear("period").alias("doy"), year, "value")
    return by_year.groupBy("zone", "doy").pivot("year").agg(F.max("value"))


def yoy_smoothed(table: DataFrame, size: int = 7, min_rows: int = 300) -> DataFrame:
    """Centred mean inside each year, for years with enough rows; null at the edges."""
    half = size // 2
    year = Window.partitionBy("zone", "year")
    around = year.orderBy("period").rowsBetween(-half, half)
    smooth = F.when(F.count("value").over(around) == size, F.avg("value").over(around))
    return (
        table.withColumn("year", F.year("period"))
        .withColumns({"_rows": F.count(F.lit(1)).over(year), "smoothed": smooth})
        .filter(F.col("_rows") >= min_rows)
        .select("zone", "year", F.dayofyear("period").alias("doy"), "smoothed")
    )


def weekday_box(table: DataFrame, months: list[int] = SUMMER_MONTHS) -> DataFrame:
    """Box-plot numbers by weekday; whiskers are the extreme values within 1.5 IQR."""
    by = ["zone", "day_name"]
    quartiles = F.percentile("value", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).over(Window.partitionBy(*by))
    season = table.filter(F.month("period").isin(months)).select(*by, "value", quartiles.alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    fence = (q3 - q1) * 1.5
    inside = F.when(F.col("value").between(q1 - fence, q3 + fence), F.col("value"))
    return season.groupBy(*by).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean_demand"),
        F.first(q1).alias("q1"),
        F.first(F.col("_q")[1]).alias("median"),
        F.first(q3).alias("q3"),
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
        F.count_if(inside.isNull()).alias("n_outside"),
    )


def calendar_effects(table: DataFrame, months: list[int] = SUMMER_MONTHS) -> DataFrame:
    """Summer weekend gap, and the holiday effect on weekdays, in percent."""
    value, weekend = F.col("value"), F.col("is_weekend") == 1
    summer, holiday = F.month("period").isin(months), F.col("is_holiday") == 1
    means = table.groupBy("zone").agg(
        F.avg(F.when(summer & ~weekend, value)).alias("summer_weekday"),
        F.avg(F.when(summer & weekend, value)).alias("summer_weekend"),
        F.count_if(~weekend & holiday).alias("holiday_weekdays"),
        F.avg(F.when(~weekend & holiday, value)).alias("holiday_mean"),
        F.avg(F.when(~weekend & ~holiday, value)).alias("ordinary_mean"),
    )

    def drop_pct(low: str, high: str) -> Column:
        return 100.0 * (1 - F.try_divide(F.col(low), F.col(high)))

    return means.withColumns(
        {
            "weekend_gap_pct": drop_pct("summer_weekend", "summer_weekday"),
            "holiday_drop_pct": drop_pct("holiday_mean", "ordinary_mean"),
        }
    )


def autocorrelation(table: DataFrame, lags: list[int] = AUTOCORRELATION_LAGS) -> DataFrame:
    """Autocorrelation per zone against the full-series mean, every lag divided by n.

    Lagged values come from the shared window, so all lags cost one shuffle.
    """
    w = series_window()
    mean = F.avg("value").over(Window.partitionBy("zone"))
    centred = table.select("zone", "period", (F.col("value") - mean).alias("value"))
    lagged = centred.withColumns({f"_lag_{n}": F.lag("value", n).over(w) for n in lags})
    spread = F.sum(F.col("value") * F.col("value"))
    sums = lagged.groupBy("zone").agg(
        *[F.try_divide(F.sum(F.col("value") * F.col(f"_lag_{n}")), spread).alias(str(n)) for n in lags]
    )
    return sums.unpivot("zone", [str(n) for n in lags], "lag", "autocorrelation").withColumn(
        "lag", F.col("lag").cast("int")
    )


def regime(tavg: Column) -> Column:
    """Boundaries equal the degree-day bases, so one-sided features are fully on or off."""
    return (
        F.when(tavg < HEATING_BASE, "heating")
        .when(tavg <= COOLING_BASE, "mild")
        .when(tavg > COOLING_BASE, "cooling")
    )


def regime_correlation(table: DataFrame, features: list[str] = REGIME_FEATURES) -> DataFrame:
    """Correlation with demand per zone, by temperature regime and pooled, over observed rows.

    A feature that is constant within a regime has a null there, never a zero.
    """
    regimes = F.array(regime(F.col("tavg")), F.lit("pooled"))
    rows = observed(table).withColumn("regime", F.explode(regimes)).filter(F.col("regime").isNotNull())
    wide = rows.groupBy("zone", "regime").agg(*[pearson(F.col(c), F.col("value")).alias(c) for c in features])
    return wide.unpivot(["zone", "regime"], features, "feature", "correlation")


def regime_profile(table: DataFrame, features: tuple[str, ...] = ("cdd", "hdd")) -> DataFrame:
    """Size, share, level and spread of each regime; spread and distinct count of features."""
    rows = observed(table).withColumn("regime", regime(F.col("tavg"))).filter(F.col("regime").isNotNull())
    profile = rows.groupBy("zone", "regime").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean_demand"),
        F.stddev_samp("value").alias("sd_demand"),
        *[F.count_distinct(c).alias(f"{c}_distinct") for c in features],
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in features],
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy("zone"))
    return profile.withColumn("share", share)


def thermal_inertia_effect(table: DataFrame, hot_above: float = 8.0) -> DataFrame:
    """Hot weekdays: does three-day heat explain demand better than the day's own?"""
    hot = observed(table).filter((F.col("cdd") > hot_above) & (F.col("is_weekend") == 0))
    building = F.col("cdd_3day") >= F.col("cdd")
    return hot.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"),
        pearson(F.col("cdd_3day"), F.col("value")).alias("corr_cdd_3day"),
        pearson(F.col("cdd"), F.col("value")).alias("corr_cdd"),
        F.count_if(building).alias("n_after_heat"),
        F.avg(F.when(building, F.col("value"))).alias("mean_after_heat"),
        F.avg(F.when(~building, F.col("value"))).alias("mean_after_milder"),
    )
