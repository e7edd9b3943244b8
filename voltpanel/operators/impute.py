"""Gap filling of a child series from a complete parent series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltpanel.functions import half_even
from voltpanel.operators.keyed import join_by_day
from voltpanel.operators.panel import densify

NEAREST_DAYS = 14
HOLE_DAYS = 35


def _nearest_ratio(dense: DataFrame, by: list[str], nearest: int) -> DataFrame:
    """Add ``local_ratio``: mean child/parent ratio of the nearest observed days.

    A missing day that has ``k`` observed days before it can only draw on observed days
    number ``k-nearest+1 .. k+nearest``.  A RANGE frame over that running number reaches
    exactly those, so no missing-by-observed pairs are ever formed and the whole step
    stays inside the partitioning by zone.
    """
    in_order = Window.partitionBy(*by).orderBy(F.unix_date("period"))
    by_number = Window.partitionBy(*by).orderBy("_number")
    before, after = by_number.rangeBetween(1 - nearest, 0), by_number.rangeBetween(1, nearest)
    anchor_day = F.when(F.col("_ratio").isNotNull(), F.unix_date("period"))
    around = (
        dense.withColumn("_ratio", F.try_divide(F.col("value"), F.col("parent_value")))
        .withColumn("_number", F.count("_ratio").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns(
            {
                "_days_before": F.collect_list(anchor_day).over(before),
                "_before": F.collect_list("_ratio").over(before),
                "_days_after": F.collect_list(anchor_day).over(after),
                "_after": F.collect_list("_ratio").over(after),
            }
        )
    )
    # Both lists run in date order, so the nearest days are a tail of one and a head of the
    # other.  The j-th day back is among them unless the list ahead fills the rest with days
    # that are strictly closer; a tie therefore goes to the earlier day.
    today, n_before, n_after = F.unix_date("period"), F.size("_before"), F.size("_after")

    def belongs(back):
        rival = F.get("_days_after", F.lit(nearest) - back)
        return rival.isNull() | (rival - today >= today - F.get("_days_before", n_before - back))

    backs = F.when(n_before > 0, F.sequence(F.lit(1), n_before)).otherwise(F.array().cast("array<int>"))
    taken_back = F.size(F.filter(backs, belongs))
    used = F.least(F.lit(nearest), n_before + n_after)
    chosen = F.concat(
        F.slice("_before", n_before - F.col("_back") + 1, F.col("_back")), F.slice("_after", F.lit(1), used - F.col("_back"))
    )
    total = F.aggregate(chosen, F.lit(0.0), lambda acc, ratio: acc + ratio)
    is_gap = F.col("value").isNull()
    return (
        around.withColumn("_back", F.when(is_gap, taken_back))
        .withColumn("local_ratio", F.when(is_gap, F.try_divide(total, used)))
        .drop("_ratio", "_number", "_days_before", "_before", "_days_after", "_after", "_back")
    )


def ratio_impute(panel: DataFrame, parent: DataFrame, nearest: int = NEAREST_DAYS) -> DataFrame:
    """Densified panel with missing days filled as local ratio times the parent value.

    Ties in distance go to the earlier day.  Days the parent does not cover stay null, so
    that the caller can list them (``unfillable``) or leave them out (``filled``).
    """
    dense = join_by_day(densify(panel), parent)
    estimate = half_even(F.col("local_ratio") * F.col("parent_value")).cast("long")
    return _nearest_ratio(dense, ["zone"], nearest).select(
        "zone",
        "period",
        F.coalesce(F.col("value").cast("long"), estimate).alias("value"),
        F.col("is_missing").alias("is_imputed"),
        "parent_value",
    )


def filled(imputed: DataFrame) -> DataFrame:
    return imputed.filter(F.col("value").isNotNull()).select("zone", "period", "value", "is_imputed")


def unfillable(imputed: DataFrame) -> DataFrame:
    return imputed.filter(F.col("value").isNull()).select("zone", "period")


def impute_backtest(
    panel: DataFrame, parent: DataFrame, hole_days: int = HOLE_DAYS, nearest: int = NEAREST_DAYS
) -> DataFrame:
    """Error of the ratio imputer on synthetic holes, per zone.

    Every zone is cut into blocks of ``hole_days``; one pass hides the even blocks, the
    other the odd ones, so each observed day is predicted once from outside its own hole.
    """
    dense = join_by_day(densify(panel), parent).withColumn(
        "_first", F.min("period").over(Window.partitionBy("zone"))
    )
    block = F.floor(F.datediff("period", "_first") / F.lit(hole_days))
    passes = dense.withColumn("_pass", F.explode(F.array(F.lit(0), F.lit(1))))
    hidden = (F.pmod(block, F.lit(2)) == F.col("_pass")) & F.col("value").isNotNull()
    masked = passes.select(
        "zone",
        "_pass",
        "period",
        "parent_value",
        F.when(hidden, F.col("value")).alias("actual"),
        F.when(~hidden, F.col("value")).alias("value"),
    )
    predicted = half_even(F.col("local_ratio") * F.col("parent_value"))
    errors = (
        _nearest_ratio(masked, ["zone", "_pass"], nearest)
        .filter(F.col("actual").isNotNull())
        .select("zone", (F.abs(predicted - F.col("actual")) / F.abs(F.col("actual")) * 100.0).alias("ape"))
        .filter(F.col("ape").isNotNull())
    )
    return errors.groupBy("zone").agg(
        F.count("ape").alias("n"),
        F.avg("ape").alias("mape"),
        F.percentile("ape", F.lit(0.5)).alias("median_ape"),
        F.percentile("ape", F.lit(0.9)).alias("p90_ape"),
    )


def doy_ratio_impute(panel: DataFrame, parent: DataFrame, reach: int = 7) -> DataFrame:
    """Alternative imputer: mean ratio of observed days within ``reach`` days of the year.

    Ratios are first reduced to one sum and count per zone and day of year, then each of
    those is spread over the days it serves (the year wraps around).
    """
    dense = join_by_day(densify(panel), parent).withColumn("doy", F.dayofyear("period"))
    ratio = F.try_divide(F.col("value"), F.col("parent_value"))
    per_doy = dense.groupBy("zone", "doy").agg(F.sum(ratio).alias("_sum"), F.count(ratio).alias("_n"))
    serves = F.explode(F.sequence(F.col("doy") - reach, F.col("doy") + reach))
    wrapped = F.pmod(F.col("_served") - 1, F.lit(366)) + 1
    ratios = (
        per_doy.withColumn("_served", serves)
        .groupBy("zone", wrapped.alias("doy"))
        .agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("local_ratio"))
    )
    estimate = half_even(F.col("local_ratio") * F.col("parent_value")).cast("long")
    return dense.join(ratios, ["zone", "doy"], "left").select(
        "zone",
        "period",
        F.coalesce(F.col("value").cast("long"), estimate).alias("value"),
        F.col("is_missing").alias("is_imputed"),
        "parent_value",
    )
