"""Checks: each is a query whose rows are the findings; ``require_*`` raise on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltpanel.functions import any_null
from voltpanel.schemas import REQUIRED_READINGS

SHOWN = 20


class DemandDataUnavailable(RuntimeError):
    """The demand a forecast has to be anchored on has not arrived yet."""


def require_columns(rows: DataFrame, names: list[str], what: str = "input") -> None:
    missing = sorted(set(names) - set(rows.columns))
    if missing:
        raise ValueError(f"missing {what} columns: {missing}")


def require_feature_order(rows: DataFrame, features: list[str], keys: list[str]) -> None:
    """The columns after the keys must be the model's features, in the model's order."""
    got = [c for c in rows.columns if c not in keys]
    if got != features:
        raise ValueError(f"feature mismatch: expected {features}, got {got}")


def feature_null_report(rows: DataFrame, features: list[str]) -> DataFrame:
    """Nulls per feature, counted for all features in one aggregate."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in features]
    )
    return counts.unpivot("n_rows", features, "feature", "n_null")


def require_no_nulls(rows: DataFrame, features: list[str]) -> None:
    bad = feature_null_report(rows, features).filter("n_null > 0").select("feature").collect()
    if bad:
        raise ValueError(f"missing model features: {sorted(r.feature for r in bad)}")


def invalid_weather(rows: DataFrame, required: list[str] = REQUIRED_READINGS) -> DataFrame:
    """Days on which a required reading is missing, with the names of what is missing."""
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    keys = [c for c in ("zone", "date") if c in rows.columns]
    return rows.filter(any_null(required)).select(*keys, F.array_join(names, ",").alias("missing"))


def require_valid_weather(rows: DataFrame, required: list[str] = REQUIRED_READINGS) -> DataFrame:
    """The rows unchanged, or an error that counts the bad days and names the first ones."""
    bad = invalid_weather(rows, required)
    found = bad.count()
    if found:
        first = sorted(str(r.date) for r in bad.orderBy("date").limit(SHOWN).collect())
        raise ValueError(f"missing required weather values on {found} days, from: {first}")
    return rows


def require_forecast_date(rows: DataFrame, expected: str) -> DataFrame:
    """Every row must be for the expected target date, and there must be one."""
    dates = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("target_date").alias("lo"), F.max("target_date").alias("hi")
    ).first()
    if not dates.n:
        raise ValueError("no forecast data returned")
    if str(dates.lo) != expected or str(dates.hi) != expected:
        raise ValueError(f"expected forecast for {expected}, got {dates.lo} .. {dates.hi}")
    return rows


def alignment_audit(features: DataFrame, panel: DataFrame) -> DataFrame:
    """Compare each row with the row of the next calendar day, where there is one.

    Counts pairs whose target, forecast temperature or holiday flag disagree with what
    the next day itself carries, and rows that have a target though ``panel`` (the series
    before any row was left out) lacks the next day.  Key joins rather than windows on
    purpose: the audit does not share code with the shift it checks.
    """

    def differs(left: str, right: str) -> Column:
        a, b = F.col(left), F.col(right)
        return F.count_if(F.abs(a - b) > F.lit(1e-8) + F.lit(1e-5) * F.abs(b))

    following = features.select(
        "zone",
        F.date_sub("period", 1).alias("period"),
        F.col("value").alias("_value"),
        F.col("tavg").alias("_tavg"),
        F.col("is_holiday").alias("_is_holiday"),
        F.lit(True).alias("_paired"),
    )
    days = panel.select("zone", F.date_sub("period", 1).alias("period"), F.lit(True).alias("_exists"))
    pairs = (
        features.select("zone", "period", "target", "tavg_fc", "is_holiday_next")
        .join(following, ["zone", "period"], "left")
        .join(days, ["zone", "period"], "left")
    )
    return pairs.groupBy("zone").agg(
        F.count("_paired").alias("pairs"),
        differs("target", "_value").alias("target_mismatches"),
        differs("tavg_fc", "_tavg").alias("weather_mismatches"),
        differs("is_holiday_next", "_is_holiday").alias("calendar_mismatches"),
        F.count_if(F.col("_exists").isNull() & F.col("target").isNotNull()).alias("absent_targets"),
    )


def require_aligned(features: DataFrame, panel: DataFrame) -> None:
    bad = alignment_audit(features, panel).filter(
        "target_mismatches + weather_mismatches + calendar_mismatches + absent_targets > 0"
    )
    n = bad.count()
    if n:
        shown = [r.asDict() for r in bad.orderBy("zone").limit(SHOWN).collect()]
        raise ValueError(f"features are not aligned with the next day in {n} zones: {shown}")


def freshness_gate(demand: DataFrame, target_date: str) -> DataFrame:
    """Per zone: the latest day on or before the anchor, and whether the anchor is there."""
    anchor = F.date_sub(F.to_date(F.lit(target_date)), 1)
    return (
        demand.filter(F.col("value").isNotNull() & (F.col("period") <= anchor))
        .groupBy("zone")
        .agg(F.max("period").alias("latest"))
        .withColumn("status", F.when(F.col("latest") == anchor, "ready").otherwise("unavailable"))
    )


def require_fresh(demand: DataFrame, target_date: str) -> None:
    """Raise unless every zone has demand for the day before ``target_date``."""
    late = freshness_gate(demand, target_date).filter("status = 'unavailable'")
    n = late.count()
    if n or demand.isEmpty():
        shown = [f"{r.zone} (latest {r.latest})" for r in late.orderBy("zone").limit(SHOWN).collect()]
        raise DemandDataUnavailable(f"demand before {target_date} is not available for {n} zones: {shown}")


def key_violations(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    repeated = rows.groupBy(*keys).count().filter("count > 1")
    return _finding(repeated, label, f"primary key ({', '.join(keys)})")


def null_violations(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    return _finding(rows.filter(any_null(names)), label, f"not null ({', '.join(names)})")


def reference_violations(child: DataFrame, parent: DataFrame, keys: list[str], label: str) -> DataFrame:
    orphans = child.join(parent.select(*keys), keys, "left_anti")
    return _finding(orphans, label, f"foreign key ({', '.join(keys)})")


def _finding(bad: DataFrame, label: str, constraint: str) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(label).alias("table_name"), F.lit(constraint).alias("constraint"), "violations"
    )


def split_ready(demand: DataFrame, target_date: str) -> tuple[DataFrame, DataFrame]:
    """Demand of zones that can be forecast now, and of zones held over for a retry."""
    ready = freshness_gate(demand, target_date).filter("status = 'ready'").select("zone")
    return demand.join(ready, "zone", "left_semi"), demand.join(ready, "zone", "left_anti")
