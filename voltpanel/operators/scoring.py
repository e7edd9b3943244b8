"""Scores of predictions against actual demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltpanel.functions import half_even
from voltpanel.operators.validate import require_columns
from voltpanel.schemas import SCORE_COLUMNS


def prediction_actuals(
    predictions: DataFrame, demand: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Predictions with the demand of their target date; ``start`` and ``end`` are inclusive, and open if not given."""
    actual = demand.select(
        "zone", F.col("date").alias("target_date"), F.col("demand").alias("actual_demand"), "is_imputed"
    )
    joined = predictions.join(actual, ["zone", "target_date"], "inner")
    if start is not None:
        joined = joined.filter(F.col("target_date") >= F.to_date(F.lit(start)))
    if end is not None:
        joined = joined.filter(F.col("target_date") <= F.to_date(F.lit(end)))
    return joined.select("zone", "target_date", "predicted_demand", "actual_demand", "model_version", "is_imputed")


def _zone(rows: DataFrame) -> list[str]:
    return ["zone"] if "zone" in rows.columns else []


def _ratio(part: Column, whole: Column) -> Column:
    """Quotient by the rules of floating point: a zero divisor gives infinity or NaN."""
    unbounded = F.signum(part.cast("double")) * F.lit(float("inf"))
    return F.when(whole == 0, unbounded).otherwise(F.try_divide(part.cast("double"), whole.cast("double")))


def score_rows(joined: DataFrame) -> DataFrame:
    """Error columns per prediction; rows whose actual was imputed are left out.

    A zero actual makes the percentage error infinite with the error's sign (NaN where the
    error is zero too), so it shows in every mean instead of leaving it unseen.
    """
    require_columns(
        joined, ["target_date", "predicted_demand", "actual_demand", "model_version", "is_imputed"], "score input"
    )
    error = F.col("predicted_demand") - F.col("actual_demand")
    pct = _ratio(F.col("error"), F.col("actual_demand")) * 100.0
    return (
        joined.filter(~F.col("is_imputed").cast("boolean"))
        .withColumn("error", error)
        .withColumns({"abs_error": F.abs("error"), "pct_error": pct})
        .withColumn("abs_pct_error", F.abs("pct_error"))
        .select(*_zone(joined), *SCORE_COLUMNS)
    )


def _or_nan(col: Column) -> Column:
    return F.coalesce(col, F.lit(float("nan")))


def score_summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """count, MAE, RMSE, MAPE and bias.  With no grouping an empty input gives 0 and NaN."""
    require_columns(scores, ["error", "abs_error", "abs_pct_error"], "summary input")
    return scores.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("count"),
        _or_nan(F.avg("abs_error")).alias("mae"),
        _or_nan(F.sqrt(F.avg(F.col("error") * F.col("error")))).alias("rmse"),
        _or_nan(F.avg("abs_pct_error")).alias("mape"),
        _or_nan(F.avg("error")).alias("bias"),
    )


def offline_metrics(predicted: DataFrame, by: list[str]) -> DataFrame:
    """Rounded MAE, RMSE (0 places), MAPE (2) and bias (1) of ``predicted`` against ``actual``."""
    err = F.col("predicted") - F.col("actual")
    return predicted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        half_even(F.avg(F.abs(err))).alias("mae"),
        half_even(F.sqrt(F.avg(err.cast("double") * err))).alias("rmse"),
        half_even(F.avg(F.abs(_ratio(err, F.col("actual")))) * 100.0, 2).alias("mape"),
        half_even(F.avg(err), 1).alias("bias"),
    )


def in_trailing_window(scores: DataFrame, today: str, days_back: int = 30) -> DataFrame:
    """Scores with a target date in ``[today - days_back, today - 1]``."""
    day = F.to_date(F.lit(today))
    return scores.filter(F.col("target_date").between(F.date_sub(day, days_back), F.date_sub(day, 1)))


def trailing_scores(scores: DataFrame, today: str, days_back: int = 30, sizes: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Summary of the last n scored rows (rows, not days) per zone inside the window."""
    newest_first = Window.partitionBy("zone").orderBy(F.desc("target_date"))
    ranked = in_trailing_window(scores, today, days_back).withColumn("_rank", F.row_number().over(newest_first))
    spread = ranked.withColumn("last_rows", F.explode(F.array(*[F.lit(n) for n in sizes])))
    return score_summary(spread.filter(F.col("_rank") <= F.col("last_rows")), ["zone", "last_rows"])


def latest_score(scores: DataFrame) -> DataFrame:
    payload = [c for c in SCORE_COLUMNS if c != "target_date"]
    return scores.groupBy("zone").agg(
        F.max("target_date").alias("target_date"), F.max_by(F.struct(*payload), "target_date").alias("_s")
    ).select("zone", "target_date", "_s.*")


def skill_scores(metrics: DataFrame, baseline: str) -> DataFrame:
    """Percentage by which each model's MAPE is below the baseline model's, per zone."""
    base = metrics.filter(F.col("model") == baseline).select("zone", F.col("mape").alias("base_mape"))
    skill = 100.0 * (1 - F.try_divide(F.col("mape"), F.col("base_mape")))
    return metrics.join(base, "zone").select("zone", "model", "mape", "base_mape", skill.alias("skill"))


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Models ranked by MAPE inside their zone; ties in name order."""
    order = Window.partitionBy("zone").orderBy("mape", "model")
    return metrics.withColumn("place", F.row_number().over(order))
