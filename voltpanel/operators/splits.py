"""Time-based splits, expanding-window folds and persistence baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N_FOLDS = 5


def time_split(rows: DataFrame, train_end: str, val_end: str, day: str = "period") -> DataFrame:
    """Add ``split``: train < train_end <= val < val_end <= test."""
    return rows.withColumn(
        "split",
        F.when(F.col(day) < F.to_date(F.lit(train_end)), "train")
        .when(F.col(day) < F.to_date(F.lit(val_end)), "val")
        .otherwise("test"),
    )


def split_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("period").alias("first_day"),
        F.max("period").alias("last_day"),
        F.sum("is_imputed").alias("imputed_rows"),
    )


def _date_positions(rows: DataFrame) -> DataFrame:
    """Zero-based position of every distinct date, and the number of dates.

    Dates are ranked inside their year, in parallel; only the per-year counts (one row
    per calendar year) go through a single ordered window.
    """
    dates = rows.select("period").distinct().withColumn("_year", F.year("period"))
    in_year = Window.partitionBy("_year").orderBy("period")
    years = Window.orderBy("_year")
    per_year = dates.groupBy("_year").agg(F.count(F.lit(1)).alias("_days"))
    offsets = per_year.select(
        "_year",
        (F.sum("_days").over(years.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_days")).alias("_offset"),
        F.sum("_days").over(years.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    ranked = dates.withColumn("_rank", F.row_number().over(in_year) - 1)
    return ranked.join(offsets, "_year").select(
        "period", (F.col("_offset") + F.col("_rank")).alias("_position"), "_total"
    )


def expanding_blocks(rows: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Add ``block`` 0..n_folds: fold k trains on blocks below k and tests on block k.

    Test blocks have ``dates // (n_folds + 1)`` dates each, counted back from the end.
    Folds are cut on dates, so no zone's future leaks into another zone's training rows.
    """
    size = F.floor(F.col("_total") / F.lit(n_folds + 1))
    first_test = F.col("_total") - size * n_folds
    into = F.floor((F.col("_position") - first_test) / F.greatest(size, F.lit(1))) + 1
    block = F.when(F.col("_position") < first_test, F.lit(0)).otherwise(into).cast("int")
    positions = _date_positions(rows).select("period", block.alias("block"))
    return rows.join(F.broadcast(positions), "period")


def fold_report(blocks: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Per fold: rows and date span of the training and the test part."""
    folds = blocks.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds))))
    trains, tests = F.col("block") < F.col("fold"), F.col("block") == F.col("fold")
    return folds.filter(trains | tests).groupBy("fold").agg(
        F.count_if(trains).alias("train_rows"),
        F.max(F.when(trains, F.col("period"))).alias("train_last"),
        F.count_if(tests).alias("test_rows"),
        F.min(F.when(tests, F.col("period"))).alias("test_first"),
        F.max(F.when(tests, F.col("period"))).alias("test_last"),
    )


def persistence_predictions(rows: DataFrame, lags: tuple[int, ...] = (0, 7, 28)) -> DataFrame:
    """One row per input row and lag, with the lagged demand as the prediction of ``target``."""
    entries = [F.struct(F.lit(f"persistence (lag_{n})").alias("model"), F.col(f"lag_{n}").alias("predicted")) for n in lags]
    return (
        rows.select("zone", "period", F.col("target").alias("actual"), F.inline(F.array(*entries)))
        .filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    )
