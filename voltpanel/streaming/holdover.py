"""Forecast runs that keep the zones they could not serve and try them again.

The ledger is a stored table of one row per (zone, target date): what became of it, how often
it was tried, and when first and last. A run tries every zone for its own target date and
everything the ledger still holds open, so a zone whose demand was late is predicted by the
first later run that finds it, without anyone naming it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpanel.session import materialised
from voltpanel.sinks.tables import read_monthly_table, table_exists, upsert_table

KEYS = ["zone", "target_date"]
LEDGER = "zone string, target_date date, status string, tries int, first_run date, last_run date"
OPEN = ["held_over", "incomplete"]
MAX_TRIES = 3
# The exit states of a run, all zones served or some left to try again.
DONE, TRY_AGAIN = 0, 75


def due(ledger: DataFrame, zones: DataFrame, target_date: str, run_date: str) -> DataFrame:
    """What a run has to try: open ledger rows, and zones the ledger does not know for the date."""
    waiting = ledger.filter(F.col("status").isin(OPEN)).select(*KEYS, "tries", "first_run")
    today = zones.select("zone").distinct().withColumn("target_date", F.to_date(F.lit(target_date)))
    fresh = today.join(ledger.select(*KEYS), KEYS, "left_anti")
    return waiting.unionByName(fresh.withColumns({"tries": F.lit(0), "first_run": F.to_date(F.lit(run_date))}))


def with_readiness(pairs: DataFrame, demand: DataFrame) -> DataFrame:
    """Add ``ready``: whether demand for the day before the target date has arrived."""
    there = demand.filter(F.col("value").isNotNull()).select("zone", F.date_add("period", 1).alias("target_date")).distinct()
    return pairs.join(there.withColumn("ready", F.lit(True)), KEYS, "left").withColumn("ready", F.coalesce("ready", F.lit(False)))


def after_run(tried: DataFrame, predicted: DataFrame, run_date: str, max_tries: int = MAX_TRIES) -> DataFrame:
    """Ledger rows of what a run tried: predicted, held_over (no demand yet), incomplete (demand
    but no prediction), or missed (the last try failed too)."""
    done = predicted.select(*KEYS).distinct().withColumn("_done", F.lit(True))
    tries = (F.col("tries") + 1).cast("int")
    status = (
        F.when(F.col("_done"), "predicted")
        .when(tries >= max_tries, "missed")
        .when(F.col("ready"), "incomplete")
        .otherwise("held_over")
    )
    return tried.join(done, KEYS, "left").select(
        *KEYS, status.alias("status"), tries.alias("tries"), "first_run", F.to_date(F.lit(run_date)).alias("last_run")
    )


def run_forecast(
    spark: SparkSession, ledger_path: str, predictions_path: str, demand: DataFrame, target_date: str, run_date: str,
    predict: Callable[[DataFrame], DataFrame], max_tries: int = MAX_TRIES,
) -> int:
    """One run: predict what is ready, store the predictions, then the ledger; the exit state.

    ``demand`` holds ``zone, period, value`` as known now. ``predict`` gets the ready (zone,
    target_date) rows and returns theirs with the prediction's columns; those it leaves out
    stay open. A run that dies before the ledger is stored is repeated whole: predictions are
    upserted by key. A second run for a date tries only what is open.
    """
    known = table_exists(spark, ledger_path)
    ledger = read_monthly_table(spark, ledger_path) if known else spark.createDataFrame([], LEDGER)
    tried = materialised(with_readiness(due(ledger, demand, target_date, run_date), demand), "tried")
    predicted = materialised(predict(tried.filter("ready").select(*KEYS)), "predicted")
    upsert_table(spark, predictions_path, predicted, KEYS, "target_date")
    rows = materialised(after_run(tried, predicted, run_date, max_tries), "ledger-rows")
    upsert_table(spark, ledger_path, rows, KEYS, "target_date")
    return DONE if rows.filter(F.col("status").isin(OPEN)).isEmpty() else TRY_AGAIN
