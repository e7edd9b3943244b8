"""Table writers.

Monthly tables are snapshot logs (``sinks.snapshots``). An upsert rewrites only the months the
update touches into new folders and then commits them with one rename, so a reader sees the
whole update or nothing of it, a repeat gives the same table, and a job that dies between the
two leaves the old table whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltpanel.operators.keyed import keep_newest, merge_newest, single_rows, upsert
from voltpanel.sinks import snapshots
from voltpanel.sinks.snapshots import MONTH


def overwrite_table(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def overwrite_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Append result rows (a leaderboard); the schema travels with every file."""
    rows.write.mode("append").parquet(path)


def write_splits(rows: DataFrame, path: str) -> None:
    overwrite_table(rows, path, ["split"])


def _with_month(rows: DataFrame, day: str) -> DataFrame:
    return rows.withColumn(MONTH, F.year(day) * 100 + F.month(day))


def table_exists(spark: SparkSession, path: str) -> bool:
    return snapshots.latest(spark, path) is not None


def create_monthly_table(rows: DataFrame, path: str, day: str) -> None:
    """Make ``rows`` the whole table, as its next version; months without rows are gone."""
    spark = rows.sparkSession
    base, months = snapshots.latest(spark, path), snapshots.stage(_with_month(rows, day), path)
    snapshots.commit(spark, path, base, months, rows.schema, replace=True)


def read_monthly_table(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.read(spark, path)


def upsert_table(
    spark: SparkSession, path: str, updates: DataFrame, keys: list[str], day: str, newest: list[str] | None = None
) -> None:
    """Insert-or-overwrite ``updates`` by key into the month-partitioned table at ``path``.

    ``keys`` must include ``day``, so that a key stays in one month.  With ``newest``,
    those columns are stored too and decide between rows of a key, inside the update and
    against the table.  The touched months are a handful of numbers, which is all that
    reaches the driver; only their folders are opened. Older versions stay readable until
    ``snapshots.expire``.
    """
    if day not in keys:
        raise ValueError(f"the partitioning day {day!r} must be part of the key {keys}")
    base = snapshots.latest(spark, path)
    if base is None:
        merged = keep_newest(updates, keys, newest) if newest else single_rows(updates, keys)
    else:
        months = [r[MONTH] for r in _with_month(updates, day).select(MONTH).distinct().collect()]
        if not months:
            return
        touched = snapshots.read(spark, path, base, months)
        merged = merge_newest(touched, updates, keys, newest) if newest else upsert(touched, updates, keys)
    staged = snapshots.stage(_with_month(merged, day), path)
    snapshots.commit(spark, path, base, staged, merged.schema)
