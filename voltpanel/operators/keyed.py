"""Keyed combination of tables: newest-row dedup, upsert, joins on the calendar day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_newest(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``newest`` columns.

    An aggregate, not a ranking window: each task first reduces its own rows to one per
    key, so a key that holds a third of the input never lands whole in one task.  Equal
    ``newest`` are told apart by the other columns, so replays give the same row.
    """
    payload = [c for c in rows.columns if c not in keys]
    winner = F.max_by(F.struct(*payload), F.struct(*newest, F.struct(*payload))).alias("_winner")
    return rows.groupBy(*keys).agg(winner).select(*keys, "_winner.*").select(*rows.columns)


def merge_sources(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union overlapping sources, listed oldest first; on a shared key the newest wins."""
    ranked = [s.withColumn("_source_rank", F.lit(rank)) for rank, s in enumerate(sources)]
    union = ranked[0]
    for source in ranked[1:]:
        union = union.unionByName(source)
    return keep_newest(union, keys, ["_source_rank"]).drop("_source_rank")


def single_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, with the key enforced: a repeated key raises when the rows are computed."""
    payload = [c for c in rows.columns if c not in keys]
    held = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("more than one update for key "), F.to_json(F.struct(*keys))))
    )
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*payload)).alias("_row"))
    return grouped.select(*keys, held.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], newest: list[str] | None = None) -> DataFrame:
    """Insert-or-overwrite by key.  ``newest`` orders repeated keys inside ``updates``; without
    it a repeated key raises, because nothing says which of its rows should win.

    The stored side is only filtered by an anti join on the keys, so when the update is
    small the planner can keep the stored side where it is and ship just the keys.
    """
    updates = keep_newest(updates, keys, newest) if newest else single_rows(updates, keys)
    kept = table.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates.select(*table.columns)).select(*table.columns)


def merge_newest(table: DataFrame, updates: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Upsert for tables that store their ordering columns: the newest row per key stays.

    Late or repeated batches give the same table whatever order they come in.
    """
    return keep_newest(table.unionByName(updates.select(*table.columns)), keys, newest)


def one_row_per_day(rows: DataFrame, day: str) -> DataFrame:
    """Enforce the primary key of a table keyed by date alone; a repeated date raises."""
    payload = [c for c in rows.columns if c != day]
    grouped = rows.groupBy(day).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in payload])
    unique_day = F.when(F.col("_n") == 1, F.col(day)).otherwise(
        F.raise_error(F.concat(F.lit("more than one row for date "), F.col(day).cast("string")))
    )
    return grouped.select(unique_day.alias(day), *payload)


def join_by_day(panel: DataFrame, daily: DataFrame, day: str = "period", on: str = "period") -> DataFrame:
    """Left join of a date-keyed table onto the panel's ``on`` column, keeping every row.

    The date-keyed side is broadcast because its size is bounded by the type, not by the
    data: the enforced key allows one row per date and the date type holds about 3.7
    million dates (a century is 36,525 rows).  That keeps the panel's partitioning by
    zone.  A side that also carries ``zone`` has no such bound, so it is joined on both
    keys without a hint and adaptive execution picks the strategy from measured sizes.
    """
    daily = daily.withColumnRenamed(day, on)
    if "zone" in daily.columns:
        return panel.join(daily, ["zone", on], "left")
    return panel.join(F.broadcast(one_row_per_day(daily, on)), on, "left")
