"""Incremental ingest of a demand feed and re-scoring of revised days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltpanel.operators.scoring import in_trailing_window, score_rows
from voltpanel.sinks.tables import read_monthly_table, table_exists, upsert_table
from voltpanel.streaming.newest import newest_changes

DEMAND_KEY = ["zone", "date"]
SCORE_KEY = ["zone", "target_date"]


def landed_files(
    spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet", glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream over the files in a landing folder."""
    reader = spark.readStream.schema(schema).format(file_format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_upserts(feed: DataFrame, table_path: str, checkpoint: str, changes_only: bool = False) -> None:
    """Upsert everything that has landed into the demand table, then stop.

    ``feed`` streams ``zone, date, demand, is_imputed, seq``.  The row with the greatest
    ``seq`` per zone and date stays, so replayed, repeated and late files change nothing
    that a single pass over all files would not give.

    With ``changes_only`` the stream remembers the newest row of every key
    (``streaming.newest``), and a month is rewritten only if one of its rows really changes: files
    that repeat known rows or come late with superseded ones make no new version.  The
    table gives the same answer either way; a checkpoint is for one of the two.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            if not changes_only or not rows.isEmpty():
                upsert_table(batch.sparkSession, table_path, rows, DEMAND_KEY, "date", newest=["seq"])
        finally:
            rows.unpersist()

    source = newest_changes(feed, DEMAND_KEY, ["seq"]) if changes_only else feed
    writer = source.writeStream.outputMode("update") if changes_only else source.writeStream
    query = (
        writer.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def rescored(changes: DataFrame, predictions: DataFrame, today: str, days_back: int = 30) -> DataFrame:
    """Scores of predictions whose actual demand has just been published or revised."""
    actual = changes.select("zone", F.col("date").alias("target_date"), F.col("demand").alias("actual_demand"), "is_imputed")
    joined = predictions.select("zone", "target_date", "predicted_demand", "model_version").join(
        actual, SCORE_KEY, "inner"
    )
    return score_rows(in_trailing_window(joined, today, days_back))


def run_rescoring(
    feed: DataFrame, predictions_path: str, demand_path: str, scores_path: str, checkpoint: str, today: str,
    days_back: int = 30,
) -> None:
    """Per batch of changed demand: upsert it, then refresh the scores it touches.

    The scores are taken from the merged table, not from the batch, so a late file with
    an older ``seq`` cannot bring back a superseded actual.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            upsert_table(spark, demand_path, rows, DEMAND_KEY, "date", newest=["seq"])
            if table_exists(spark, predictions_path):
                merged = read_monthly_table(spark, demand_path)
                changed = merged.join(rows.select(*DEMAND_KEY).distinct(), DEMAND_KEY, "left_semi")
                scores = rescored(changed, read_monthly_table(spark, predictions_path), today, days_back)
                upsert_table(spark, scores_path, scores, SCORE_KEY, "target_date")
        finally:
            rows.unpersist()

    query = (
        feed.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
