import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltpanel.operators import scoring
from voltpanel.plans import jobs
from voltpanel.sinks import snapshots
from voltpanel.sinks import tables as sinks
from voltpanel.streaming import ingest

FEED = "zone string, date date, demand double, is_imputed boolean, seq bigint"
D = dt.date
DROPS = [
    [("a", D(2026, 7, 30), 10.0, False, 1), ("a", D(2026, 7, 31), 11.0, False, 2), ("b", D(2026, 8, 1), 5.0, False, 3)],
    [("a", D(2026, 7, 31), 12.0, False, 4), ("a", D(2026, 8, 1), 13.0, False, 5)],
    # A late file with a superseded value, and a revision twice in one file.
    [("a", D(2026, 7, 31), 11.0, False, 2), ("b", D(2026, 8, 1), 6.0, False, 6), ("b", D(2026, 8, 1), 7.0, False, 7)],
]
WANT = [("a", D(2026, 7, 30), 10.0), ("a", D(2026, 7, 31), 12.0), ("a", D(2026, 8, 1), 13.0), ("b", D(2026, 8, 1), 7.0)]


def land(spark, tmp_path, order):
    # File sources take files by modification time, so they are written in order.
    for place, i in enumerate(order):
        frame = spark.createDataFrame(DROPS[i], FEED).coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "landing"))
    return str(tmp_path / "landing")


def demand(spark, path):
    return sorted((r.zone, r.date, r.demand) for r in sinks.read_monthly_table(spark, path).collect())


@pytest.mark.parametrize("order, per_batch", [((0, 1, 2), None), ((0, 1, 2), 1), ((2, 1, 0), 1)])
def test_one_batch_or_many_give_the_same_table(spark, tmp_path, order, per_batch):
    landing, path = land(spark, tmp_path, order), str(tmp_path / "demand")
    feed = ingest.landed_files(spark, landing, FEED, files_per_batch=per_batch)
    ingest.run_upserts(feed, path, str(tmp_path / "state"))
    assert demand(spark, path) == WANT


def test_restart_and_replay_change_nothing(spark, tmp_path):
    landing, path = land(spark, tmp_path, (0, 1)), str(tmp_path / "demand")
    feed = ingest.landed_files(spark, landing, FEED, files_per_batch=1)
    ingest.run_upserts(feed, path, str(tmp_path / "state"))
    land(spark, tmp_path, (2,))
    ingest.run_upserts(feed, path, str(tmp_path / "state"))
    assert demand(spark, path) == WANT
    ingest.run_upserts(feed, path, str(tmp_path / "fresh-state"))
    assert demand(spark, path) == WANT


@pytest.mark.parametrize("order, per_batch", [((0, 1, 2), None), ((2, 1, 0), 1), ((0, 1, 2, 1, 0, 2), 1)])
def test_newest_rows_as_state_give_the_same_table(spark, tmp_path, order, per_batch):
    landing, path = land(spark, tmp_path, order), str(tmp_path / "demand")
    feed = ingest.landed_files(spark, landing, FEED, files_per_batch=per_batch)
    ingest.run_upserts(feed, path, str(tmp_path / "state"), changes_only=True)
    assert demand(spark, path) == WANT
    made = snapshots.versions(spark, path)
    # Files that bring nothing new make no version, also after a restart.
    land(spark, tmp_path, (0, 2))
    ingest.run_upserts(feed, path, str(tmp_path / "state"), changes_only=True)
    assert demand(spark, path) == WANT and snapshots.versions(spark, path) == made
    if len(order) == 6:
        assert len(made) == 3
    extra = spark.createDataFrame([("a", D(2026, 7, 30), None, True, 9), (None, D(2026, 7, 30), 1.0, True, None)], FEED)
    extra.coalesce(1).write.mode("append").parquet(landing)
    ingest.run_upserts(feed, path, str(tmp_path / "state"), changes_only=True)
    rows = {(r.zone, r.date): (r.demand, r.seq) for r in sinks.read_monthly_table(spark, path).collect()}
    assert rows[("a", D(2026, 7, 30))] == (None, 9) and rows[(None, D(2026, 7, 30))] == (1.0, None) and len(rows) == 5
    assert len(snapshots.versions(spark, path)) == len(made) + 1


def test_scores_follow_revisions_inside_the_window(spark, tmp_path):
    predictions = [("a", D(2026, 7, d), 10.0, "m", "{}") for d in (30, 31)] + [("b", D(2026, 8, 1), 10.0, "m", "{}"), ("a", D(2026, 6, 1), 1.0, "m", "{}")]
    paths = {name: str(tmp_path / name) for name in ("predictions", "demand", "scores")}
    rows = spark.createDataFrame(predictions, "zone string, target_date date, predicted_demand double, model_version string, features string")
    sinks.create_monthly_table(rows, paths["predictions"], "target_date")
    landing = land(spark, tmp_path, (0, 1, 2))
    feed = ingest.landed_files(spark, landing, FEED, files_per_batch=1)
    ingest.run_rescoring(feed, paths["predictions"], paths["demand"], paths["scores"], str(tmp_path / "state"), "2026-08-02")
    got = sorted((r.zone, r.target_date, r.actual_demand, r.error) for r in sinks.read_monthly_table(spark, paths["scores"]).collect())
    assert got == [("a", D(2026, 7, 30), 10.0, 0.0), ("a", D(2026, 7, 31), 12.0, -2.0), ("b", D(2026, 8, 1), 7.0, 3.0)]


def test_daily_evaluation_refreshes_only_the_window(spark):
    key = "zone string, target_date date"
    predictions = spark.createDataFrame(
        [("a", D(2026, 7, 1), 10.0, "m", "{}"), ("a", D(2026, 8, 16), 120.0, "m", "{}")],
        key + ", predicted_demand double, model_version string, features string",
    )
    table = spark.createDataFrame(
        [("a", D(2026, 7, 1), 99.0, False), ("a", D(2026, 8, 16), 100.0, False)], "zone string, date date, demand double, is_imputed boolean"
    )
    first = table.replace(99.0, 20.0).replace(100.0, 60.0)
    stored = scoring.score_rows(scoring.prediction_actuals(predictions, first, "2026-01-01", "2026-12-31"))
    scores, trailing = jobs.daily_evaluation(predictions, table, stored, "2026-08-17")
    assert {r.target_date: r.actual_demand for r in scores.collect()} == {D(2026, 7, 1): 20.0, D(2026, 8, 16): 100.0}
    assert {r.last_rows: (r["count"], r.mae) for r in trailing.collect()} == {7: (1, 20.0), 30: (1, 20.0)}


def test_today_is_taken_where_the_feed_is(spark):
    ny, utc = spark.range(1).select(jobs.today_in(), jobs.today_in("UTC")).first()
    assert (utc - ny).days in (0, 1)


def test_every_zone_has_a_forecast_status(spark, monkeypatch):
    demand = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "zone string")
    split = lambda rows, date: (rows.filter("zone <> 'd'"), rows.filter("zone = 'd'"))
    names = jobs.INFERENCE_FEATURES
    full = [1.0] * len(names)
    rows = [("a", *full), ("b", None, *full[1:])]
    table = spark.createDataFrame(rows, "zone string, " + ", ".join(f"{c} double" for c in names))
    monkeypatch.setattr(jobs, "split_ready", split)
    monkeypatch.setattr(jobs, "inference_table", lambda *_: table.withColumn("target_date", F.to_date(F.lit("2020-01-04"))))
    got = {r.zone: (r.status, r.missing) for r in jobs.forecast_status(demand, None, "2020-01-04").collect()}
    assert got == {"a": ("predicted", []), "b": ("incomplete", [names[0]]), "c": ("incomplete", names), "d": ("held_over", [])}
    assert jobs.forecast_status(demand, None, "2020-01-04").count() == 4
