"""Zones held over on one day are served by a later run."""

import datetime as dt

from pyspark.sql import functions as F

from voltpanel.sinks.tables import read_monthly_table
from voltpanel.streaming import holdover

DAYS = {d: dt.date(2026, 7, d) for d in range(25, 32)}
PANEL = "zone string, period date, value bigint"


def panel(spark, rows):
    return spark.createDataFrame([(z, DAYS[d], v) for z, d, v in rows], PANEL)


def persistence(demand, without=()):
    before = demand.select("zone", F.date_add("period", 1).alias("target_date"), F.col("value").cast("double").alias("predicted_demand"))
    return lambda pairs: pairs.join(before, holdover.KEYS).filter(~F.col("zone").isin(list(without)))


def ledger_of(spark, path):
    return {(r.zone, r.target_date.day): (r.status, r.tries, r.first_run.day, r.last_run.day) for r in read_monthly_table(spark, path).collect()}


def test_late_zones_are_tried_again(spark, tmp_path, monkeypatch):
    ledger, predictions = str(tmp_path / "ledger"), str(tmp_path / "predictions")
    run = lambda demand, day, without=(): holdover.run_forecast(
        spark, ledger, predictions, demand, f"2026-07-{day}", f"2026-07-{day}", persistence(demand, without)
    )
    # c is late, d has a null, e is ready but lacks a model row.
    first = [("a", 26, 1), ("b", 26, 2), ("c", 25, 3), ("d", 26, None), ("e", 26, 5)]
    assert run(panel(spark, first), 27, ["e"]) == holdover.TRY_AGAIN
    want = {
        ("a", 27): ("predicted", 1, 27, 27), ("b", 27): ("predicted", 1, 27, 27), ("c", 27): ("held_over", 1, 27, 27),
        ("d", 27): ("held_over", 1, 27, 27), ("e", 27): ("incomplete", 1, 27, 27),
    }
    assert ledger_of(spark, ledger) == want
    # The retry of the same day finds c; what is predicted is not touched again.
    second = panel(spark, [*first, ("c", 26, 30)])
    assert run(second, 27) == holdover.TRY_AGAIN
    want |= {("c", 27): ("predicted", 2, 27, 27), ("d", 27): ("held_over", 2, 27, 27), ("e", 27): ("predicted", 2, 27, 27)}
    assert ledger_of(spark, ledger) == want
    # The next day's run ends the tries of d, and starts a new date for all zones.
    third = panel(spark, [*first, ("c", 26, 30), *[(z, 27, 7) for z in "abce"], ("d", 27, 9)])
    assert run(third, 28) == holdover.DONE
    want |= {("d", 27): ("missed", 3, 27, 28)} | {(z, 28): ("predicted", 1, 28, 28) for z in "abcde"}
    assert ledger_of(spark, ledger) == want
    # Nothing is open: a repeat changes nothing, even with a predictor that would fail on rows.
    assert run(third, 28) == holdover.DONE and ledger_of(spark, ledger) == want
    got = {(r.zone, r.target_date.day): r.predicted_demand for r in read_monthly_table(spark, predictions).collect()}
    assert got == {("a", 27): 1.0, ("b", 27): 2.0, ("c", 27): 30.0, ("e", 27): 5.0} | {(z, 28): 7.0 for z in "abce"} | {("d", 28): 9.0}
    # A run that dies between the two tables is repeated whole.
    stored = holdover.upsert_table

    def dies(spark_, path, *rest):
        if path == ledger:
            raise KeyboardInterrupt
        stored(spark_, path, *rest)

    fourth = third.unionByName(panel(spark, [("a", 28, 8)]))
    with monkeypatch.context() as m:
        m.setattr(holdover, "upsert_table", dies)
        try:
            run(fourth, 29)
        except KeyboardInterrupt:
            pass
    assert ledger_of(spark, ledger) == want
    assert run(fourth, 29) == holdover.TRY_AGAIN
    assert ledger_of(spark, ledger) == want | {("a", 29): ("predicted", 1, 29, 29)} | {(z, 29): ("held_over", 1, 29, 29) for z in "bcde"}


def test_no_demand_at_all(spark, tmp_path):
    empty = spark.createDataFrame([], PANEL)
    assert holdover.run_forecast(spark, str(tmp_path / "l"), str(tmp_path / "p"), empty, "2026-07-27", "2026-07-27", persistence(empty)) == holdover.DONE
    assert read_monthly_table(spark, str(tmp_path / "l")).count() == 0
