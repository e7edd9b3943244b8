import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltpanel.operators import keyed, validate
from voltpanel.sinks import snapshots
from voltpanel.sinks import tables as sinks

D = dt.date
DEMAND = "zone string, date date, demand double, is_imputed boolean"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_overwrites_and_inserts(spark):
    old = spark.createDataFrame([("a", D(2026, 1, 1), 1.0, False), ("a", D(2026, 1, 2), 2.0, True)], DEMAND)
    new = spark.createDataFrame([("a", D(2026, 1, 2), 9.0, False), ("b", D(2026, 1, 2), 3.0, False)], DEMAND)
    once = keyed.upsert(old, new, ["zone", "date"])
    assert rows_of(once) == [
        ("a", D(2026, 1, 1), 1.0, False), ("a", D(2026, 1, 2), 9.0, False), ("b", D(2026, 1, 2), 3.0, False)
    ]
    assert rows_of(keyed.upsert(once, new, ["zone", "date"])) == rows_of(once)


def test_newest_source_wins_on_overlap(spark):
    older = spark.createDataFrame([(D(2022, 1, 1), 1.0), (D(2022, 1, 2), 2.0)], "date date, tmin double")
    newer = spark.createDataFrame([(D(2022, 1, 2), 5.0), (D(2022, 1, 3), 3.0)], "date date, tmin double")
    got = keyed.merge_sources([older, newer], ["date"])
    assert rows_of(got) == [(D(2022, 1, 1), 1.0), (D(2022, 1, 2), 5.0), (D(2022, 1, 3), 3.0)]


def test_newest_with_null_payload_still_wins(spark):
    rows = [("a", 1, "old", 5.0), ("a", 2, None, None)]
    got = keyed.keep_newest(spark.createDataFrame(rows, "k string, seq int, s string, v double"), ["k"], ["seq"]).first()
    assert (got.seq, got.s, got.v) == (2, None, None)


def test_repeated_date_raises_in_day_join(spark, make_panel):
    daily = spark.createDataFrame([(D(2020, 1, 1), 1.0), (D(2020, 1, 1), 2.0)], "period date, w double")
    with pytest.raises(Exception, match="more than one row for date 2020-01-01"):
        keyed.join_by_day(make_panel({"a": [1, 2]}), daily).collect()


def test_day_join_keeps_every_panel_row(spark, make_panel):
    daily = spark.createDataFrame([(D(2020, 1, 2), 7.0)], "period date, w double")
    got = {r.period.day: r.w for r in keyed.join_by_day(make_panel({"a": [1, 2, 3]}), daily).collect()}
    assert got == {1: None, 2: 7.0, 3: None}
    zoned = daily.withColumn("zone", F.lit("a"))
    got = {(r.zone, r.period.day): r.w for r in keyed.join_by_day(make_panel({"a": [1, 2], "b": [1, 2]}), zoned).collect()}
    assert got[("a", 2)] == 7.0 and got[("b", 2)] is None


def test_table_upsert_touches_only_its_months(spark, tmp_path):
    path = str(tmp_path / "demand")

    def files():
        return {f"month={m}": sorted(snapshots.read(spark, path, months=[m]).inputFiles()) for m in range(202601, 202607)}

    start = [("a", D(2026, m, 1), float(m), False) for m in range(1, 7)]
    sinks.upsert_table(spark, path, spark.createDataFrame(start, DEMAND), ["zone", "date"], "date")
    before = files()
    late = spark.createDataFrame([("a", D(2026, 6, 1), 60.0, False), ("a", D(2026, 6, 2), 61.0, False)], DEMAND)
    for _ in range(2):
        sinks.upsert_table(spark, path, late, ["zone", "date"], "date")
    after = files()
    assert all(before.values())
    assert {m for m in before if before[m] != after[m]} == {"month=202606"}
    got = {r.date: r.demand for r in sinks.read_monthly_table(spark, path).collect()}
    assert len(got) == 7 and got[D(2026, 6, 1)] == 60.0 and got[D(2026, 1, 1)] == 1.0


def test_table_upsert_needs_the_day_in_its_key(spark, tmp_path):
    with pytest.raises(ValueError, match="must be part of the key"):
        sinks.upsert_table(spark, str(tmp_path / "x"), spark.createDataFrame([], DEMAND), ["zone"], "date")


def test_append_leaderboard(spark, tmp_path):
    path = str(tmp_path / "board")
    for model, mape in [("a", 5.0), ("b", 4.0)]:
        sinks.append_results(spark.createDataFrame([(model, mape)], "model string, mape double"), path)
    assert rows_of(spark.read.parquet(path)) == [("a", 5.0), ("b", 4.0)]


def test_csv_round_trip(spark, tmp_path):
    from voltpanel.sources.tables import read_csv

    path = str(tmp_path / "c")
    sinks.overwrite_csv(spark.createDataFrame([("a", D(2026, 1, 1), 1.5, None)], DEMAND), path)
    sinks.overwrite_csv(spark.createDataFrame([("b", D(2026, 1, 1), None, True)], DEMAND), path)
    assert [tuple(r) for r in read_csv(spark, path, DEMAND).collect()] == [("b", D(2026, 1, 1), None, True)]


def test_validation(spark, make_panel):
    names = ["tempmin", "tempmax"]
    bad = spark.createDataFrame([(D(2026, 1, 1), 1.0, None), (D(2026, 1, 2), 1.0, 2.0)], "date date, tempmin double, tempmax double")
    assert [(r.date, r.missing) for r in validate.invalid_weather(bad, names).collect()] == [(D(2026, 1, 1), "tempmax")]
    with pytest.raises(ValueError, match="2026-01-01"):
        validate.require_valid_weather(bad, names)
    assert validate.require_valid_weather(bad.filter("tempmax is not null"), names).count() == 1
    with pytest.raises(ValueError, match="feature mismatch"):
        validate.require_feature_order(bad, ["tempmax", "tempmin"], ["date"])
    with pytest.raises(ValueError, match="tempmax"):
        validate.require_no_nulls(bad, names)
    forecast = spark.createDataFrame([(D(2026, 1, 2),)], "target_date date")
    validate.require_forecast_date(forecast, "2026-01-02")
    with pytest.raises(ValueError, match="expected forecast for 2026-01-03"):
        validate.require_forecast_date(forecast, "2026-01-03")
    with pytest.raises(ValueError, match="no forecast"):
        validate.require_forecast_date(forecast.limit(0), "2026-01-03")


def test_stale_zone_is_held_over(make_panel):
    panel = make_panel({"a": [1, 2, 3], "b": [1, 2, None], "c": [1, None, 3, 4]})
    gate = {r.zone: (str(r.latest), r.status) for r in validate.freshness_gate(panel, "2020-01-04").collect()}
    assert gate == {"a": ("2020-01-03", "ready"), "b": ("2020-01-02", "unavailable"), "c": ("2020-01-03", "ready")}
    ready, held = validate.split_ready(panel, "2020-01-04")
    assert {r.zone for r in ready.collect()} == {"a", "c"} and {r.zone for r in held.collect()} == {"b"}
    with pytest.raises(validate.DemandDataUnavailable, match="b .latest 2020-01-02"):
        validate.require_fresh(panel, "2020-01-04")


def test_constraints(spark, make_panel):
    panel = make_panel({"a": [1, 2]})
    twice = panel.unionByName(panel.limit(1))
    assert validate.key_violations(twice, ["zone", "period"], "t").first().violations == 1
    assert validate.reference_violations(panel, panel.filter("value = 1"), ["zone", "period"], "t").first().violations == 1


def test_upsert_refuses_a_repeated_key(spark):
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    twice = spark.createDataFrame([("a", 2), ("a", 3)], "k string, v int")
    with pytest.raises(Exception, match="more than one update"):
        keyed.upsert(table, twice, ["k"]).collect()
    assert [tuple(r) for r in keyed.upsert(table, twice, ["k"], newest=["v"]).collect()] == [("a", 3)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from voltpanel.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
