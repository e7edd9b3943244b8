import datetime as dt
import json

import pytest

from voltpanel.sources import feeds, tables

def landed(day, **by_zone):
    return [{"period": day, "value": v, "timezone": zone, "type": "D"} for zone, v in by_zone.items()]


# Three zones over two pages, and one record more announced than landed.
PAGES = [
    {"response": {"total": "6", "data": landed("2021-03-01", Eastern="71.5", Pacific="12", Arizona="8")}},
    {"response": {"total": "6", "data": landed("2021-03-02", Arizona="9", Eastern="64")}},
]


@pytest.fixture
def pages(spark, tmp_path):
    for i, page in enumerate(PAGES):
        (tmp_path / f"page-{i}.json").write_text(json.dumps(page))
    return feeds.read_demand_pages(spark, str(tmp_path))


def test_pages_keep_eastern_rows_as_numbers(pages):
    rows = feeds.demand_rows(feeds.demand_pages_to_rows(pages)).orderBy("date").collect()
    assert [(r.date.isoformat(), r.demand) for r in rows] == [("2021-03-01", 71.5), ("2021-03-02", 64.0)]
    assert feeds.demand_rows(feeds.demand_pages_to_rows(pages), series_type="NG").count() == 0


def test_completeness(pages):
    r = feeds.feed_completeness(pages).first()
    assert (r.expected, r.received, r.is_complete) == (6, 5, False)


def test_truncated_page_raises(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps(PAGES[0])[:-20])
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        feeds.read_demand_pages(spark, str(tmp_path)).collect()


def test_junk_value_raises(spark):
    records = spark.createDataFrame([("2026-08-15", "n/a", "Eastern")], "period string, value string, timezone string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        feeds.demand_rows(records).collect()


def test_parallel_arrays(spark, tmp_path):
    payload = {"daily": {
        "time": ["2026-01-01", "2026-01-02"],
        "relative_humidity_2m_mean": [50.0, 51.0],
        "relative_humidity_2m_max": [70.0, None],
        "dew_point_2m_mean": [20.0, 21.0],
        "shortwave_radiation_sum": [7.0, 8.0],
        "cloud_cover_mean": [10.0, 20.0],
        "daylight_duration": [33000.0, 33060.0],
        "sunshine_duration": [0.0, 18000.0],
    }}
    (tmp_path / "a.json").write_text(json.dumps(payload, indent=1))
    rows = feeds.archive_to_rows(feeds.read_archive(spark, str(tmp_path / "a.json"))).orderBy("date").collect()
    assert rows[0].asDict() == {
        "date": dt.date(2026, 1, 1), "rh_mean": 50.0, "rh_max": 70.0, "dew_point": 20.0, "solar_rad": 7.0,
        "cloud_cover": 10.0, "daylight_hours": 9.17, "sunshine_hours": 0.0,
    }
    assert rows[1].rh_max is None and rows[1].sunshine_hours == 5.0


def test_day_structs_fill_snow_depth(spark, tmp_path):
    day = {"datetime": "2026-01-01", "tempmax": 40.0, "tempmin": 30.0, "dew": 20.0, "humidity": 50.0, "precip": 0.0,
           "snow": 0.0, "snowdepth": None, "solarenergy": 5.0, "cloudcover": 10.0, "sunriseEpoch": 100, "sunsetEpoch": 36100}
    (tmp_path / "t.json").write_text(json.dumps({"days": [day]}))
    row = feeds.timeline_to_rows(feeds.read_timeline(spark, str(tmp_path / "t.json"))).first()
    assert row.snowdepth == 0.0 and (row.sunrise, row.sunset) == (100, 36100)


def test_colliding_header_keeps_first(spark, tmp_path):
    (tmp_path / "w.csv").write_text("DATE,PRCP,date\n2019-01-01,0.5,2000-01-01\n")
    raw = spark.read.schema("DATE STRING, PRCP DOUBLE, d2 STRING").option("header", True).csv(str(tmp_path / "w.csv"))
    clashing = raw.toDF("DATE", "PRCP", "date")
    got = feeds.normalise_header(clashing)
    assert got.columns == ["date", "prcp"]
    assert got.first().date == "2019-01-01"


def test_station_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("DATE,PRCP,SNOW,SNWD,TMIN,TMAX\n2018-12-31,0,0,,30,40\n2019-01-01,0.1,0,0,31,41\n")
    rows = feeds.since(feeds.read_station_csv(spark, str(tmp_path / "w.csv")), "2019-01-01").collect()
    assert [r.tmin for r in rows] == [31.0]


def test_csv_follows_its_header(spark, tmp_path):
    (tmp_path / "w.csv").write_text("DATE,TMIN,TMAX,PRCP,SNOW,SNWD,date\n2019-01-01,31,41,0.1,0,,2000-01-01\n")
    row = feeds.read_station_csv(spark, str(tmp_path / "w.csv")).first()
    assert (row.date.isoformat(), row.tmin, row.tmax, row.prcp, row.snwd) == ("2019-01-01", 31.0, 41.0, 0.1, None)
    (tmp_path / "x.csv").write_text("DATE,TMIN\n2019-01-01,31\n")
    with pytest.raises(ValueError, match="PRCP"):
        feeds.read_station_csv(spark, str(tmp_path / "x.csv"))


def test_split_read_opens_only_its_folder(spark, tmp_path, make_panel):
    from voltpanel.operators.splits import time_split
    from voltpanel.sinks.tables import write_splits

    panel = time_split(make_panel({"a": [1, 2, 3, 4]}), "2020-01-02", "2020-01-04")
    write_splits(panel, str(tmp_path / "s"))
    val = tables.read_split(spark, str(tmp_path / "s"), "val")
    assert sorted(r.value for r in val.collect()) == [2, 3]
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_demand_series_is_ordered(spark, tmp_path):
    rows = [("a", dt.date(2026, 1, 2), 2.0, False), ("a", dt.date(2026, 1, 1), 1.0, True)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "zone string, date date, demand double, is_imputed boolean").write.parquet(path)
    assert [r.demand for r in tables.read_demand_series(spark, path).collect()] == [1.0, 2.0]
