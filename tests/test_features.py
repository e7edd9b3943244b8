import datetime as dt

import pytest
from pyspark.sql import functions as F

from voltpanel.functions import half_even, is_federal_holiday
from voltpanel.operators import features, live, validate
from voltpanel.operators.panel import densify
from voltpanel.schemas import FEATURE_SETS, INFERENCE_FEATURES, LAGS, MODELLING_COLUMNS, TODAY_FEATURES


def days(spark, first, last):
    return spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as period")


def test_federal_holidays_2019_to_2026(spark):
    flagged = days(spark, "2019-01-01", "2026-07-22").filter(is_federal_holiday(F.col("period")) == 1)
    got = {r.period for r in flagged.collect()}
    assert len(got) == 91
    D = dt.date
    # New Year's Day 2022 on Saturday, Independence Day 2021 on Sunday, Juneteenth from 2021.
    assert {D(2021, 12, 31), D(2021, 7, 5), D(2021, 6, 18), D(2021, 6, 19), D(2024, 11, 28)} <= got
    assert D(2020, 6, 19) not in got and D(2022, 1, 3) not in got


def test_monday_holidays_count_from_their_first_year(spark):
    flagged = days(spark, "1970-01-01", "1986-12-31").filter(is_federal_holiday(F.col("period")) == 1)
    got = {r.period for r in flagged.collect()}
    D = dt.date
    assert {D(1986, 1, 20), D(1971, 2, 15), D(1971, 5, 31), D(1971, 10, 11), D(1970, 9, 7)} <= got
    assert not {D(1985, 1, 21), D(1970, 2, 16), D(1970, 5, 25), D(1970, 10, 12)} & got


def test_half_even(spark):
    row = spark.sql("select 0.25d a, 126.05d b, 2.5d c, -0.75d d, cast(null as double) e").select(
        half_even(F.col("a"), 1), half_even(F.col("b"), 1), half_even(F.col("c")), half_even(F.col("d"), 1), half_even(F.col("e"), 1)
    ).first()
    assert tuple(row) == (0.2, 126.0, 2.0, -0.8, None)


def weather(spark, pairs, start="2020-01-01"):
    first = dt.date.fromisoformat(start)
    rows = [(first + dt.timedelta(days=i), lo, hi) for i, (lo, hi) in enumerate(pairs)]
    return spark.createDataFrame(rows, "date date, tmin double, tmax double")


def test_degree_days_clip_and_keep_nulls(spark):
    got = features.degree_days(weather(spark, [(30.0, 40.0), (50.0, 66.0), (70.0, 90.0), (None, 50.0)])).orderBy("date").collect()
    assert [(r.tavg, r.hdd, r.cdd) for r in got] == [(35.0, 15.0, 0.0), (58.0, 0.0, 0.0), (80.0, 0.0, 15.0), (None, None, None)]


def test_three_day_means_need_three_days_and_round_last(spark):
    rows = weather(spark, [(60.0, 70.1), (60.0, 70.1), (80.0, 90.0)]).select(F.lit("a").alias("zone"), F.col("date").alias("period"), "tmin", "tmax")
    got = features.thermal_inertia(features.degree_days(rows)).orderBy("period").collect()
    assert [r.tavg_3day for r in got] == [None, None, 71.7]
    assert got[2].cdd_3day == 6.7 and got[2].tavg_lag1 == 65.0


@pytest.mark.parametrize("keep", [lambda i: True, lambda i: i % 11 != 3 and not 200 <= i < 215])
def test_training_lags_equal_serving_lags_with_and_without_holes(spark, make_panel, keep):
    panel = make_panel({"a": [i * i if keep(i) else None for i in range(400)], "b": [i if keep(i) else None for i in range(380)]})
    trained = features.demand_lags(panel).select("zone", F.date_add("period", 1).alias("target_date"), *[f"lag_{n}" for n in LAGS])
    served = features.live_demand_features(panel).select(trained.columns)
    assert trained.exceptAll(served).count() == 0 and served.exceptAll(trained).count() == 0


def test_target_and_rolling_stop_at_a_hole(make_panel):
    got = features.history_features(make_panel({"a": [1, 2, None, *range(4, 13)]})).orderBy("period").collect()
    assert [r.target for r in got] == [2, None, *range(5, 13), None]
    assert [r.rolling_7 for r in got] == [None] * 9 + [7.0, 8.0][:len(got) - 9]


def test_date_lag_is_null_across_a_hole(make_panel):
    rows = {r.target_date.day: r for r in features.live_demand_features(make_panel({"a": [10, None, 30]})).collect()}
    assert rows[4].lag_0 == 30 and rows[4].lag_1 is None and rows[4].lag_2 == 10
    assert rows[4].rolling_7 == 10.0


def test_rolling_excludes_today_and_needs_a_full_window(make_panel):
    got = features.demand_rolling(make_panel({"a": list(range(1, 10))})).orderBy("period").collect()
    assert [r.rolling_7 for r in got] == [None] * 7 + [4.0, 5.0]
    assert got[8].lag_0 == 9 and got[8].rolling_30 is None


def test_next_day_columns_do_not_jump_holes(spark, make_panel):
    panel = make_panel({"a": [1, 2, None, 4]}).withColumns({"w": F.col("value") * 1.0, "h": F.col("value")})
    got = features.next_day_features(panel, ["w"], ["h"]).orderBy("period").collect()
    assert [(r.w_fc, r.h_next) for r in got] == [(2.0, 2), (None, None), (None, None)]


def test_audit_passes_own_features_and_catches_a_shift(spark, make_panel):
    panel = make_panel({"a": list(range(40))}).withColumns({"tavg": F.col("value") * 1.5, "is_holiday": (F.col("value") % 7 == 0).cast("int")})
    table = features.next_day_features(features.next_day_target(panel), ["tavg"], ["is_holiday"]).dropna()
    validate.require_aligned(table, panel)
    with pytest.raises(ValueError, match="not aligned"):
        validate.require_aligned(table.withColumn("target", F.col("value")), panel)
    with pytest.raises(ValueError, match="'absent_targets': 1"):
        validate.require_aligned(table, panel.filter("value <> 20"))


def test_feature_lists():
    sizes = {name: len(columns) for name, columns in FEATURE_SETS.items()}
    assert sizes == {"all": 34, "forecast": 32, "inference": 30, "simple": 16, "select": 32}
    assert INFERENCE_FEATURES[:3] == ["lag_0", "lag_1", "lag_2"] and INFERENCE_FEATURES[-1] == "daylight_hours_next"
    assert len(MODELLING_COLUMNS) == 26 and TODAY_FEATURES[22] == "lag_0"


def test_strict_drop(make_panel):
    panel = make_panel({"a": [1]})
    assert features.drop_columns(panel, ["value"]).columns == ["zone", "period"]
    with pytest.raises(ValueError, match="dow_0"):
        features.drop_columns(panel, ["value", "dow_0"])


def test_prefix_columns(make_panel):
    history = features.history_features(make_panel({"a": [1, 2]}))
    assert len(features.columns_with_prefix(history, ("lag_", "rolling_"))) == 12


def test_season_and_regimes(spark):
    rows = days(spark, "2020-03-14", "2021-07-01").withColumn("zone", F.lit("a"))
    flags = {str(r.period): (r.covid, r.post) for r in features.regime_dummies(rows).collect()}
    assert [flags[d] for d in ("2020-03-14", "2020-03-15", "2021-06-30", "2021-07-01")] == [(0, 0), (1, 0), (1, 0), (0, 1)]
    first = features.seasonal_features(rows).orderBy("period").first()
    assert first.dow_6 == 1.0 and sum(first[f"dow_{i}"] for i in range(7)) == 1.0


def timeline(spark, temps, start="2020-06-01"):
    first = dt.date.fromisoformat(start)
    rows = [(first + dt.timedelta(days=i), lo, hi, None if i == 0 else 1.0, 0, 36000 + 18 * i) for i, (lo, hi) in enumerate(temps)]
    frame = spark.createDataFrame(rows, "date date, tempmin double, tempmax double, snowdepth double, sunrise bigint, sunset bigint")
    return frame.withColumns({c: F.lit(1.0) for c in ("dew", "humidity", "precip", "snow", "solarenergy", "cloudcover")})


def test_live_forecast_and_both_three_day_definitions(spark):
    rows = timeline(spark, [(60.0, 66.0), (60.0, 66.0), (70.0, 80.3)])
    forecast = live.live_forecast_features(rows)
    by_day = {r.target_date.day: r for r in forecast.collect()}
    assert by_day[1].snwd_fc == 0.0 and by_day[2].snwd_fc == 1.0
    # 75.15 rounds to the even tenth; degree days round after clipping.
    assert (by_day[3].tavg_fc, by_day[3].cdd_fc, by_day[3].hdd_fc) == (75.2, 10.2, 0.0)
    got = {r.target_date.day: r for r in live.live_thermal_inertia(rows, forecast).collect()}
    # Clip of the mean: (63 + 63 + 75.2) / 3 = 67.07, where the mean of clips would be 3.4.
    assert (got[3].tavg_3day_fc, got[3].cdd_3day_fc) == (67.1, 2.1)
    assert got[2].tavg_3day_fc is None and got[2].cdd_3day_fc is None


def test_inference_rows_report_what_is_missing(spark, make_panel):
    panel = make_panel({"a": list(range(1, 400))}, start="2019-05-01")
    rows = timeline(spark, [(50.0, 60.0)] * 40, start="2020-05-01")
    forecast = live.live_forecast_features(rows)
    table = live.inference_rows(features.live_demand_features(panel), forecast, live.live_thermal_inertia(rows, forecast))
    assert table.columns == ["zone", "target_date"] + INFERENCE_FEATURES
    good = table.filter("target_date = date'2020-05-20'")
    validate.require_feature_order(good, INFERENCE_FEATURES, ["zone", "target_date"])
    validate.require_no_nulls(good, INFERENCE_FEATURES)
    with pytest.raises(ValueError, match="tavg_fc"):
        validate.require_no_nulls(table.filter("target_date = date'2020-04-20'"), INFERENCE_FEATURES)
