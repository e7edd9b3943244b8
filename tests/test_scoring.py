import datetime as dt
import math

import pytest

from voltpanel.operators import scoring

JOINED = "target_date date, predicted_demand double, actual_demand double, model_version string, is_imputed boolean"
AUG = lambda d: dt.date(2026, 8, d)


def test_imputed_actuals_are_not_scored(spark):
    joined = spark.createDataFrame(
        [(AUG(15), 100.0, 90.0, "model_v1", False), (AUG(16), 120.0, 100.0, "model_v1", True)], JOINED
    )
    (row,) = scoring.score_rows(joined).collect()
    assert row.target_date == AUG(15)
    assert (row.error, row.abs_error) == (10.0, 10.0)
    assert row.pct_error == pytest.approx(11.1111111111)
    assert row.abs_pct_error == pytest.approx(11.1111111111)
    assert row.is_imputed is False


def test_nothing_to_score_keeps_the_columns(spark):
    scores = scoring.score_rows(spark.createDataFrame([], JOINED))
    assert scores.columns == scoring.SCORE_COLUMNS
    assert scores.count() == 0


def test_zero_actual_has_an_infinite_percentage(spark):
    joined = spark.createDataFrame([(AUG(1), -5.0, 0.0, "m", False), (AUG(2), 11.0, 10.0, "m", False)], JOINED)
    scores = scoring.score_rows(joined)
    row = scores.orderBy("target_date").first()
    assert row.error == -5.0 and row.pct_error == -math.inf and row.abs_pct_error == math.inf
    assert scoring.score_summary(scores).first().mape == math.inf
    offline = joined.withColumnsRenamed({"predicted_demand": "predicted", "actual_demand": "actual"})
    assert scoring.offline_metrics(offline, ["model_version"]).first().mape == math.inf


def test_missing_columns_are_listed_sorted(spark):
    with pytest.raises(ValueError, match=r"\['actual_demand', 'is_imputed'\]"):
        scoring.score_rows(spark.createDataFrame([], "target_date date, predicted_demand double, model_version string"))


def test_summary(spark):
    rows = [(10.0, 10.0, 10.0), (-20.0, 20.0, 20.0), (30.0, 30.0, 30.0)]
    s = scoring.score_summary(spark.createDataFrame(rows, "error double, abs_error double, abs_pct_error double")).first()
    assert (s["count"], s.mae, s.mape) == (3, 20.0, 20.0)
    assert s.rmse == pytest.approx(math.sqrt(1400 / 3))
    assert s.bias == pytest.approx(20 / 3)


def test_empty_summary_is_zero_and_nan(spark):
    s = scoring.score_summary(spark.createDataFrame([], "error double, abs_error double, abs_pct_error double")).first()
    assert s["count"] == 0
    assert all(math.isnan(s[c]) for c in ("mae", "rmse", "mape", "bias"))


def test_trailing_counts_rows_not_days(spark):
    days = [AUG(d) for d in range(1, 31) if d % 3 == 0]
    rows = [("z", d, 110.0, 100.0, "m", False) for d in days] + [("z", dt.date(2026, 7, 1), 900.0, 100.0, "m", False)]
    scores = scoring.score_rows(spark.createDataFrame(rows, "zone string, " + JOINED))
    got = {r.last_rows: r["count"] for r in scoring.trailing_scores(scores, "2026-08-31").collect()}
    assert got == {7: 7, 30: 10}


def test_evaluation_window(spark):
    """Window is [today - 30, today - 1]; of two days in it one is imputed."""
    rows = [("z", AUG(15), 100.0, 90.0, "m", False), ("z", AUG(16), 120.0, 100.0, "m", True), ("z", AUG(17), 1.0, 1.0, "m", False)]
    scores = scoring.score_rows(spark.createDataFrame(rows, "zone string, " + JOINED))
    kept = scoring.in_trailing_window(scores, "2026-08-17").collect()
    assert [r.target_date for r in kept] == [AUG(15)]
    assert {r.last_rows: r["count"] for r in scoring.trailing_scores(scores, "2026-08-17").collect()} == {7: 1, 30: 1}
    assert scoring.latest_score(scores).first().target_date == AUG(17)


def test_actuals_range_is_inclusive(spark):
    days = [dt.date(2026, 7, 31), AUG(1), AUG(31), dt.date(2026, 9, 1)]
    predictions = spark.createDataFrame(
        [("z", d, 1.0, "m", "{}") for d in days],
        "zone string, target_date date, predicted_demand double, model_version string, features string",
    )
    demand = spark.createDataFrame([("z", d, 2.0, False) for d in days], "zone string, date date, demand double, is_imputed boolean")
    got = scoring.prediction_actuals(predictions, demand, "2026-08-01", "2026-08-31").collect()
    assert sorted(r.target_date for r in got) == [AUG(1), AUG(31)]


def test_offline_metrics_round_half_even(spark):
    rows = [("z", 100, 101), ("z", 100, 100)]
    m = scoring.offline_metrics(spark.createDataFrame(rows, "zone string, actual bigint, predicted bigint"), ["zone"]).first()
    assert (m.n, m.mae, m.mape, m.bias) == (2, 0.0, 0.5, 0.5)
    assert m.rmse == 1.0
