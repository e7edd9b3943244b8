import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltpanel.operators import impute
from voltpanel.operators.panel import densify


def nearest_mean(observed: pd.Series, day: pd.Timestamp, n: int) -> float:
    gaps = pd.Series(abs((observed.index - day).days), index=observed.index)
    return observed[gaps.sort_values(kind="stable").index[:n]].mean()


def brute_force(child: pd.Series, parent: pd.Series, n: int) -> dict:
    full = child.reindex(pd.date_range(child.index.min(), child.index.max()))
    whole = parent.reindex(full.index)
    ratio = (full / whole).dropna()
    out = {}
    for day in full.index:
        if pd.notna(full[day]):
            out[day.date()] = (int(full[day]), 0)
        elif pd.notna(whole[day]) and len(ratio):
            out[day.date()] = (round(nearest_mean(ratio, day, n) * whole[day]), 1)
    return out


@pytest.fixture(scope="module")
def gappy():
    rng = random.Random(7)
    days = pd.date_range("2020-01-01", periods=420)
    parent = pd.Series([rng.randint(4000, 9000) for _ in days], days, dtype=float)
    keep = [d for i, d in enumerate(days) if i in (0, 419) or not (60 <= i < 95 or 200 <= i < 240 or rng.random() < 0.25)]
    child = pd.Series([round(parent[d] * rng.uniform(0.28, 0.36)) for d in keep], keep, dtype=float)
    return child, parent.drop(parent.index[[70, 71, 230]])


def to_frames(spark, child, parent):
    panel = spark.createDataFrame([("z", d.date(), int(v)) for d, v in child.items()], "zone string, period date, value bigint")
    whole = spark.createDataFrame([(d.date(), int(v)) for d, v in parent.items()], "period date, parent_value bigint")
    return panel, whole


@pytest.mark.parametrize("n", [14, 3, 1])
def test_equals_brute_force_with_ties(spark, gappy, n):
    panel, parent = to_frames(spark, *gappy)
    imputed = impute.ratio_impute(panel, parent, n)
    got = {r.period: (r.value, r.is_imputed) for r in impute.filled(imputed).collect()}
    assert got == brute_force(*gappy, n)
    missing_parent = {r.period for r in impute.unfillable(imputed).collect()}
    assert missing_parent == {d.date() for d in pd.date_range("2020-01-01", periods=420)[[70, 71, 230]]}


def test_observed_values_and_zones_stay_apart(spark, make_panel):
    panel = make_panel({"a": [10, None, 30], "b": [500, None, None, 900]})
    parent = make_panel({"all": [100, 100, 100, 100]}).select("period", F.col("value").alias("parent_value"))
    got = {(r.zone, r.period.day): r.value for r in impute.filled(impute.ratio_impute(panel, parent)).collect()}
    assert got == {
        ("a", 1): 10, ("a", 2): 20, ("a", 3): 30, ("b", 1): 500, ("b", 2): 700, ("b", 3): 700, ("b", 4): 900
    }


def test_no_anchor_at_all_is_unfillable(spark, make_panel):
    panel = make_panel({"a": [10, None, 30]})
    parent = spark.createDataFrame([(dt.date(2020, 1, 2), 100)], "period date, parent_value bigint")
    imputed = impute.ratio_impute(panel, parent)
    assert [r.period.day for r in impute.unfillable(imputed).collect()] == [2]
    assert impute.filled(imputed).count() == 2


def test_rounding_is_half_even(spark, make_panel):
    panel = make_panel({"a": [5, None, 5]})
    parent = spark.createDataFrame(
        [(dt.date(2020, 1, 1), 10), (dt.date(2020, 1, 2), 5), (dt.date(2020, 1, 3), 10)], "period date, parent_value bigint"
    )
    assert {r.period.day: r.value for r in impute.filled(impute.ratio_impute(panel, parent)).collect()}[2] == 2


def test_densify_spans_each_zone_only(make_panel):
    got = densify(make_panel({"a": [1, None, None, 4], "b": [None, 7]})).orderBy("zone", "period").collect()
    assert [(r.zone, r.period.day, r.value, r.is_missing) for r in got] == [
        ("a", 1, 1, 0), ("a", 2, None, 1), ("a", 3, None, 1), ("a", 4, 4, 0), ("b", 2, 7, 0)
    ]


def test_repeated_day_raises(make_panel):
    panel = make_panel({"a": [1, 2, 3]})
    with pytest.raises(Exception, match="more than one row for a 2020-01-02"):
        densify(panel.unionByName(panel.filter("value = 2"))).collect()


def test_backtest_predicts_every_observed_day_once(spark, gappy):
    panel, parent = to_frames(spark, *gappy)
    got = impute.impute_backtest(panel, parent).first()
    child, whole = gappy
    first = child.index.min()
    errors = []
    for parity in (0, 1):
        hidden = child[[((d - first).days // 35) % 2 == parity for d in child.index]]
        ratio = (child.drop(hidden.index) / whole).dropna()
        for day, actual in hidden.items():
            if day in whole.index:
                errors.append(abs(round(nearest_mean(ratio, day, 14) * whole[day]) - actual) / actual * 100)
    errors = pd.Series(errors)
    assert got.n == len(errors)
    assert got.mape == pytest.approx(errors.mean())
    assert got.median_ape == pytest.approx(errors.median())
    assert got.p90_ape == pytest.approx(errors.quantile(0.9))


def test_day_of_year_ratio_wraps_around(spark, make_panel):
    panel = make_panel({"a": [10] + [None] * 365 + [20]}, start="2020-12-30")
    parent = make_panel({"all": [100] * 367}, start="2020-12-30").select("period", F.col("value").alias("parent_value"))
    got = {r.period: r.value for r in impute.filled(impute.doy_ratio_impute(panel, parent)).collect()}
    assert got[dt.date(2021, 1, 3)] == 15 and dt.date(2021, 7, 1) not in got
