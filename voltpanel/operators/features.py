"""Feature operators.  All series windows share ``series_window``: one shuffle, one sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltpanel.functions import (
    cooling_degrees,
    day_name,
    day_of_week,
    full_window_mean,
    half_even,
    heating_degrees,
    is_federal_holiday,
    is_weekend,
    mean_temperature,
)
from voltpanel.operators.keyed import join_by_day
from voltpanel.operators.panel import series_window
from voltpanel.schemas import (
    EXACT_NEXT,
    FEATURE_SETS,
    FORECAST_WEATHER,
    HISTORY_FEATURES,
    LAGS,
    MODELLING_COLUMNS,
    ROLLING,
    THERMAL_COLUMNS,
)

# Level shift of the pandemic period, both ends included.
REGIMES = {"covid": ("2020-03-15", "2021-06-30"), "post": ("2021-07-01", None)}


def calendar_features(rows: DataFrame, day: str = "period") -> DataFrame:
    d = F.col(day)
    return rows.withColumns(
        {
            "is_weekend": is_weekend(d),
            "is_holiday": is_federal_holiday(d),
            "day_of_week": day_of_week(d),
            "day_name": day_name(d),
        }
    )


def degree_days(rows: DataFrame) -> DataFrame:
    """Mean temperature and the two clipped degree-day columns, unrounded."""
    return rows.withColumn("tavg", mean_temperature(F.col("tmin"), F.col("tmax"))).withColumns(
        {"hdd": heating_degrees(F.col("tavg")), "cdd": cooling_degrees(F.col("tavg"))}
    )


def thermal_inertia(rows: DataFrame) -> DataFrame:
    """Three-day means (full window only) and yesterday's temperature, all by date.

    Means run over the unrounded columns; all seven thermal columns are rounded after.
    """
    three = series_window().rangeBetween(-2, 0)
    return rows.withColumns(
        {
            "tavg_3day": full_window_mean(F.col("tavg"), three, 3),
            "cdd_3day": full_window_mean(F.col("cdd"), three, 3),
            "hdd_3day": full_window_mean(F.col("hdd"), three, 3),
            "tavg_lag1": _days_away("tavg", -1),
        }
    ).withColumns({c: half_even(F.col(c), 1) for c in THERMAL_COLUMNS})


def modelling_table(demand: DataFrame, station: DataFrame, sky: DataFrame) -> DataFrame:
    """Demand as the backbone, weather joined by day, calendar and thermal columns derived."""
    joined = join_by_day(join_by_day(demand, station, "date"), sky, "date")
    return thermal_inertia(degree_days(calendar_features(joined))).select("zone", *MODELLING_COLUMNS)


def _days_away(column: str, days: int) -> Column:
    """The value of the row exactly ``days`` calendar days away; null if that day is absent."""
    return F.max(column).over(series_window().rangeBetween(days, days))


def next_day_target(rows: DataFrame) -> DataFrame:
    """Tomorrow's value by date: null before a hole, never the row after it."""
    return rows.withColumn("target", _days_away("value", 1))


def demand_lags(rows: DataFrame, lags: list[int] = LAGS) -> DataFrame:
    """Lags by calendar date, as at serving time; a lag whose date is absent is null."""
    return rows.withColumns({f"lag_{n}": _days_away("value", -n) for n in lags})


def demand_rolling(rows: DataFrame, sizes: list[int] = ROLLING, places: int | None = None) -> DataFrame:
    """``lag_0`` and means of the ``n`` days before today, null unless all ``n`` are there."""
    w = series_window()

    def mean_before(size: int) -> Column:
        mean = full_window_mean(F.col("value"), w.rangeBetween(-size, -1), size)
        return mean if places is None else half_even(mean, places)

    return rows.withColumns({"lag_0": F.col("value"), **{f"rolling_{n}": mean_before(n) for n in sizes}})


def history_features(rows: DataFrame, places: int | None = None) -> DataFrame:
    return demand_rolling(demand_lags(next_day_target(rows)), places=places)


def live_demand_features(demand: DataFrame) -> DataFrame:
    """Lags by calendar date for the day after each demand row.

    A lag whose date is absent is null, never the row that happens to sit that far up.
    Rolling means take whatever rows fall into the window and are rounded to 0.1.
    """
    w = series_window()
    lagged = {
        f"lag_{n}": F.max("value").over(w.rangeBetween(-n, -n)) for n in [0] + LAGS
    }
    rolling = {f"rolling_{n}": half_even(F.avg("value").over(w.rangeBetween(-n, -1)), 1) for n in ROLLING}
    return demand.withColumns({**lagged, **rolling}).select(
        "zone", F.date_add("period", 1).alias("target_date"), *HISTORY_FEATURES
    )


def next_day_features(rows: DataFrame, weather: list[str] = FORECAST_WEATHER, exact: list[str] = EXACT_NEXT) -> DataFrame:
    """Bring day t+1's weather (``*_fc``) and calendar (``*_next``) onto day t, by date.

    The neighbouring row counts only if it really is the next calendar day, so a hole in
    the series gives nulls and never a misaligned pair.
    """
    following = F.lead(F.struct("period", *weather, *exact)).over(series_window())
    is_next = F.col("_following.period") == F.date_add("period", 1)
    names = {c: f"{c}_fc" for c in weather} | {c: f"{c}_next" for c in exact}
    return (
        rows.withColumn("_following", following)
        .withColumns({new: F.when(is_next, F.col(f"_following.{old}")) for old, new in names.items()})
        .drop("_following")
    )


def forecast_features(table: DataFrame) -> DataFrame:
    """Everything known at the end of day t, plus day t+1's weather, with the target.

    The ``*_fc`` columns are observed next-day weather, so scores on them are an upper
    bound on what a real forecast feed would allow.  Missing snow depth means none.
    """
    return next_day_features(history_features(table.fillna(0.0, ["snwd"])))


def feature_set(table: DataFrame, name: str) -> DataFrame:
    """One of the named feature sets as ``zone, period, is_imputed, <features>, target``.

    Rows with any null among the features or the target are left out.  The two sets built
    on today's weather keep missing snow depth missing and so lose those days; the sets
    that go to a served model carry rolling means rounded to 0.1.
    """
    columns = FEATURE_SETS[name]
    rounded = 1 if name in ("all", "select", "inference") else None
    if name in ("all", "select"):
        # Snow depth takes part in the null check of the full set, from which the
        # selection is cut, so both keep the same days.
        wide = history_features(table, places=rounded).dropna(subset=FEATURE_SETS["all"] + ["target"])
    else:
        wide = next_day_features(history_features(table.fillna(0.0, ["snwd"]), places=rounded))
        wide = wide.dropna(subset=FEATURE_SETS["simple" if name == "simple" else "forecast"] + ["target"])
    return wide.select("zone", "period", "is_imputed", *columns, "target")


def drop_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Strict drop: an unknown name raises instead of passing silently."""
    unknown = sorted(set(names) - set(rows.columns))
    if unknown:
        raise ValueError(f"columns to drop not found: {unknown}")
    return rows.drop(*names)


def columns_with_prefix(rows: DataFrame, prefixes: tuple[str, ...]) -> list[str]:
    return [c for c in rows.columns if c.startswith(prefixes)]


def seasonal_features(rows: DataFrame, harmonics: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Next day's weekday one-hot and smooth annual cycle."""
    tomorrow = F.date_add("period", 1)
    one_hot = {f"dow_{i}": (F.weekday(tomorrow) == i).cast("double") for i in range(7)}
    cycle = {}
    for k in harmonics:
        angle = F.lit(2 * math.pi * k) * F.dayofyear(tomorrow) / 365.25
        cycle |= {f"doy_sin_{k}": F.sin(angle), f"doy_cos_{k}": F.cos(angle)}
    return rows.withColumns({**one_hot, **cycle})


def regime_dummies(rows: DataFrame, regimes: dict[str, tuple[str, str | None]] = REGIMES) -> DataFrame:
    """0/1 column per named date range; an open end means the range never closes."""

    def inside(first: str, last: str | None) -> Column:
        started = F.col("period") >= F.to_date(F.lit(first))
        return started if last is None else started & (F.col("period") <= F.to_date(F.lit(last)))

    return rows.withColumns({name: inside(*span).cast("int") for name, span in regimes.items()})
