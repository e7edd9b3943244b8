"""The named queries again, as plain SQL over the test tables.

Written from the definitions, not from the DataFrame code: imputation compares every
missing day with every observed day, next-day columns are key joins, rolling means are
correlated frames.  ``LIBRARY`` holds the shared derivations; a query reads what it needs.
"""

from __future__ import annotations

from voltpanel.operators.explore import NUMERIC_COLUMNS, REGIME_FEATURES
from voltpanel.schemas import (
    EXACT_NEXT,
    FEATURE_SETS,
    FORECAST_FEATURES,
    FORECAST_WEATHER,
    HISTORY_FEATURES,
    INFERENCE_FEATURES,
    LAGS,
    MODELLING_COLUMNS,
    ROLLING,
    THERMAL_COLUMNS,
)


def r(x: str, places: int = 6) -> str:
    scale = f"{10**places}.0::DOUBLE"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def r_as(names: list[str], places: int = 6) -> str:
    return ", ".join(f"{r(n, places)} AS {n}" for n in names)


def frame_mean(x: str, size: int) -> str:
    days = f"RANGE BETWEEN INTERVAL {size} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"
    frame = f"(PARTITION BY zone ORDER BY period {days})"
    return f"CASE WHEN count({x}) OVER {frame} = {size} THEN avg({x}) OVER {frame} END"


def three_day(x: str) -> str:
    frame = "(PARTITION BY zone ORDER BY period RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} = 3 THEN avg({x}) OVER {frame} END"


FIXED = (
    "(month({d}) * 100 + day({d}) IN (101, 704, 1111, 1225) OR (month({d}) = 6 AND day({d}) = 19 AND year({d}) >= 2021))"
)


def holiday(d: str) -> str:
    tests = [FIXED.format(d=d)]
    since = {1: 1986, 2: 1971, 5: 1971, 10: 1971}
    for month, first, last, iso in [(1, 15, 21, 1), (2, 15, 21, 1), (5, 25, 31, 1), (9, 1, 7, 1), (10, 8, 14, 1), (11, 22, 28, 4)]:
        year = f" AND year({d}) >= {since[month]}" if month in since else ""
        tests.append(f"(month({d}) = {month} AND day({d}) BETWEEN {first} AND {last} AND isodow({d}) = {iso}{year})")
    tests.append(f"(isodow({d}) = 5 AND {FIXED.format(d=f'({d} + 1)')})")
    tests.append(f"(isodow({d}) = 1 AND {FIXED.format(d=f'({d} - 1)')})")
    return "CASE WHEN " + " OR ".join(tests) + " THEN 1 ELSE 0 END"


def weekend(d: str) -> str:
    return f"CASE WHEN isodow({d}) >= 6 THEN 1 ELSE 0 END"


def tenth(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5) / 10"


def weather(name: str, where: str) -> str:
    return f"""
{name}_means AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS q,
    CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS d,
    CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS t
  FROM lineitem WHERE {where} GROUP BY 1),
{name}_curve AS (
  SELECT *, cos(6.283185307179586 * dayofyear(date) / 365.25::DOUBLE) AS season FROM {name}_means),
{name}_centre AS (
  SELECT *, 57.5::DOUBLE - 22.5::DOUBLE * season + 2.5::DOUBLE * (q - 25.4::DOUBLE) AS centre,
    floor(360 - 80 * season) * 2 AS minutes FROM {name}_curve),
{name}_readings AS (
  SELECT date, minutes,
    {tenth('centre - 7')} AS tmin, {tenth('centre + 7')} AS tmax,
    CASE WHEN t > 0.04::DOUBLE THEN {tenth('(t - 0.04::DOUBLE) * 60')} ELSE 0.0::DOUBLE END AS prcp,
    CASE WHEN centre < 40 THEN {tenth('d * 40')} ELSE 0.0::DOUBLE END AS snow,
    CASE WHEN month(date) = 1 AND day(date) = 17 THEN NULL
         WHEN centre < 40 THEN {tenth('d * 90')} ELSE 0.0::DOUBLE END AS snwd,
    {tenth('55 + (d - 0.05::DOUBLE) * 400')} AS rh_mean,
    {tenth('75 + (d - 0.05::DOUBLE) * 300')} AS rh_max,
    {tenth('centre - 12 + (t - 0.04::DOUBLE) * 150')} AS dew_point,
    {tenth('14 - 8 * season - (t - 0.04::DOUBLE) * 60')} AS solar_rad,
    {tenth('50 + (t - 0.04::DOUBLE) * 600')} AS cloud_cover
  FROM {name}_centre),
{name} AS (
  SELECT * EXCLUDE (minutes), minutes * 60 AS daylight_duration,
    floor(minutes * (1 - cloud_cover / 200)) * 60 AS sunshine_duration,
    CAST(date_diff('day', DATE '1970-01-01', date) AS BIGINT) * 86400 + 43200 - CAST(minutes AS BIGINT) * 30 AS sunrise,
    CAST(date_diff('day', DATE '1970-01-01', date) AS BIGINT) * 86400 + 43200 + CAST(minutes AS BIGINT) * 30 AS sunset
  FROM {name}_readings)"""


READINGS = (
    "date, dew_point AS dew, prcp AS precip, snow, tmax AS tempmax, tmin AS tempmin, rh_mean AS humidity, "
    "snwd AS snowdepth, solar_rad AS solarenergy, cloud_cover AS cloudcover"
)
READING_NAMES = "dew, precip, snow, tempmax, tempmin, humidity, snowdepth, solarenergy, cloudcover"

_LAG_DATES = ", ".join(
    f"max(value) OVER (PARTITION BY zone ORDER BY n RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING) AS lag_{k}"
    for k in [0] + LAGS
)
_LIVE_MEANS = ", ".join(
    f"{r(f'avg(value) OVER (PARTITION BY zone ORDER BY n RANGE BETWEEN {k} PRECEDING AND 1 PRECEDING)', 1)} AS rolling_{k}"
    for k in ROLLING
)


def live_history(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT zone, period + 1 AS target_date, {", ".join(HISTORY_FEATURES)} FROM (
    SELECT zone, period, {_LAG_DATES}, {_LIVE_MEANS}
    FROM (SELECT *, date_diff('day', DATE '1970-01-01', period) AS n FROM {source})))"""


def inference(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT h.zone, h.target_date, {", ".join(f"h.{c}" for c in HISTORY_FEATURES)},
    f.* EXCLUDE (target_date), i.* EXCLUDE (target_date),
    {weekend('h.target_date')} AS is_weekend_next, {holiday('h.target_date')} AS is_holiday_next
  FROM {source} h LEFT JOIN live_forecast f ON f.target_date = h.target_date
  LEFT JOIN live_inertia i ON i.target_date = h.target_date)"""


_PERSIST = """
persist_{n} AS (
  SELECT b.zone, b.period AS target_date, CAST(a.value AS DOUBLE) AS predicted_demand,
    'persist_{n}' AS model_version,
    CAST(to_json({{'lag_{n}': a.value, 'is_weekend': """ + weekend("b.period") + """}}) AS VARCHAR) AS features
  FROM demand b JOIN demand a ON a.zone = b.zone AND a.period = b.period - {n})"""


_RATIO = (
    "CASE WHEN a.value = 0 THEN sign(p.predicted_demand) * 'inf'::DOUBLE "
    "ELSE (p.predicted_demand - a.value) / CAST(a.value AS DOUBLE) END"
)


def scores(name: str, predictions: str, actual: str, flag: str) -> str:
    return f"""
{name} AS (
  SELECT p.zone, p.target_date, p.predicted_demand, CAST(a.value AS DOUBLE) AS actual_demand,
    p.predicted_demand - a.value AS error, abs(p.predicted_demand - a.value) AS abs_error,
    {_RATIO} * 100.0::DOUBLE AS pct_error, abs({_RATIO} * 100.0::DOUBLE) AS abs_pct_error,
    p.model_version, false AS is_imputed
  FROM {predictions} p JOIN {actual} a ON a.zone = p.zone AND a.period = p.target_date WHERE {flag})"""


def pearson(x: str, y: str) -> str:
    xs, ys = f"CASE WHEN {y} IS NOT NULL THEN CAST({x} AS DOUBLE) END", f"CASE WHEN {x} IS NOT NULL THEN CAST({y} AS DOUBLE) END"
    return f"covar_pop({xs}, {ys}) / nullif(stddev_pop({xs}) * stddev_pop({ys}), 0)"


LIBRARY = ",".join(
    [
        """
order_rows AS (
  SELECT r_name AS zone, CAST(o_orderdate AS DATE) AS period, o_orderstatus AS status,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount
  FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
raw AS (SELECT zone, period, CAST(round(sum(amount)) AS BIGINT) AS value FROM order_rows GROUP BY ALL),
provisional AS (
  SELECT zone, period, CAST(round(sum(amount)) AS BIGINT) AS value FROM order_rows WHERE status <> 'P' GROUP BY ALL),
parent AS (SELECT period, CAST(sum(value) AS BIGINT) AS parent_value FROM raw GROUP BY period),
dense AS (
  SELECT c.zone, c.period, v.value, CASE WHEN v.value IS NULL THEN 1 ELSE 0 END AS is_missing, p.parent_value
  FROM (SELECT zone, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE) AS period
        FROM raw GROUP BY zone) c
  LEFT JOIN raw v ON v.zone = c.zone AND v.period = c.period
  LEFT JOIN parent p ON p.period = c.period),
observed_ratio AS (
  SELECT zone, period, CAST(value AS DOUBLE) / CAST(parent_value AS DOUBLE) AS ratio
  FROM dense WHERE value IS NOT NULL AND parent_value <> 0),
nearest AS (
  SELECT m.zone, m.period, o.ratio,
    row_number() OVER (PARTITION BY m.zone, m.period
                       ORDER BY abs(date_diff('day', o.period, m.period)), o.period) AS place
  FROM dense m JOIN observed_ratio o ON o.zone = m.zone WHERE m.value IS NULL),
local_ratio AS (SELECT zone, period, avg(ratio) AS ratio FROM nearest WHERE place <= 14 GROUP BY zone, period),
imputed AS (
  SELECT d.zone, d.period, d.is_missing AS is_imputed, d.parent_value,
    coalesce(d.value, CAST(round_even(l.ratio * d.parent_value, 0) AS BIGINT)) AS value
  FROM dense d LEFT JOIN local_ratio l ON l.zone = d.zone AND l.period = d.period),
demand AS (SELECT zone, period, value, is_imputed FROM imputed WHERE value IS NOT NULL)""",
        weather("weather", "true"),
        weather("weather_old", "l_linestatus = 'O'"),
        weather("weather_new", "l_linestatus = 'F'"),
        f"""
sky AS (
  SELECT date, rh_mean, rh_max, dew_point, solar_rad, cloud_cover,
    {r('daylight_duration / 3600', 2)} AS daylight_hours, {r('sunshine_duration / 3600', 2)} AS sunshine_hours
  FROM weather),
joined AS (
  SELECT d.*, w.prcp, w.snow, w.snwd, w.tmin, w.tmax, s.* EXCLUDE (date),
    {weekend('d.period')} AS is_weekend, {holiday('d.period')} AS is_holiday,
    isodow(d.period) - 1 AS day_of_week, dayname(d.period) AS day_name, (w.tmin + w.tmax) / 2 AS tavg
  FROM demand d LEFT JOIN weather w ON w.date = d.period LEFT JOIN sky s ON s.date = d.period),
degrees AS (
  SELECT *, CASE WHEN tavg IS NULL THEN NULL ELSE greatest(50 - tavg, 0) END AS hdd,
    CASE WHEN tavg IS NULL THEN NULL ELSE greatest(tavg - 65, 0) END AS cdd FROM joined),
inertia AS (
  SELECT g.*, y.tavg AS tavg_lag1
  FROM (SELECT *, {three_day('tavg')} AS tavg_3day, {three_day('cdd')} AS cdd_3day, {three_day('hdd')} AS hdd_3day FROM degrees) g
  LEFT JOIN degrees y ON y.zone = g.zone AND y.period = g.period - 1),
modelling AS (
  SELECT zone, {", ".join(r(c, 1) + " AS " + c if c in THERMAL_COLUMNS else c for c in MODELLING_COLUMNS)} FROM inertia),
history AS (
  SELECT m.*, t.value AS target, m.value AS lag_0, {", ".join(f"l{n}.value AS lag_{n}" for n in LAGS)}
  FROM (SELECT *, {", ".join(f"{frame_mean('value', n)} AS rolling_{n}" for n in ROLLING)} FROM modelling) m
  LEFT JOIN demand t ON t.zone = m.zone AND t.period = m.period + 1
  {" ".join(f"LEFT JOIN demand l{n} ON l{n}.zone = m.zone AND l{n}.period = m.period - {n}" for n in LAGS)}),
filled_history AS (SELECT * REPLACE (coalesce(snwd, 0) AS snwd) FROM history),
with_next AS (
  SELECT t.*, {", ".join(f"n.{c} AS {c}_fc" for c in FORECAST_WEATHER)},
    {", ".join(f"n.{c} AS {c}_next" for c in EXACT_NEXT)}
  FROM filled_history t LEFT JOIN filled_history n ON n.zone = t.zone AND n.period = t.period + 1),
timeline AS (
  SELECT {READINGS}, sunrise, sunset FROM weather),
live_forecast AS (
  SELECT date AS target_date, tempmin AS tmin_fc, tempmax AS tmax_fc, {r('(tempmin + tempmax) / 2', 1)} AS tavg_fc,
    dew AS dew_point_fc, humidity AS rh_mean_fc, precip AS prcp_fc, snow AS snow_fc,
    coalesce(snowdepth, 0) AS snwd_fc, solarenergy AS solar_rad_fc, cloudcover AS cloud_cover_fc,
    {r('greatest(50 - (tempmin + tempmax) / 2, 0)', 1)} AS hdd_fc,
    {r('greatest((tempmin + tempmax) / 2 - 65, 0)', 1)} AS cdd_fc,
    {r('(sunset - sunrise) / 3600.0::DOUBLE', 2)} AS daylight_hours_next
  FROM timeline),
live_mean AS (
  SELECT f.target_date, ((b.tempmin + b.tempmax) / 2 + (a.tempmin + a.tempmax) / 2 + f.tavg_fc) / 3 AS m
  FROM live_forecast f LEFT JOIN timeline a ON a.date = f.target_date - 1
  LEFT JOIN timeline b ON b.date = f.target_date - 2),
live_inertia AS (
  SELECT target_date, {r('m', 1)} AS tavg_3day_fc,
    CASE WHEN m IS NOT NULL THEN {r('greatest(m - 65, 0)', 1)} END AS cdd_3day_fc,
    CASE WHEN m IS NOT NULL THEN {r('greatest(50 - m, 0)', 1)} END AS hdd_3day_fc FROM live_mean)""",
        live_history("live_raw", "raw"),
        live_history("live_demand", "demand"),
        inference("inference_raw", "live_raw"),
        inference("inference_demand", "live_demand"),
        _PERSIST.format(n=7),
        _PERSIST.format(n=1),
        scores("scored", "persist_7", "demand", "a.is_imputed = 0"),
        scores("scored_first", "persist_7", "provisional", "true"),
        scores("scored_short", "persist_1", "demand", "a.is_imputed = 0"),
        """
recent AS (
  SELECT *, row_number() OVER (PARTITION BY zone ORDER BY target_date DESC) AS place FROM scored
  WHERE target_date BETWEEN DATE '2001-08-02' - 30 AND DATE '2001-08-01'),
split AS (
  SELECT *, CASE WHEN period < DATE '2000-01-01' THEN 'train' WHEN period < DATE '2001-01-01' THEN 'val'
                 ELSE 'test' END AS split FROM demand),
demand_history AS (
  SELECT zone, period, target, """
        + ", ".join(HISTORY_FEATURES)
        + """ FROM history),
baseline AS (
  SELECT zone, period, target AS actual, unnest(['persistence (lag_0)', 'persistence (lag_7)', 'persistence (lag_28)']) AS model,
    unnest([lag_0, lag_7, lag_28]) AS predicted
  FROM demand_history WHERE period BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND target IS NOT NULL AND """
        + " AND ".join(f"{c} IS NOT NULL" for c in HISTORY_FEATURES)
        + "),"
        + f"""
baseline_metrics AS (
  SELECT zone, model, count(*) AS n, {r('avg(abs(predicted - actual))', 0)} AS mae,
    {r('sqrt(avg(CAST(predicted - actual AS DOUBLE) * (predicted - actual)))', 0)} AS rmse,
    {r('avg(abs((predicted - actual) / CAST(actual AS DOUBLE))) * 100', 2)} AS mape,
    {r('avg(predicted - actual)', 1)} AS bias
  FROM baseline GROUP BY zone, model),
date_rank AS (
  SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT period FROM demand)),
blocks AS (
  SELECT period, CASE WHEN i < n - 5 * (n // 6) THEN 0 ELSE (i - (n - 5 * (n // 6))) // (n // 6) + 1 END AS block
  FROM date_rank)""",
    ]
)


def over_library(body: str) -> str:
    return f"WITH {LIBRARY}\n{body}"


def _dated(names: str) -> str:
    return ", ".join(f"CAST({n.strip()} AS VARCHAR) AS {n.strip()}" for n in names.split(","))


def upserted(old: str, new: str, keys: list[str], out: str) -> str:
    """Old rows whose key is not in the update, then the update."""
    match = " AND ".join(f"n.{k} = o.{k}" for k in keys)
    return f"SELECT {out} FROM (SELECT * FROM ({old}) o WHERE NOT EXISTS (SELECT 1 FROM ({new}) n WHERE {match}) UNION ALL SELECT * FROM ({new}))"


def _table(source: str, flag: str = "false") -> str:
    return f"SELECT zone, period AS date, CAST(value AS DOUBLE) AS demand, {flag} AS is_imputed FROM {source}"


DEMAND_OUT = f"zone, {_dated('date')}, demand, is_imputed"
SCORE_DOUBLES = ["predicted_demand", "actual_demand", "error", "abs_error", "pct_error", "abs_pct_error"]
SCORE_OUT = f"zone, {_dated('target_date')}, {r_as(SCORE_DOUBLES)}, model_version, is_imputed"
PREDICTION_OUT = f"zone, {_dated('target_date')}, predicted_demand, model_version, features"
WEATHER_OUT = f"{_dated('date')}, {READING_NAMES}"
FLAGGED = "CAST(is_imputed AS BOOLEAN)"
SUMMARY = (
    f"count(*) AS count, {r('avg(abs_error)', 4)} AS mae, {r('sqrt(avg(error * error))', 4)} AS rmse, "
    f"{r('avg(abs_pct_error)', 4)} AS mape, {r('avg(error)', 4)} AS bias"
)
_NEXT = [f"{c}_fc" for c in FORECAST_WEATHER] + [f"{c}_next" for c in EXACT_NEXT]
_MODELLING_OUT = f"zone, {_dated('period')}, {', '.join(MODELLING_COLUMNS[1:])}"
_SUMMER = "month(period) IN (6, 7, 8)"


def _feature_set(name: str) -> str:
    rounded = name in ("all", "select", "inference")
    source = "history" if name in ("all", "select") else "with_next"
    needed = FEATURE_SETS["all"] if source == "history" else FEATURE_SETS["simple" if name == "simple" else "forecast"]
    columns = ", ".join(
        f"{r(c, 1 if rounded else 6)} AS {c}" if c.startswith("rolling") else c for c in FEATURE_SETS[name]
    )
    present = " AND ".join(f"{c} IS NOT NULL" for c in needed + ["target"])
    return f"SELECT zone, {_dated('period')}, is_imputed, {columns}, target FROM {source} WHERE {present}"


def _standardised() -> str:
    names = ["lag_0", "rolling_7", "hdd_fc", "cdd_fc"]
    present = " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_SETS["simple"] + ["target"])
    scaled = []
    for c in names:
        fit = f"CASE WHEN split = 'train' THEN {c} END"
        mean, sd = f"avg({fit}) OVER (PARTITION BY zone)", f"stddev_pop({fit}) OVER (PARTITION BY zone)"
        scaled.append(r(f"({c} - {mean}) / {sd}") + f" AS {c}")
    return (
        f"SELECT zone, {_dated('period')}, split, {', '.join(scaled)} FROM (SELECT *, CASE WHEN period < DATE '2000-01-01' "
        f"THEN 'train' WHEN period < DATE '2001-01-01' THEN 'val' ELSE 'test' END AS split FROM with_next WHERE {present})"
    )


def _pairs(source: str) -> str:
    lines = [
        f"SELECT zone, '{NUMERIC_COLUMNS[i]}' AS feature_a, '{NUMERIC_COLUMNS[j]}' AS feature_b, "
        f"{pearson(NUMERIC_COLUMNS[i], NUMERIC_COLUMNS[j])} AS correlation FROM {source} GROUP BY zone"
        for i in range(len(NUMERIC_COLUMNS))
        for j in range(i)
    ]
    return " UNION ALL ".join(lines)


def _regimes() -> str:
    tagged = (
        "(SELECT *, CASE WHEN tavg < 50 THEN 'heating' WHEN tavg <= 65 THEN 'mild' ELSE 'cooling' END AS regime "
        "FROM modelling WHERE is_imputed = 0 AND tavg IS NOT NULL)"
    )
    everything = f"(SELECT * FROM {tagged} UNION ALL SELECT * REPLACE ('pooled' AS regime) FROM modelling_all)"
    lines = [
        f"SELECT zone, regime, '{c}' AS feature, {r(pearson(c, 'value'))} AS correlation FROM {everything} GROUP BY zone, regime"
        for c in REGIME_FEATURES
    ]
    body = " UNION ALL ".join(lines)
    return (
        f"WITH {LIBRARY}, modelling_all AS (SELECT *, 'x' AS regime FROM modelling WHERE is_imputed = 0)\n{body}"
    )


def _backtest() -> str:
    return f"""
WITH {LIBRARY},
blocked AS (
  SELECT *, (date_diff('day', min(period) OVER (PARTITION BY zone), period) // 35) % 2 AS parity FROM dense),
pairs AS (
  SELECT h.zone, h.period, h.value, h.parent_value, o.value / CAST(o.parent_value AS DOUBLE) AS ratio,
    row_number() OVER (PARTITION BY h.zone, h.period
                       ORDER BY abs(date_diff('day', o.period, h.period)), o.period) AS place
  FROM blocked h JOIN blocked o ON o.zone = h.zone AND o.parity <> h.parity
  WHERE h.value IS NOT NULL AND o.value IS NOT NULL AND o.parent_value <> 0),
estimates AS (
  SELECT zone, period, any_value(value) AS value, round_even(avg(ratio) * any_value(parent_value), 0) AS guess
  FROM pairs WHERE place <= 14 GROUP BY zone, period),
errors AS (SELECT zone, abs(guess - value) / CAST(value AS DOUBLE) * 100 AS ape FROM estimates)
SELECT zone, count(*) AS n, {r('avg(ape)', 4)} AS mape, {r('quantile_cont(ape, 0.5)', 4)} AS median_ape,
  {r('quantile_cont(ape, 0.9)', 4)} AS p90_ape FROM errors GROUP BY zone"""


def _autocorrelation() -> str:
    lines = [
        f"SELECT zone, {k} AS lag, {r(f'sum((a - m) * (b - m)) / any_value(total)')} AS autocorrelation FROM "
        f"(SELECT x.zone, x.value AS a, y.value AS b, x.m, x.total FROM numbered x LEFT JOIN numbered y "
        f"ON y.zone = x.zone AND y.i = x.i - {k}) GROUP BY zone"
        for k in (1, 2, 7, 14, 30, 365)
    ]
    return (
        f"WITH {LIBRARY}, means AS (SELECT zone, period, value, avg(value) OVER (PARTITION BY zone) AS m, "
        "row_number() OVER (PARTITION BY zone ORDER BY period) AS i FROM demand WHERE is_imputed = 0), "
        "numbered AS (SELECT *, sum((value - m) * (value - m)) OVER (PARTITION BY zone) AS total FROM means)\n"
        + " UNION ALL ".join(lines)
    )


def _base_scan() -> str:
    """R squared by orthogonalising the four regressors one after the other."""
    heating = [f"{{'side': 'heating', 'base': {b}.0::DOUBLE, 'hb': {b}, 'cb': 65}}" for b in (45, 49, 50, 51, 55, 60, 65)]
    cooling = [f"{{'side': 'cooling', 'base': {b}.0::DOUBLE, 'hb': 50, 'cb': {b}}}" for b in (60, 63, 65, 67, 70)]
    over = "OVER (PARTITION BY zone, side, base)"

    def without(x: str, parts: list[str]) -> str:
        return x + "".join(f" - {e} * sum({x} * {e}) {over} / sum({e} * {e}) {over}" for e in parts)

    explained = " + ".join(f"sum(y * {e}) * sum(y * {e}) / sum({e} * {e})" for e in ("e1", "e2", "e3", "e4"))
    return f"""
WITH {LIBRARY},
trials AS (
  SELECT zone, value, tavg, is_weekend, is_holiday, unnest([{", ".join(heating + cooling)}]) AS t
  FROM modelling WHERE is_imputed = 0 AND tavg IS NOT NULL),
regressors AS (
  SELECT zone, t.side AS side, t.base AS base, greatest(t.hb - tavg, 0) AS x1, greatest(tavg - t.cb, 0) AS x2,
    is_weekend AS x3, is_holiday AS x4, value AS x5 FROM trials),
centred AS (
  SELECT zone, side, base, x1 - avg(x1) {over} AS e1, x2 - avg(x2) {over} AS d2, x3 - avg(x3) {over} AS d3,
    x4 - avg(x4) {over} AS d4, x5 - avg(x5) {over} AS y FROM regressors),
two AS (SELECT *, {without('d2', ['e1'])} AS e2 FROM centred),
three AS (SELECT *, {without('d3', ['e1', 'e2'])} AS e3 FROM two),
four AS (SELECT *, {without('d4', ['e1', 'e2', 'e3'])} AS e4 FROM three)
SELECT zone, side, base, {r(f'({explained}) / sum(y * y)')} AS r2 FROM four GROUP BY zone, side, base"""


VIF_FEATURES = [c for c in NUMERIC_COLUMNS if c not in ("value", "day_of_week")]


def _vif() -> str:
    """Variance inflation by elimination: all other features swept out of each one's own row.

    A pivot of which earlier ones leave nothing is skipped; a feature with nothing left is infinite.
    """
    k, nothing = len(VIF_FEATURES), "1e-9"
    known = " AND ".join(f"{c} IS NOT NULL" for c in VIF_FEATURES)
    swept = "list_transform(m, lambda line, i: CASE WHEN i = k THEN line ELSE list_transform(line, lambda v, j: v - line[k] * m[k][j] / m[k][k]) END)"
    return f"""
WITH RECURSIVE {LIBRARY},
long AS (
  SELECT zone, id, unnest(range(1, {k} + 1)) AS i, unnest(x) AS v FROM (
    SELECT zone, period AS id, [{", ".join(f"CAST({c} AS DOUBLE)" for c in VIF_FEATURES)}] AS x FROM modelling WHERE is_imputed = 0 AND {known})),
unit AS (
  SELECT zone, id, i, CASE WHEN sd > 1e-9 * (1 + abs(mean)) THEN (v - mean) / sd ELSE 0 END AS v FROM (
    SELECT *, avg(v) OVER (PARTITION BY zone, i) AS mean, stddev_pop(v) OVER (PARTITION BY zone, i) AS sd FROM long)),
cells AS (SELECT a.zone, a.i, b.i AS j, sum(a.v * b.v) AS c FROM unit a JOIN unit b ON b.zone = a.zone AND b.id = a.id GROUP BY ALL),
lines AS (SELECT zone, i, list(c ORDER BY j) AS line FROM cells GROUP BY zone, i),
gram AS (SELECT zone, list(line ORDER BY i) AS m FROM lines GROUP BY zone),
swept(zone, t, k, full_, m) AS (
  SELECT zone, unnest(range(1, {k} + 1)), 1, m, m FROM gram
  UNION ALL
  SELECT zone, t, k + 1, full_, CASE WHEN k = t OR m[k][k] <= {nothing} * full_[k][k] THEN m ELSE {swept} END FROM swept WHERE k <= {k})
SELECT zone, [{", ".join(f"'{c}'" for c in VIF_FEATURES)}][t] AS feature, CASE WHEN full_[t][t] = 0 THEN NULL
  WHEN m[t][t] <= {nothing} * full_[t][t] THEN 'inf'::DOUBLE WHEN full_[t][t] / m[t][t] < 1e4 THEN {r('full_[t][t] / m[t][t]', 2)} ELSE round_even(full_[t][t] / m[t][t] / 100, 0) * 100 END AS vif
FROM swept WHERE k = {k} + 1"""


def _ridge(body: str) -> str:
    """Ridge by elimination: every penalty's normal equations per fold, R squared from the test rows.

    Fold 6 holds all training rows. ``best`` is the chosen penalty, ``final`` its coefficients.
    """
    k, names = len(INFERENCE_FEATURES), ", ".join(INFERENCE_FEATURES)
    known = "FILTER (WHERE period < '2000-01-01') OVER (PARTITION BY zone)"
    unit = ", ".join(
        f"CASE WHEN stddev_pop(x[{i}]) {known} = 0 THEN 0 ELSE (x[{i}] - avg(x[{i}]) {known}) / stddev_pop(x[{i}]) {known} END"
        for i in range(1, k + 1)
    )
    return f"""
WITH RECURSIVE {LIBRARY},
model_rows AS ({_feature_set('inference')}),
raw_rows AS (SELECT zone, period, CAST(target AS DOUBLE) AS y, list_transform([{names}], lambda v: CAST(v AS DOUBLE)) AS x
  FROM model_rows),
days AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM (
  SELECT DISTINCT period FROM raw_rows WHERE period < '2000-01-01')),
unit_rows AS (SELECT zone, period, y, [{unit}] AS x FROM raw_rows),
train_rows AS (
  SELECT zone, period, y, x, CASE WHEN i < n - 5 * (n // 6) THEN 0 ELSE (i - (n - 5 * (n // 6))) // (n // 6) + 1 END AS block
  FROM unit_rows JOIN days USING (period)),
long AS (SELECT zone, period, block, unnest(range(1, {k} + 2)) AS i, unnest(list_append(x, y)) AS v FROM train_rows),
fold_long AS (SELECT zone, f, period, i, v - avg(v) OVER (PARTITION BY zone, f, i) AS v, avg(v) OVER (PARTITION BY zone, f, i) AS mean
  FROM long JOIN range(1, 7) folds(f) ON block < f),
cells AS (SELECT a.zone, a.f, a.i, b.i AS j, sum(a.v * b.v) AS c FROM fold_long a JOIN fold_long b
  ON b.zone = a.zone AND b.f = a.f AND b.period = a.period WHERE a.i <= {k} GROUP BY ALL),
penalties AS (SELECT p, power(10::DOUBLE, -4 + p * 8.0::DOUBLE / 49) AS alpha FROM range(50) x(p)),
lines AS (SELECT zone, f, p, i, list(c + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j) AS line FROM cells, penalties GROUP BY zone, f, p, i),
swept(zone, f, p, k, m) AS (
  SELECT zone, f, p, 1, list(line ORDER BY i) FROM lines GROUP BY zone, f, p
  UNION ALL
  SELECT zone, f, p, k + 1, list_transform(
    list_transform(m, lambda line, i: {{'line': line, 'share': CASE WHEN i = k THEN 0 ELSE line[k] / top[k] END}}),
    lambda s: list_transform(list_zip(s.line, top), lambda z: z[1] - s.share * z[2]))
  FROM (SELECT *, m[k] AS top FROM swept WHERE k <= {k})),
fits AS (SELECT zone, f, p, list_transform(m, lambda line, i: line[{k} + 1] / line[i]) AS coef FROM swept WHERE k = {k} + 1),
means AS (SELECT zone, f, list(mean ORDER BY i) AS mean FROM (SELECT DISTINCT zone, f, i, mean FROM fold_long) GROUP BY zone, f),
models AS (SELECT fits.*, mean[{k} + 1] - list_dot_product(coef, mean[1:{k}]) AS intercept FROM fits JOIN means USING (zone, f)),
r2s AS (SELECT m.zone, f, p, 1 - sum(power(y - intercept - list_dot_product(coef, x), 2)) / (var_pop(y) * count(*)) AS r2
  FROM models m JOIN train_rows t ON t.zone = m.zone AND t.block = m.f GROUP BY m.zone, f, p),
scores AS (SELECT zone, p, avg(r2) AS r2 FROM r2s GROUP BY zone, p),
best AS (SELECT zone, p, r2 FROM scores QUALIFY row_number() OVER (PARTITION BY zone ORDER BY r2 DESC, p) = 1),
final AS (SELECT m.zone, coef, intercept, r2, alpha FROM models m JOIN best USING (zone, p) JOIN penalties USING (p) WHERE f = 6)
{body}"""


def _constraints() -> str:
    def finding(table: str, constraint: str, query: str) -> str:
        return f"SELECT '{table}' AS table_name, '{constraint}' AS \"constraint\", ({query}) AS violations"

    repeated = "SELECT count(*) FROM (SELECT 1 FROM {} GROUP BY {} HAVING count(*) > 1)"
    return over_library(
        " UNION ALL ".join(
            [
                finding("demand_daily", "primary key (zone, date)", repeated.format("demand", "zone, period")),
                finding("demand_daily", "not null (demand, is_imputed)", "SELECT count(*) FROM demand WHERE value IS NULL OR is_imputed IS NULL"),
                finding("demand_feed", "primary key (zone, date)", repeated.format("events", "event_type, CAST(ts AS DATE)")),
                finding("weather_daily", "not null (snowdepth)", "SELECT count(*) FROM weather WHERE snwd IS NULL"),
                finding("predictions", "primary key (zone, target_date)", repeated.format("persist_7", "zone, target_date")),
                finding(
                    "prediction_scores",
                    "foreign key (zone, target_date)",
                    "SELECT count(*) FROM scored_short s WHERE NOT EXISTS (SELECT 1 FROM persist_7 p WHERE p.zone = s.zone AND p.target_date = s.target_date)",
                ),
            ]
        )
    )


_ALIGNED = " AND ".join(f"{c} IS NOT NULL" for c in FORECAST_FEATURES + ["target"])
_CLOSE = "sum(CASE WHEN abs(a.{0} - b.{1}) > 1e-8 + 1e-5 * abs(b.{1}) THEN 1 ELSE 0 END)"
_OLD_WEATHER = f"SELECT {READINGS} FROM weather_old"
_NEW_WEATHER = f"SELECT {READINGS} FROM weather_new WHERE date >= DATE '2001-01-01'"
_PAGE_ROWS = (
    "SELECT zone, CAST(period AS VARCHAR) AS period, CAST(CAST(round(sum(amount)) AS BIGINT) AS VARCHAR) AS value, "
    "CASE status WHEN 'O' THEN 'Eastern' WHEN 'P' THEN 'Central' ELSE 'Pacific' END AS timezone, 'D' AS type "
    "FROM order_rows GROUP BY zone, order_rows.period, status"
)
_DROPPED = ", ".join(c for c in MODELLING_COLUMNS[1:] if c not in ("snow", "snwd"))
_STATION_OUT = f"{_dated('date')}, prcp, snow, snwd, tmin, tmax"

_BODIES = {
    "src_paged_json": _PAGE_ROWS,
    "feed_completeness": f"SELECT zone, count(*) AS expected, count(*) AS received, true AS is_complete FROM ({_PAGE_ROWS}) GROUP BY zone",
    "ingest_filter_cast": f"SELECT {_dated('date')}, demand FROM (SELECT CAST(ts AS DATE) AS date, value AS demand FROM events WHERE event_type = 'purchase')",
    "ingest_filter_type": f"SELECT zone, period AS date, CAST(value AS DOUBLE) AS demand FROM ({_PAGE_ROWS}) WHERE timezone = 'Eastern'",
    "src_struct_of_arrays": f"SELECT {_dated('date')}, rh_mean, rh_max, dew_point, solar_rad, cloud_cover, daylight_hours, sunshine_hours FROM sky",
    "src_array_of_structs": f"SELECT {_dated('date')}, dew, precip, snow, tempmax, tempmin, humidity, coalesce(snowdepth, 0) AS snowdepth, solarenergy, cloudcover, sunrise, sunset FROM timeline",
    "archive_slice": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date FROM lineitem WHERE l_shipdate >= DATE '2000-01-01'",
    "merge_sources_keep_newest": f"SELECT {_STATION_OUT} FROM (SELECT * FROM weather_new WHERE date >= DATE '1998-01-01' UNION ALL "
    "SELECT * FROM weather_old o WHERE NOT EXISTS (SELECT 1 FROM weather_new n WHERE n.date = o.date AND n.date >= DATE '1998-01-01'))",
    "upsert_demand": upserted(_table("provisional"), _table("raw WHERE period >= DATE '2001-06-28'"), ["zone", "date"], DEMAND_OUT),
    "upsert_weather": upserted(_OLD_WEATHER, _NEW_WEATHER, ["date"], WEATHER_OUT),
    "upsert_forecast": "SELECT CAST(date AS VARCHAR) AS target_date, " + READING_NAMES
    + f" FROM ({upserted(_OLD_WEATHER, _NEW_WEATHER, ['date'], 'date, ' + READING_NAMES)})",
    "upsert_prediction": upserted("SELECT * FROM persist_7", "SELECT * FROM persist_1 WHERE target_date >= DATE '2001-06-28'", ["zone", "target_date"], PREDICTION_OUT),
    "upsert_score": upserted("SELECT * FROM scored_first", "SELECT * FROM scored WHERE target_date >= DATE '2001-06-28'", ["zone", "target_date"], SCORE_OUT),
    "bootstrap_demand": f"SELECT {DEMAND_OUT} FROM ({_table('demand', FLAGGED)})",
    "bootstrap_weather": f"SELECT {WEATHER_OUT} FROM (SELECT {READINGS} FROM weather)",
    "backfill_demand": upserted(_table("demand WHERE period < DATE '2001-01-01'", FLAGGED), _table("raw WHERE period >= DATE '2001-01-01'"), ["zone", "date"], DEMAND_OUT),
    "backfill_weather": f"SELECT {WEATHER_OUT} FROM (SELECT {READINGS} FROM weather_old WHERE date < DATE '2001-01-01' UNION ALL "
    f"SELECT * REPLACE (coalesce(snowdepth, 0) AS snowdepth) FROM (SELECT {READINGS} FROM weather WHERE date >= DATE '2001-01-01'))",
    "calendar_densify": f"SELECT zone, {_dated('period')}, value, is_missing FROM dense",
    "impute_ratio": f"SELECT zone, {_dated('period')}, value, is_imputed FROM demand",
    "impute_unfillable": f"SELECT zone, {_dated('period')} FROM imputed WHERE value IS NULL",
    "calendar_features": f"SELECT zone, {_dated('period')}, value, {weekend('raw.period')} AS is_weekend, {holiday('raw.period')} AS is_holiday, "
    "isodow(raw.period) - 1 AS day_of_week, dayname(raw.period) AS day_name FROM raw",
    "degree_days": f"SELECT {_dated('date')}, prcp, snow, snwd, tmin, tmax, {r_as(['tavg', 'hdd', 'cdd'])} FROM (SELECT *, "
    "(tmin + tmax) / 2 AS tavg, greatest(50 - (tmin + tmax) / 2, 0) AS hdd, greatest((tmin + tmax) / 2 - 65, 0) AS cdd FROM weather)",
    "modelling_table": f"SELECT {_MODELLING_OUT} FROM modelling",
    "thermal_inertia": f"SELECT zone, {_dated('period')}, {', '.join(THERMAL_COLUMNS)} FROM modelling",
    "next_day_target": f"SELECT zone, {_dated('period')}, value, is_imputed, target FROM history",
    "demand_lags": f"SELECT zone, {_dated('period')}, value, is_imputed, {', '.join(f'lag_{n}' for n in LAGS)} FROM history",
    "demand_rolling": f"SELECT zone, {_dated('period')}, value, is_imputed, lag_0, {r_as(['rolling_7', 'rolling_30'])} FROM history",
    "live_demand_features": f"SELECT zone, {_dated('target_date')}, {', '.join(HISTORY_FEATURES)} FROM live_raw",
    "next_day_features": f"SELECT t.zone, CAST(t.period AS VARCHAR) AS period, {', '.join(f'n.{c} AS {c}_fc' for c in FORECAST_WEATHER)}, "
    f"{', '.join(f'n.{c} AS {c}_next' for c in EXACT_NEXT)} FROM modelling t LEFT JOIN modelling n ON n.zone = t.zone AND n.period = t.period + 1",
    "forecast_features": f"SELECT zone, {_dated('period')}, {', '.join(r(c) + ' AS ' + c if c.startswith('rolling') else c for c in FORECAST_FEATURES)}, target FROM with_next",
    "daylight_hours": f"SELECT {_dated('date')}, sunrise, sunset, {r('(sunset - sunrise) / 3600.0::DOUBLE', 2)} AS daylight_hours FROM timeline",
    "live_forecast_features": "SELECT * REPLACE (CAST(target_date AS VARCHAR) AS target_date) FROM live_forecast",
    "live_thermal_inertia": "SELECT * REPLACE (CAST(target_date AS VARCHAR) AS target_date) FROM live_inertia",
    "inference_row": f"SELECT zone, {_dated('target_date')}, {', '.join(INFERENCE_FEATURES)} FROM inference_demand",
    "inertia_skew": "SELECT t.zone, count(*) AS n_days, sum(CASE WHEN n.cdd_3day <> i.cdd_3day_fc THEN 1 ELSE 0 END) AS cdd_differs, "
    "sum(CASE WHEN n.hdd_3day <> i.hdd_3day_fc THEN 1 ELSE 0 END) AS hdd_differs, "
    f"{r('max(abs(n.cdd_3day - i.cdd_3day_fc))')} AS max_cdd_gap, {r('max(abs(n.hdd_3day - i.hdd_3day_fc))')} AS max_hdd_gap "
    "FROM modelling t JOIN modelling n ON n.zone = t.zone AND n.period = t.period + 1 JOIN live_inertia i ON i.target_date = n.period "
    "WHERE n.cdd_3day IS NOT NULL AND n.hdd_3day IS NOT NULL AND i.cdd_3day_fc IS NOT NULL GROUP BY t.zone",
    **{f"featureset_{name}": _feature_set(name) for name in FEATURE_SETS},
    "select_features": f"SELECT zone, {_dated('period')}, {_DROPPED} FROM modelling",
    "fill_snow_depth": f"SELECT {_dated('date')}, prcp, snow, coalesce(snwd, 0) AS snwd, tmin, tmax FROM weather",
    "dropna_rows": f"SELECT zone, {_dated('period')}, {', '.join(r(c) + ' AS ' + c if c.startswith('rolling') else c for c in HISTORY_FEATURES)}, target "
    f"FROM demand_history WHERE target IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in HISTORY_FEATURES)}",
    "seasonal_features": f"SELECT zone, {_dated('period')}, "
    + ", ".join(f"CASE WHEN isodow(raw.period + 1) = {i + 1} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dow_{i}" for i in range(7))
    + ", "
    + ", ".join(f"{r(f'{fn}(2 * pi() * {k} * dayofyear(raw.period + 1) / 365.25)')} AS doy_{fn}_{k}" for k in (1, 2) for fn in ("sin", "cos"))
    + " FROM raw",
    "regime_dummies": f"SELECT zone, {_dated('period')}, value, CASE WHEN raw.period BETWEEN DATE '1998-03-15' AND DATE '1999-06-30' THEN 1 ELSE 0 END AS shift, "
    "CASE WHEN raw.period >= DATE '1999-07-01' THEN 1 ELSE 0 END AS post FROM raw",
    "feature_null_report": " UNION ALL ".join(
        f"SELECT count(*) AS n_rows, '{c}' AS feature, count(*) - count({c}) AS n_null FROM inference_raw" for c in INFERENCE_FEATURES
    ),
    "validate_weather": f"SELECT {_dated('date')}, 'snowdepth' AS missing FROM weather WHERE snwd IS NULL",
    "alignment_audit": f"SELECT a.zone, count(b.period) AS pairs, {_CLOSE.format('target', 'value')} AS target_mismatches, "
    f"{_CLOSE.format('tavg_fc', 'tavg')} AS weather_mismatches, {_CLOSE.format('is_holiday_next', 'is_holiday')} AS calendar_mismatches, "
    "sum(CASE WHEN d.period IS NULL THEN 1 ELSE 0 END) AS absent_targets "
    f"FROM (SELECT * FROM with_next WHERE {_ALIGNED}) a LEFT JOIN (SELECT * FROM with_next WHERE {_ALIGNED}) b ON b.zone = a.zone AND b.period = a.period + 1 "
    "LEFT JOIN demand d ON d.zone = a.zone AND d.period = a.period + 1 GROUP BY a.zone",
    "freshness_gate": "SELECT zone, CAST(max(period) AS VARCHAR) AS latest, CASE WHEN max(period) = DATE '2001-08-01' THEN 'ready' ELSE 'unavailable' END AS status "
    "FROM raw WHERE period <= DATE '2001-08-01' GROUP BY zone",
    "forecast_hold_over": """SELECT zone, CAST(t AS VARCHAR) AS target_date, CASE WHEN predicted THEN 'predicted' WHEN runs >= 3 THEN 'missed' ELSE 'held_over' END AS status,
  tries, CAST(t AS VARCHAR) AS first_run, CAST(CAST(t + tries - 1 AS DATE) AS VARCHAR) AS last_run, CASE WHEN predicted THEN known END AS predicted_demand FROM (
  SELECT z.zone, d.t, d.runs, CAST(coalesce(p.value, v.value) AS DOUBLE) AS known,
    p.value IS NOT NULL OR (v.value IS NOT NULL AND d.runs >= 2) AS predicted,
    CAST(CASE WHEN p.value IS NOT NULL THEN 1 WHEN v.value IS NOT NULL THEN least(d.runs, 2) ELSE least(d.runs, 3) END AS INT) AS tries
  FROM (SELECT DATE '2001-07-29' + CAST(i AS INT) AS t, 4 - i AS runs FROM range(4) x(i)) d
  JOIN (SELECT zone, min(period) AS since FROM raw GROUP BY zone) z ON true
  LEFT JOIN provisional p ON p.zone = z.zone AND p.period = d.t - 1
  LEFT JOIN raw v ON v.zone = z.zone AND v.period = d.t - 1
  WHERE z.since < d.t - 1 OR p.value IS NOT NULL)""",
    "split_report": "SELECT CASE WHEN period < DATE '2000-01-01' THEN 'train' WHEN period < DATE '2001-01-01' THEN 'val' ELSE 'test' END AS split, "
    f"count(*) AS n, CAST(min(period) AS VARCHAR) AS first_day, CAST(max(period) AS VARCHAR) AS last_day, sum(is_imputed) AS imputed_rows FROM with_next WHERE {_ALIGNED} GROUP BY 1",
    "time_split": f"SELECT zone, {_dated('period')}, value, is_imputed, split FROM split",
    "cv_folds": "SELECT d.zone, CAST(d.period AS VARCHAR) AS period, b.block FROM demand d JOIN blocks b ON b.period = d.period",
    "cv_fold_report": "SELECT fold, sum(CASE WHEN block < fold THEN 1 ELSE 0 END) AS train_rows, CAST(max(CASE WHEN block < fold THEN period END) AS VARCHAR) AS train_last, "
    "sum(CASE WHEN block = fold THEN 1 ELSE 0 END) AS test_rows, CAST(min(CASE WHEN block = fold THEN period END) AS VARCHAR) AS test_first, "
    "CAST(max(CASE WHEN block = fold THEN period END) AS VARCHAR) AS test_last FROM (SELECT d.period, b.block, unnest([1, 2, 3, 4, 5]) AS fold "
    "FROM demand d JOIN blocks b ON b.period = d.period) GROUP BY fold",
    "persistence_baseline": f"SELECT zone, {_dated('period')}, actual, model, predicted FROM baseline",
    "offline_metrics": "SELECT * FROM baseline_metrics",
    "skill_score": f"SELECT m.zone, m.model, m.mape, b.mape AS base_mape, {r('100 * (1 - m.mape / b.mape)')} AS skill FROM baseline_metrics m "
    "JOIN baseline_metrics b ON b.zone = m.zone AND b.model = 'persistence (lag_0)'",
    "model_leaderboard": "SELECT *, row_number() OVER (PARTITION BY zone ORDER BY mape, model) AS place FROM baseline_metrics",
    "prediction_actuals": "SELECT p.zone, CAST(p.target_date AS VARCHAR) AS target_date, p.predicted_demand, CAST(d.value AS DOUBLE) AS actual_demand, p.model_version, "
    "CAST(d.is_imputed AS BOOLEAN) AS is_imputed FROM persist_7 p JOIN demand d ON d.zone = p.zone AND d.period = p.target_date "
    "WHERE p.target_date BETWEEN DATE '2000-01-01' AND DATE '2001-06-30'",
    "score_rows": f"SELECT {SCORE_OUT} FROM scored",
    "score_summary": f"SELECT zone, {SUMMARY} FROM scored GROUP BY zone",
    "trailing_scores": f"SELECT zone, last_rows, {SUMMARY} FROM (SELECT *, unnest([7, 30]) AS last_rows FROM recent) WHERE place <= last_rows GROUP BY zone, last_rows",
    "latest_score": f"SELECT {SCORE_OUT} FROM scored s WHERE s.target_date = (SELECT max(t.target_date) FROM scored t WHERE t.zone = s.zone)",
    "yearly_level": f"SELECT zone, year(period) AS year, count(*) AS n, {r('avg(value)', 4)} AS mean_demand FROM demand WHERE is_imputed = 0 GROUP BY ALL",
    "temperature_bins": f"SELECT zone, bin_upper - 5 AS bin_lower, bin_upper, n, {r('m', 4)} AS mean_demand, "
    f"{r('m - lag(m) OVER (PARTITION BY zone ORDER BY bin_upper)', 4)} AS change FROM (SELECT zone, CAST(ceil(tavg / 5) * 5 AS INTEGER) AS bin_upper, "
    "count(value) AS n, avg(value) AS m FROM modelling WHERE is_imputed = 0 AND tavg > 0 AND tavg <= 100 GROUP BY ALL)",
    "yoy_overlay": "SELECT zone, dayofyear(period) AS doy, "
    + ", ".join(f"max(CASE WHEN year(period) = {y} THEN value END) AS y{y}" for y in range(1995, 2002))
    + " FROM demand GROUP BY ALL",
    "yoy_smoothed": f"SELECT zone, year, doy, {r('smoothed', 4)} AS smoothed FROM (SELECT zone, year(period) AS year, dayofyear(period) AS doy, "
    "count(*) OVER (PARTITION BY zone, year(period)) AS n, CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END AS smoothed FROM demand "
    "WINDOW w AS (PARTITION BY zone, year(period) ORDER BY period ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE n >= 300",
    "weekday_box": f"""SELECT s.zone, s.day_name, count(*) AS n, {r('avg(value)', 4)} AS mean_demand, {r('any_value(q1)', 4)} AS q1, {r('any_value(q2)', 4)} AS median,
  {r('any_value(q3)', 4)} AS q3, min(CASE WHEN value BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 THEN value END) AS whisker_low,
  max(CASE WHEN value BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 THEN value END) AS whisker_high,
  sum(CASE WHEN value BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 THEN 0 ELSE 1 END) AS n_outside
FROM (SELECT zone, dayname(period) AS day_name, value FROM demand WHERE is_imputed = 0 AND {_SUMMER}) s
JOIN (SELECT zone, dayname(period) AS day_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3
      FROM demand WHERE is_imputed = 0 AND {_SUMMER} GROUP BY ALL) q ON q.zone = s.zone AND q.day_name = s.day_name
GROUP BY s.zone, s.day_name""",
    "calendar_effects": f"""SELECT zone, {r('wd', 4)} AS summer_weekday, {r('we', 4)} AS summer_weekend, hn AS holiday_weekdays, {r('hm', 4)} AS holiday_mean,
  {r('om', 4)} AS ordinary_mean, {r('100 * (1 - we / wd)', 4)} AS weekend_gap_pct, {r('100 * (1 - hm / om)', 4)} AS holiday_drop_pct
FROM (SELECT zone, avg(CASE WHEN {_SUMMER} AND w = 0 THEN value END) AS wd, avg(CASE WHEN {_SUMMER} AND w = 1 THEN value END) AS we,
  sum(CASE WHEN w = 0 AND h = 1 THEN 1 ELSE 0 END) AS hn, avg(CASE WHEN w = 0 AND h = 1 THEN value END) AS hm, avg(CASE WHEN w = 0 AND h = 0 THEN value END) AS om
  FROM (SELECT *, {weekend('period')} AS w, {holiday('period')} AS h FROM demand WHERE is_imputed = 0) GROUP BY zone)""",
    "corr_matrix": f"SELECT zone, feature_a, feature_b, {r('correlation')} AS correlation FROM ({_pairs('modelling')})",
    "corr_clusters": f"SELECT zone, feature_a, feature_b, {r('correlation')} AS correlation FROM ({_pairs('modelling')}) WHERE abs(correlation) >= 0.85",
    "regime_profile": f"""SELECT zone, regime, count(*) AS n, {r('avg(value)')} AS mean_demand, {r('stddev_samp(value)', 2)} AS sd_demand,
  count(DISTINCT cdd) AS cdd_distinct, count(DISTINCT hdd) AS hdd_distinct, {r('stddev_samp(cdd)')} AS cdd_sd, {r('stddev_samp(hdd)')} AS hdd_sd,
  {r('count(*) / CAST(sum(count(*)) OVER (PARTITION BY zone) AS DOUBLE)')} AS share
FROM (SELECT *, CASE WHEN tavg < 50 THEN 'heating' WHEN tavg <= 65 THEN 'mild' ELSE 'cooling' END AS regime FROM modelling WHERE is_imputed = 0 AND tavg IS NOT NULL)
GROUP BY zone, regime""",
    "thermal_inertia_effect": f"""SELECT zone, count(*) AS n, {r(pearson('cdd_3day', 'value'))} AS corr_cdd_3day, {r(pearson('cdd', 'value'))} AS corr_cdd,
  sum(CASE WHEN cdd_3day >= cdd THEN 1 ELSE 0 END) AS n_after_heat, {r('avg(CASE WHEN cdd_3day >= cdd THEN value END)')} AS mean_after_heat,
  {r('avg(CASE WHEN cdd_3day < cdd THEN value END)')} AS mean_after_milder FROM modelling WHERE is_imputed = 0 AND cdd > 8 AND is_weekend = 0 GROUP BY zone""",
    "standardize": _standardised(),
    "stream_ingest_upsert": "SELECT event_type AS zone, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, arg_max(value, event_id) AS demand, false AS is_imputed, "
    "max(event_id) AS seq FROM events GROUP BY event_type, CAST(ts AS DATE)",
    "rescore_revisions": upserted("SELECT * FROM scored_first", "SELECT * EXCLUDE (place) FROM recent", ["zone", "target_date"], SCORE_OUT),
    "daily_evaluation": f"SELECT zone, {SUMMARY} FROM ("
    + upserted("SELECT * FROM scored_first", "SELECT * EXCLUDE (place) FROM recent", ["zone", "target_date"], "*")
    + ") GROUP BY zone",
    "impute_doy_ratio": """SELECT zone, CAST(period AS VARCHAR) AS period, value, is_imputed FROM (
  SELECT d.zone, d.period, d.is_missing AS is_imputed, coalesce(d.value, CAST(round_even(e.ratio * d.parent_value, 0) AS BIGINT)) AS value
  FROM dense d LEFT JOIN (
    SELECT m.zone, m.doy, avg(o.ratio) AS ratio
    FROM (SELECT DISTINCT zone, dayofyear(period) AS doy FROM dense) m
    JOIN (SELECT zone, dayofyear(period) AS doy, ratio FROM observed_ratio) o ON o.zone = m.zone
      AND least(abs(o.doy - m.doy), 366 - abs(o.doy - m.doy)) <= 7
    GROUP BY m.zone, m.doy) e ON e.zone = d.zone AND e.doy = dayofyear(d.period)) WHERE value IS NOT NULL""",
}

ORACLES = {name: over_library(body) for name, body in _BODIES.items()} | {
    "impute_backtest": _backtest(),
    "autocorrelation": _autocorrelation(),
    "regime_correlation": _regimes(),
    "table_constraints": _constraints(),
    "base_scan": _base_scan(),
    "vif": _vif(),
    "ridge_cv": _ridge(
        f"""SELECT zone, n_rows, {r('alpha')} AS alpha, {r('r2')} AS r2, count(*) AS n, {r('avg(abs(e))', 0)} AS mae, {r('sqrt(avg(e * e))', 0)} AS rmse,
  {r('avg(abs(e / y)) * 100', 2)} AS mape, {r('avg(e)', 1)} AS bias
FROM (SELECT zone, alpha, r2, y, intercept + list_dot_product(coef, x) - y AS e FROM final JOIN unit_rows USING (zone)
  WHERE period BETWEEN '2000-01-01' AND '2000-12-31')
JOIN (SELECT zone, count(*) AS n_rows FROM train_rows GROUP BY zone) USING (zone) GROUP BY zone, n_rows, alpha, r2"""
    ),
    "feature_importance": _ridge(
        f"SELECT zone, unnest([{', '.join(repr(c) for c in INFERENCE_FEATURES)}]) AS feature, unnest(list_transform(coef, lambda v: {r('v', 3)})) AS coefficient, "
        f"unnest(list_transform(coef, lambda v: {r('abs(v)', 3)})) AS importance FROM final"
    ),
}
ORACLES["stream_newest_upsert"] = ORACLES["stream_ingest_upsert"]
