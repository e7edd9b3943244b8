"""Every operator as a named query over the test tables.

Dates leave as ISO text and doubles rounded, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType

from voltpanel.functions import half_even
from voltpanel.operators import (
    boosting,
    explore,
    features,
    forest,
    impute,
    keyed,
    linear,
    live,
    moments,
    panel,
    scoring,
    splits,
    trees,
    validate,
)
from voltpanel.plans import fixtures as fx
from voltpanel.plans import jobs
from voltpanel.schemas import (
    DEMAND_FEED_PAGE,
    FORECAST_FEATURES,
    HISTORY_FEATURES,
    INFERENCE_FEATURES,
    THERMAL_COLUMNS,
    WEATHER_READINGS,
)
from voltpanel.session import materialised, scratch_path, stored
from voltpanel.sinks import models as artefacts
from voltpanel.sinks.tables import read_monthly_table
from voltpanel.sources import feeds
from voltpanel.streaming import holdover, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RECENT_START = "2001-06-28"
BACKFILL_START = "2001-01-01"
SOURCE_SWITCH = "2001-01-01"
PERSISTENCE_BASE = "persistence (lag_0)"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def publish(rows: DataFrame, places: int = 6, **by_column: int) -> DataFrame:
    columns = []
    for field in rows.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, DoubleType):
            column = half_even(column, by_column.get(field.name, places))
        columns.append(column.alias(field.name))
    return rows.select(*columns)


# --- sources ---------------------------------------------------------------------------


@query
def src_paged_json(spark, sf_dir):
    pages = fx.parsed(fx.demand_pages(spark, sf_dir), DEMAND_FEED_PAGE)
    return publish(feeds.demand_pages_to_rows(pages))


@query
def feed_completeness(spark, sf_dir):
    pages = fx.parsed(fx.demand_pages(spark, sf_dir), DEMAND_FEED_PAGE)
    return publish(feeds.feed_completeness(pages, ["zone"]))


@query
def ingest_filter_cast(spark, sf_dir):
    records = fx.table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("period"),
        F.col("value").cast("string").alias("value"),
        F.col("event_type").alias("timezone"),
    )
    return publish(feeds.demand_rows(records, timezone="purchase"))


@query
def ingest_filter_type(spark, sf_dir):
    pages = fx.parsed(fx.demand_pages(spark, sf_dir), DEMAND_FEED_PAGE)
    return publish(feeds.demand_rows(feeds.demand_pages_to_rows(pages), "Eastern", series_type="D"))


@query
def src_struct_of_arrays(spark, sf_dir):
    payload = fx.archive_payload(fx.day_weather(spark, sf_dir))
    return publish(feeds.archive_to_rows(fx.parsed(payload, feeds.ARCHIVE_ARRAYS)))


@query
def src_array_of_structs(spark, sf_dir):
    return publish(fx.timeline(spark, sf_dir))


@query
def archive_slice(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("date"))
    kept = feeds.since(lines, "2000-01-01")
    return publish(kept.withColumn("date", F.to_date("date")))


@query
def merge_sources_keep_newest(spark, sf_dir):
    archive = fx.day_weather(spark, sf_dir, "O")
    newer = feeds.since(fx.day_weather(spark, sf_dir, "F"), "1998-01-01")
    return publish(keyed.merge_sources([fx.station(archive), fx.station(newer)], ["date"]))


# --- stored tables ---------------------------------------------------------------------


@query
def upsert_demand(spark, sf_dir):
    stored = fx.demand_table(fx.demand_provisional(spark, sf_dir))
    revised = feeds.since(fx.demand_table(fx.demand_raw(spark, sf_dir)), RECENT_START)
    return publish(keyed.upsert(stored, revised, ["zone", "date"]))


def _weather_sources(spark, sf_dir):
    stored = fx.weather_readings(fx.day_weather(spark, sf_dir, "O")).select("date", *WEATHER_READINGS)
    newer = fx.weather_readings(fx.day_weather(spark, sf_dir, "F")).select("date", *WEATHER_READINGS)
    return stored, feeds.since(newer, SOURCE_SWITCH)


@query
def upsert_weather(spark, sf_dir):
    stored, newer = _weather_sources(spark, sf_dir)
    return publish(keyed.upsert(stored, newer, ["date"]))


@query
def upsert_forecast(spark, sf_dir):
    """A forecast issued twice for one date: the snapshot with the later issue stays."""
    stored, newer = _weather_sources(spark, sf_dir)
    stored, newer = (s.withColumnRenamed("date", "target_date") for s in (stored, newer))
    first_issue = newer.withColumns({"issue": F.lit(1), "tempmax": F.col("tempmax") + 5.0})
    issues = first_issue.unionByName(newer.withColumn("issue", F.lit(2)))
    return publish(keyed.upsert(stored, issues, ["target_date"], newest=["issue"]))


@query
def upsert_prediction(spark, sf_dir):
    demand = fx.demand(spark, sf_dir)
    later = feeds.since(fx.persistence_table(demand, 1), RECENT_START, "target_date")
    return publish(keyed.upsert(fx.persistence_table(demand, 7), later, jobs.KEYS))


def _scores(spark, sf_dir, actual: DataFrame, lag: int = 7) -> DataFrame:
    predictions = fx.persistence_table(fx.demand(spark, sf_dir), lag)
    joined = scoring.prediction_actuals(predictions, fx.demand_table(actual))
    return scoring.score_rows(joined)


@query
def upsert_score(spark, sf_dir):
    stored = _scores(spark, sf_dir, fx.demand_provisional(spark, sf_dir))
    fresh = feeds.since(_scores(spark, sf_dir, fx.demand(spark, sf_dir)), RECENT_START, "target_date")
    return publish(keyed.upsert(stored, fresh, jobs.KEYS))


@query
def bootstrap_demand(spark, sf_dir):
    history = fx.demand_table(fx.demand(spark, sf_dir))
    return publish(keyed.upsert(history.limit(0), history, ["zone", "date"]))


@query
def bootstrap_weather(spark, sf_dir):
    history = fx.weather_readings(fx.day_weather(spark, sf_dir)).select("date", *WEATHER_READINGS)
    return publish(keyed.upsert(history.limit(0), history, ["date"]))


@query
def backfill_demand(spark, sf_dir):
    history = fx.demand_table(fx.demand(spark, sf_dir)).filter(F.col("date") < F.lit(BACKFILL_START).cast("date"))
    late = feeds.since(fx.demand_table(fx.demand_raw(spark, sf_dir)), BACKFILL_START)
    return publish(keyed.upsert(history, late, ["zone", "date"]))


@query
def backfill_weather(spark, sf_dir):
    """A missing required reading stops the backfill; missing snow depth means none."""
    history = fx.weather_readings(fx.day_weather(spark, sf_dir, "O")).select("date", *WEATHER_READINGS)
    late = feeds.since(fx.weather_readings(fx.day_weather(spark, sf_dir)).select("date", *WEATHER_READINGS), BACKFILL_START)
    validated = validate.require_valid_weather(late)
    stored = history.filter(F.col("date") < F.lit(BACKFILL_START).cast("date"))
    return publish(keyed.upsert(stored, validated.fillna(0.0, ["snowdepth"]), ["date"]))


# --- gaps ------------------------------------------------------------------------------


@query
def calendar_densify(spark, sf_dir):
    return publish(panel.densify(fx.demand_raw(spark, sf_dir)))


@query
def impute_ratio(spark, sf_dir):
    return publish(fx.demand(spark, sf_dir))


@query
def impute_unfillable(spark, sf_dir):
    return publish(impute.unfillable(fx.imputed(spark, sf_dir)))


@query
def impute_backtest(spark, sf_dir):
    raw = fx.demand_raw(spark, sf_dir)
    return publish(impute.impute_backtest(raw, fx.parent_series(raw)), 4)


@query
def impute_doy_ratio(spark, sf_dir):
    raw = fx.demand_raw(spark, sf_dir)
    return publish(impute.filled(impute.doy_ratio_impute(raw, fx.parent_series(raw))))


# --- features --------------------------------------------------------------------------


@query
def calendar_features(spark, sf_dir):
    return publish(features.calendar_features(fx.demand_raw(spark, sf_dir)))


@query
def degree_days(spark, sf_dir):
    return publish(features.degree_days(fx.station(fx.day_weather(spark, sf_dir))))


@query
def modelling_table(spark, sf_dir):
    return publish(fx.modelling(spark, sf_dir))


@query
def thermal_inertia(spark, sf_dir):
    return publish(fx.modelling(spark, sf_dir).select("zone", "period", *THERMAL_COLUMNS))


@query
def next_day_target(spark, sf_dir):
    return publish(features.next_day_target(fx.demand(spark, sf_dir)))


@query
def demand_lags(spark, sf_dir):
    return publish(features.demand_lags(fx.demand(spark, sf_dir)))


@query
def demand_rolling(spark, sf_dir):
    return publish(features.demand_rolling(fx.demand(spark, sf_dir)))


@query
def live_demand_features(spark, sf_dir):
    """On the gappy raw series, where date-exact and positional lags differ."""
    return publish(features.live_demand_features(fx.demand_raw(spark, sf_dir)))


@query
def next_day_features(spark, sf_dir):
    table = features.next_day_features(fx.modelling(spark, sf_dir))
    added = [c for c in table.columns if c.endswith(("_fc", "_next"))]
    return publish(table.select("zone", "period", *added))


@query
def forecast_features(spark, sf_dir):
    table = features.forecast_features(fx.modelling(spark, sf_dir))
    return publish(table.select("zone", "period", *FORECAST_FEATURES, "target"))


@query
def daylight_hours(spark, sf_dir):
    return publish(live.daylight_hours(fx.timeline(spark, sf_dir)).select("date", "sunrise", "sunset", "daylight_hours"))


@query
def live_forecast_features(spark, sf_dir):
    return publish(live.live_forecast_features(fx.timeline(spark, sf_dir)))


@query
def live_thermal_inertia(spark, sf_dir):
    timeline = fx.timeline(spark, sf_dir)
    return publish(live.live_thermal_inertia(timeline, live.live_forecast_features(timeline)))


@query
def inference_row(spark, sf_dir):
    return publish(jobs.inference_table(fx.demand(spark, sf_dir), fx.timeline(spark, sf_dir)))


@query
def inertia_skew(spark, sf_dir):
    timeline = fx.timeline(spark, sf_dir)
    served = live.live_thermal_inertia(timeline, live.live_forecast_features(timeline))
    return publish(live.inertia_skew(features.next_day_features(fx.modelling(spark, sf_dir)), served))


def _featureset(name: str) -> None:
    def build(spark, sf_dir):
        return publish(features.feature_set(fx.modelling(spark, sf_dir), name))

    build.__name__ = f"featureset_{name}"
    query(build)


for _name in ("all", "forecast", "inference", "simple", "select"):
    _featureset(_name)


@query
def select_features(spark, sf_dir):
    return publish(features.drop_columns(fx.modelling(spark, sf_dir), ["snow", "snwd"]))


@query
def fill_snow_depth(spark, sf_dir):
    return publish(fx.station(fx.day_weather(spark, sf_dir)).fillna(0.0, ["snwd"]))


@query
def dropna_rows(spark, sf_dir):
    history = features.history_features(fx.demand(spark, sf_dir)).select("zone", "period", *HISTORY_FEATURES, "target")
    return publish(history.dropna())


@query
def seasonal_features(spark, sf_dir):
    return publish(features.seasonal_features(fx.demand_raw(spark, sf_dir).select("zone", "period")))


@query
def regime_dummies(spark, sf_dir):
    regimes = {"shift": ("1998-03-15", "1999-06-30"), "post": ("1999-07-01", None)}
    return publish(features.regime_dummies(fx.demand_raw(spark, sf_dir), regimes))


# --- checks ----------------------------------------------------------------------------


@query
def feature_null_report(spark, sf_dir):
    rows = jobs.inference_table(fx.demand_raw(spark, sf_dir), fx.timeline(spark, sf_dir))
    return publish(validate.feature_null_report(rows, INFERENCE_FEATURES))


@query
def validate_weather(spark, sf_dir):
    readings = fx.weather_readings(fx.day_weather(spark, sf_dir))
    return publish(validate.invalid_weather(readings, WEATHER_READINGS))


@query
def alignment_audit(spark, sf_dir):
    table = features.next_day_features(features.history_features(fx.modelling(spark, sf_dir).fillna(0.0, ["snwd"])))
    kept = table.dropna(subset=FORECAST_FEATURES + ["target"])
    return publish(validate.alignment_audit(kept, fx.demand(spark, sf_dir)))


@query
def freshness_gate(spark, sf_dir):
    return publish(validate.freshness_gate(fx.demand_raw(spark, sf_dir), fx.TODAY))


@query
def table_constraints(spark, sf_dir):
    demand = fx.demand_table(fx.demand(spark, sf_dir))
    feed = fx.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("zone"), F.to_date("ts").alias("date"), F.col("value").alias("demand")
    )
    timeline = fx.weather_readings(fx.day_weather(spark, sf_dir))
    predictions = fx.persistence_table(fx.demand(spark, sf_dir), 7)
    scores = _scores(spark, sf_dir, fx.demand(spark, sf_dir), lag=1)
    findings = [
        validate.key_violations(demand, ["zone", "date"], "demand_daily"),
        validate.null_violations(demand, ["demand", "is_imputed"], "demand_daily"),
        validate.key_violations(feed, ["zone", "date"], "demand_feed"),
        validate.null_violations(timeline, ["snowdepth"], "weather_daily"),
        validate.key_violations(predictions, jobs.KEYS, "predictions"),
        validate.reference_violations(scores, predictions, jobs.KEYS, "prediction_scores"),
    ]
    union = findings[0]
    for finding in findings[1:]:
        union = union.unionByName(finding)
    return publish(union)


@query
def split_report(spark, sf_dir):
    rows = features.feature_set(fx.modelling(spark, sf_dir), "forecast")
    return publish(splits.split_report(splits.time_split(rows, fx.TRAIN_END, fx.VAL_END)))


# --- splits, baselines, scores ---------------------------------------------------------


@query
def time_split(spark, sf_dir):
    return publish(splits.time_split(fx.demand(spark, sf_dir), fx.TRAIN_END, fx.VAL_END))


@query
def cv_folds(spark, sf_dir):
    return publish(splits.expanding_blocks(fx.demand(spark, sf_dir)).select("zone", "period", "block"))


@query
def cv_fold_report(spark, sf_dir):
    return publish(splits.fold_report(splits.expanding_blocks(fx.demand(spark, sf_dir))))


def _persistence(spark, sf_dir) -> DataFrame:
    """Predictions of the three baselines on the validation part."""
    history = features.history_features(fx.demand(spark, sf_dir)).dropna(subset=HISTORY_FEATURES + ["target"])
    val = splits.time_split(history, fx.TRAIN_END, fx.VAL_END).filter(F.col("split") == "val")
    return splits.persistence_predictions(val)


@query
def persistence_baseline(spark, sf_dir):
    return publish(_persistence(spark, sf_dir))


@query
def offline_metrics(spark, sf_dir):
    return publish(scoring.offline_metrics(_persistence(spark, sf_dir), ["zone", "model"]))


@query
def skill_score(spark, sf_dir):
    metrics = scoring.offline_metrics(_persistence(spark, sf_dir), ["zone", "model"])
    return publish(scoring.skill_scores(metrics, PERSISTENCE_BASE))


@query
def model_leaderboard(spark, sf_dir):
    return publish(scoring.leaderboard(scoring.offline_metrics(_persistence(spark, sf_dir), ["zone", "model"])))


@query
def prediction_actuals(spark, sf_dir):
    demand = fx.demand(spark, sf_dir)
    return publish(
        scoring.prediction_actuals(
            fx.persistence_table(demand, 7), fx.demand_table(demand), fx.TRAIN_END, "2001-06-30"
        )
    )


@query
def score_rows(spark, sf_dir):
    return publish(_scores(spark, sf_dir, fx.demand(spark, sf_dir)))


@query
def score_summary(spark, sf_dir):
    return publish(scoring.score_summary(_scores(spark, sf_dir, fx.demand(spark, sf_dir)), ["zone"]), 4)


@query
def trailing_scores(spark, sf_dir):
    return publish(scoring.trailing_scores(_scores(spark, sf_dir, fx.demand(spark, sf_dir)), fx.TODAY), 4)


@query
def latest_score(spark, sf_dir):
    return publish(scoring.latest_score(_scores(spark, sf_dir, fx.demand(spark, sf_dir))))


# --- exploration -----------------------------------------------------------------------


@query
def yearly_level(spark, sf_dir):
    return publish(explore.yearly_level(explore.observed(fx.demand(spark, sf_dir))), 4)


@query
def temperature_bins(spark, sf_dir):
    return publish(explore.temperature_bins(explore.observed(fx.modelling(spark, sf_dir))), 4)


@query
def yoy_overlay(spark, sf_dir):
    return publish(explore.yoy_overlay(fx.demand(spark, sf_dir)))


@query
def yoy_smoothed(spark, sf_dir):
    return publish(explore.yoy_smoothed(fx.demand(spark, sf_dir)), 4)


@query
def weekday_box(spark, sf_dir):
    return publish(explore.weekday_box(explore.observed(features.calendar_features(fx.demand(spark, sf_dir)))), 4)


@query
def calendar_effects(spark, sf_dir):
    return publish(explore.calendar_effects(explore.observed(features.calendar_features(fx.demand(spark, sf_dir)))), 4)


@query
def autocorrelation(spark, sf_dir):
    return publish(explore.autocorrelation(explore.observed(fx.demand(spark, sf_dir))))


@query
def corr_matrix(spark, sf_dir):
    return publish(moments.pairwise_correlation(fx.modelling(spark, sf_dir), explore.NUMERIC_COLUMNS, ["zone"]))


@query
def corr_clusters(spark, sf_dir):
    matrix = moments.pairwise_correlation(fx.modelling(spark, sf_dir), explore.NUMERIC_COLUMNS, ["zone"])
    return publish(moments.correlated_pairs(matrix))


@query
def regime_correlation(spark, sf_dir):
    return publish(explore.regime_correlation(fx.modelling(spark, sf_dir)))


@query
def regime_profile(spark, sf_dir):
    return publish(explore.regime_profile(fx.modelling(spark, sf_dir)), sd_demand=2)


@query
def thermal_inertia_effect(spark, sf_dir):
    return publish(explore.thermal_inertia_effect(fx.modelling(spark, sf_dir)))


VIF_FEATURES = [c for c in explore.NUMERIC_COLUMNS if c not in ("value", "day_of_week")]


@query
def vif(spark, sf_dir):
    rows = explore.observed(fx.modelling(spark, sf_dir)).dropna(subset=VIF_FEATURES)
    # Near-collinear features lose digits: great values are told to the hundred.
    whole = F.when(F.col("vif") < 1e4, F.col("vif")).otherwise(F.rint(F.col("vif") / 100) * 100)
    return publish(linear.variance_inflation(rows, VIF_FEATURES).withColumn("vif", whole), 2)


@query
def base_scan(spark, sf_dir):
    rows = explore.observed(fx.modelling(spark, sf_dir)).filter(F.col("tavg").isNotNull())
    return publish(linear.base_scan(rows))


# --- models ----------------------------------------------------------------------------


def _model_rows(spark, sf_dir) -> DataFrame:
    """Inference feature set with its split, stored once so that fits do not rebuild it."""
    rows = features.feature_set(fx.modelling(spark, sf_dir), "inference")
    return materialised(splits.time_split(rows, fx.TRAIN_END, fx.VAL_END), "model-rows")


def _train(rows: DataFrame) -> DataFrame:
    return splits.expanding_blocks(rows.filter(F.col("split") == "train"))


@query
def standardize(spark, sf_dir):
    """Validation and training rows of the short feature set on the training scale, per zone."""
    rows = features.feature_set(fx.modelling(spark, sf_dir), "simple")
    rows = splits.time_split(rows, fx.TRAIN_END, fx.VAL_END)
    names = ["lag_0", "rolling_7", "hdd_fc", "cdd_fc"]
    scaled = moments.standardised(
        rows.select("zone", "period", "split", *names), names, ["zone"], fit_on=F.col("split") == "train"
    )
    return publish(scaled)


@query
def ridge_cv(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    train, val = _train(rows), rows.filter(F.col("split") == "val")
    models = materialised(linear.ridge_cv(train, INFERENCE_FEATURES), "ridge-models")
    predicted = linear.ridge_predict(val, models, INFERENCE_FEATURES, rows.filter(F.col("split") == "train"))
    metrics = scoring.offline_metrics(predicted.withColumnRenamed("target", "actual"), ["zone"])
    return publish(models.select("zone", "n_rows", "alpha", "r2").join(metrics, "zone"))


@query
def feature_importance(spark, sf_dir):
    models = linear.ridge_cv(_train(_model_rows(spark, sf_dir)), INFERENCE_FEATURES)
    return publish(linear.coefficient_importance(models, INFERENCE_FEATURES), 3)


@query
def forward_selection(spark, sf_dir):
    train = _train(_model_rows(spark, sf_dir))
    return publish(linear.forward_selection(train, INFERENCE_FEATURES), 3)


FOREST_POINTS = trees.grid_points(trees.FOREST_GRID)
POINT = ["num_trees", "max_depth", "min_leaf", "share"]


def _forest_points(rows: DataFrame) -> DataFrame:
    """Every zone's error at every grid point, searched once per training table."""

    def search(train):
        return forest.by_point(forest.nested_search(train, INFERENCE_FEATURES, trees.FOREST_GRID))

    return stored(_train(rows).select("zone", "period", "block", "target", *INFERENCE_FEATURES), "forest-points", search)


@query
def rf_grid(spark, sf_dir):
    """The 108 points of the forest grid, best first, by the mean of the zones' CV MAE."""
    points = _forest_points(_model_rows(spark, sf_dir)).groupBy(*POINT)
    points = points.agg(F.avg("cv_mae").alias("cv_mae"), F.count("cv_mae").alias("zones"), F.min("folds_used").alias("folds_used"))
    return publish(points.withColumn("place", F.row_number().over(Window.orderBy("cv_mae", *POINT))))


@query
def rf_winners(spark, sf_dir):
    """Each zone's best forest point."""
    return publish(forest.winners(_forest_points(_model_rows(spark, sf_dir))))


def _boosted_report(spark, sf_dir, points: list) -> DataFrame:
    """The points, best first, by the mean of the zones' CV MAE."""
    scores = boosting.search_points(boosting.staged_search(_train(_model_rows(spark, sf_dir)), INFERENCE_FEATURES, points))
    told = scores.groupBy("point").agg(F.avg("cv_mae").alias("cv_mae"), F.count("cv_mae").alias("zones"), F.min("folds_used").alias("folds_used"))
    names = spark.createDataFrame([(n, p.text()) for n, p in enumerate(points)], "point int, params string")
    place = F.row_number().over(Window.orderBy("cv_mae", "point"))
    return publish(told.join(F.broadcast(names), "point").withColumn("place", place).drop("point"))


@query
def gbt_grid(spark, sf_dir):
    """The 48 points of the boosted grid."""
    return _boosted_report(spark, sf_dir, boosting.depth_points(trees.grid_points(trees.BOOSTED_GRID)))


@query
def gbt_search(spark, sf_dir):
    """75 points drawn from the depth-limited grid."""
    return _boosted_report(spark, sf_dir, boosting.depth_points(trees.random_points(trees.BOOSTED_RANDOM)))


@query
def leaf_wise_search(spark, sf_dir):
    """75 points drawn from the leaf-wise learner's grid, with L1 and L2."""
    return _boosted_report(spark, sf_dir, boosting.leaf_points(trees.random_points(boosting.LEAF_GRID)))


# The early-stopped fit.
EARLY = boosting.Point(rounds=1000, rate=0.05, leaves=None, max_depth=5, min_rows=1, row_share=0.8, column_share=0.8)
PATIENCE = 30


@query
def gbt_early_stop(spark, sf_dir):
    """Where each zone's boosting stops once 30 rounds have not improved on the validation rows."""
    rows = _model_rows(spark, sf_dir)
    train, val = (rows.filter(F.col("split") == s) for s in ("train", "val"))
    return publish(boosting.early_stop(boosting.learning_curve(train, val, INFERENCE_FEATURES, EARLY, patience=PATIENCE), PATIENCE))


def _known(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("split").isin("train", "val"))


def _final_trees(rows: DataFrame) -> DataFrame:
    """Each zone's winning forest refitted on train and validation rows, fitted once per table."""
    chosen = forest.winners(_forest_points(rows))
    known = _known(rows).select("zone", "period", "target", *INFERENCE_FEATURES)
    return stored(known, "forest-trees", lambda known: forest.fit_forests(known, chosen, INFERENCE_FEATURES))


@query
def refit_final(spark, sf_dir):
    """Forests refitted on train and validation rows, judged on the test rows."""
    rows = _model_rows(spark, sf_dir)
    test = rows.filter(F.col("split") == "test")
    predicted = forest.predict_forests(_final_trees(rows), test, INFERENCE_FEATURES, ["zone", "period", "target"])
    renamed = predicted.withColumnsRenamed({"target": "actual", "predicted_demand": "predicted"})
    return publish(scoring.offline_metrics(renamed, ["zone"]))


@query
def tree_importance(spark, sf_dir):
    return publish(forest.importance(_final_trees(_model_rows(spark, sf_dir)), INFERENCE_FEATURES))


@query
def predict_batch(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    inputs = rows.filter(F.col("split") == "test").select("zone", "period", *INFERENCE_FEATURES)
    return publish(forest.predict_rows(_final_trees(rows), inputs, INFERENCE_FEATURES, ["zone", "period"]))


# --- daily jobs ------------------------------------------------------------------------


def _upserted_events(spark, sf_dir, changes_only):
    schema = fx.table(spark, sf_dir, "events").schema
    landed = ingest.landed_files(spark, sf_dir, schema, glob="events.parquet")
    feed = landed.select(
        F.col("event_type").alias("zone"),
        F.to_date("ts").alias("date"),
        F.col("value").alias("demand"),
        F.lit(False).alias("is_imputed"),
        F.col("event_id").alias("seq"),
    )
    table_path = scratch_path(spark, "demand-daily")
    ingest.run_upserts(feed, table_path, scratch_path(spark, "stream-state"), changes_only)
    return publish(read_monthly_table(spark, table_path))


@query
def stream_ingest_upsert(spark, sf_dir):
    return _upserted_events(spark, sf_dir, False)


@query
def stream_newest_upsert(spark, sf_dir):
    """The same table through a stream that keeps each key's newest row as state."""
    return _upserted_events(spark, sf_dir, True)


@query
def rescore_revisions(spark, sf_dir):
    """Scores made on first-published demand, refreshed where the trailing window was revised."""
    stored = _scores(spark, sf_dir, fx.demand_provisional(spark, sf_dir))
    predictions = fx.persistence_table(fx.demand(spark, sf_dir), 7)
    revised = fx.demand_table(fx.demand(spark, sf_dir))
    return publish(keyed.upsert(stored, ingest.rescored(revised, predictions, fx.TODAY), jobs.KEYS))


@query
def daily_evaluation(spark, sf_dir):
    demand = fx.demand(spark, sf_dir)
    stored = _scores(spark, sf_dir, fx.demand_provisional(spark, sf_dir))
    table, _ = jobs.daily_evaluation(fx.persistence_table(demand, 7), fx.demand_table(demand), stored, fx.TODAY)
    return publish(scoring.score_summary(table, ["zone"]), 4)


@query
def daily_forecast(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    model, path = _final_trees(rows), scratch_path(spark, "forest-v1")
    chosen, ranked = forest.winners(_forest_points(rows)), forest.importance(model, INFERENCE_FEATURES)
    chosen.write.parquet(f"{path}/params")
    mean = chosen.agg(F.avg("cv_mae")).first()[0]
    artefacts.save_model(
        spark, model, path, INFERENCE_FEATURES, {"cv_mae": mean}, {"table": "params"}, _known(rows).count(), fx.TRAIN_END, fx.VAL_END, ranked
    )
    model = artefacts.load_trees(spark, path)
    demand, timeline = fx.demand(spark, sf_dir), fx.timeline(spark, sf_dir)
    predictions = jobs.daily_forecast(demand, timeline, model, "2001-08-01", "forest_v1")
    return publish(predictions)


@query
def daily_forecast_status(spark, sf_dir):
    """What became of each zone in the daily forecast."""
    return publish(jobs.forecast_status(fx.demand(spark, sf_dir), fx.timeline(spark, sf_dir), "2001-08-01"))


RUN_DAYS = ["2001-07-29", "2001-07-30", "2001-07-31", "2001-08-01"]


@query
def forecast_hold_over(spark, sf_dir):
    """Four daily runs over one ledger: yesterday's demand as first published, older days as revised.

    A zone without demand for yesterday is held over and predicted by the next run if the revision
    brought it; after three tries it is missed. The prediction is the day before, as then known.
    """
    first, revised = fx.demand_provisional(spark, sf_dir), fx.demand_raw(spark, sf_dir)
    ledger, predictions = scratch_path(spark, "ledger"), scratch_path(spark, "predictions")
    for day in RUN_DAYS:
        yesterday = F.date_sub(F.to_date(F.lit(day)), 1)
        known = first.filter(F.col("period") == yesterday).unionByName(revised.filter(F.col("period") < yesterday))

        def persist(pairs, known=known):
            before = known.select("zone", F.date_add("period", 1).alias("target_date"), F.col("value").cast("double").alias("predicted_demand"))
            return pairs.join(before, jobs.KEYS)

        holdover.run_forecast(spark, ledger, predictions, known, day, day, persist)
    told = read_monthly_table(spark, ledger).join(read_monthly_table(spark, predictions), jobs.KEYS, "left")
    return publish(told)
