"""Named queries against DuckDB on the test tables; VOLTPANEL_ALL=1 runs every one."""

import math
import os

import pytest

import __spark_entry__ as driver

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer orders lineitem events documents".split()
DEFAULT = """
    src_paged_json src_struct_of_arrays src_array_of_structs merge_sources_keep_newest upsert_prediction upsert_score
    impute_ratio impute_unfillable modelling_table live_demand_features inference_row featureset_all
    featureset_forecast alignment_audit cv_folds offline_metrics trailing_scores weekday_box autocorrelation
    regime_correlation stream_ingest_upsert stream_newest_upsert rescore_revisions forecast_hold_over vif ridge_cv feature_importance
""".split()
CHECKED = sorted(driver.oracle_sql()) if os.environ.get("VOLTPANEL_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{float(value) + 0.0:.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, con, name):
    frame = driver.queries()[name](spark, sf_dir)
    answer = con.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    assert normal(frame.columns, frame.collect()) == normal(columns, answer.fetchall())


def test_flagship(spark, sf_dir):
    assert driver.entry(spark).columns == ["zone", "model", "n", "mae", "rmse", "mape", "bias"]


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
