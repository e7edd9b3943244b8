"""The snapshot log: whole states only, whatever dies or races."""

import datetime as dt

import pytest

from voltpanel.sinks import snapshots, tables

D = dt.date
SCHEMA = "zone string, date date, demand double"
KEYS = ["zone", "date"]
START = [("a", D(2026, 1, 5), 1.0), ("a", D(2026, 2, 5), 2.0), ("b", D(2026, 2, 6), 3.0)]
LATE = [("a", D(2026, 2, 5), 20.0), ("b", D(2026, 3, 1), 4.0)]
MERGED = [("a", D(2026, 1, 5), 1.0), ("a", D(2026, 2, 5), 20.0), ("b", D(2026, 2, 6), 3.0), ("b", D(2026, 3, 1), 4.0)]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "demand")
    tables.upsert_table(spark, path, spark.createDataFrame(START, SCHEMA), KEYS, "date")
    return path


def test_a_writer_that_dies_before_the_commit_leaves_the_old_table(spark, path, monkeypatch):
    late = spark.createDataFrame(LATE, SCHEMA)

    def dies(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            tables.upsert_table(spark, path, late, KEYS, "date")
    assert rows_of(tables.read_monthly_table(spark, path)) == START
    tables.upsert_table(spark, path, late, KEYS, "date")
    assert rows_of(tables.read_monthly_table(spark, path)) == MERGED
    tables.upsert_table(spark, path, late, KEYS, "date")
    assert rows_of(tables.read_monthly_table(spark, path)) == MERGED


def test_a_reader_keeps_its_version_and_untouched_months_their_files(spark, path):
    before = tables.read_monthly_table(spark, path)
    tables.upsert_table(spark, path, spark.createDataFrame(LATE, SCHEMA), KEYS, "date")
    assert rows_of(before) == START and rows_of(snapshots.read(spark, path, 0)) == START
    january = {f.split("/data/")[1] for f in snapshots.read(spark, path, months=[202601]).inputFiles()}
    assert january == {f.split("/data/")[1] for f in snapshots.read(spark, path, 0, [202601]).inputFiles()}
    assert rows_of(snapshots.read(spark, path, months=[202602])) == MERGED[1:3]


def test_the_second_of_two_writers_is_refused(spark, path):
    base, schema = snapshots.latest(spark, path), snapshots.read(spark, path).schema
    one = snapshots.stage(tables._with_month(spark.createDataFrame(LATE[:1], SCHEMA), "date"), path)
    two = snapshots.stage(tables._with_month(spark.createDataFrame(LATE[1:], SCHEMA), "date"), path)
    assert snapshots.commit(spark, path, base, two, schema) == 1
    with pytest.raises(snapshots.ConcurrentCommit):
        snapshots.commit(spark, path, base, one, schema)
    assert rows_of(tables.read_monthly_table(spark, path)) == START + LATE[1:]
    assert snapshots.versions(spark, path) == [0, 1]


def test_expiry_keeps_what_is_read(spark, path):
    for n in range(3):
        tables.upsert_table(spark, path, spark.createDataFrame([("a", D(2026, 2, 5), float(n))], SCHEMA), KEYS, "date")
    staged = snapshots.stage(tables._with_month(spark.createDataFrame(LATE, SCHEMA), "date"), path)
    assert snapshots.expire(spark, path, keep=1) == 3 and snapshots.versions(spark, path) == [3]
    assert rows_of(tables.read_monthly_table(spark, path)) == [START[0], ("a", D(2026, 2, 5), 2.0), START[2]]
    # A writer at work when the old versions went can still commit.
    snapshots.commit(spark, path, 3, staged, snapshots.read(spark, path).schema)
    assert ("b", D(2026, 3, 1), 4.0) in rows_of(tables.read_monthly_table(spark, path))
    with pytest.raises(ValueError):
        snapshots.expire(spark, path, keep=0)


def test_empty_and_replaced_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not tables.table_exists(spark, path) and snapshots.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        tables.read_monthly_table(spark, path)
    tables.create_monthly_table(spark.createDataFrame([], SCHEMA), path, "date")
    assert tables.table_exists(spark, path) and rows_of(tables.read_monthly_table(spark, path)) == []
    for rows in (START, LATE):
        tables.create_monthly_table(spark.createDataFrame(rows, SCHEMA), path, "date")
        assert rows_of(tables.read_monthly_table(spark, path)) == rows
