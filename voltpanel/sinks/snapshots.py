"""Snapshot log: a month-partitioned table whose every state is one numbered manifest.

``data/`` holds immutable folders, one per commit and month; ``log/<number>`` lists which of
them make up the table. A writer fills a new data folder, then renames its manifest into
place. Readers follow the greatest number, so they see the table before or after a commit
and never between: a writer that dies leaves unreferenced files and nothing else. Two
writers that start from one number conflict on the rename, and the second one raises
``ConcurrentCommit`` (its file system must refuse to rename onto a file, as HDFS does).

A manifest names one folder per month, so its size is bounded by the calendar.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MONTH = "month"
DIGITS = 12


class ConcurrentCommit(RuntimeError):
    """Another writer committed first; read the table again and repeat the update."""


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm


def _path(spark: SparkSession, path: str):
    return _jvm(spark).org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that are still there, ascending; none for no table."""
    log = f"{path}/log"
    fs = _fs(spark, log)
    if not fs.exists(_path(spark, log)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, log))]
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/log/{version:0{DIGITS}d}", wholetext=True).first().value)


def latest(spark: SparkSession, path: str) -> int | None:
    known = versions(spark, path)
    return known[-1] if known else None


def read(spark: SparkSession, path: str, version: int | None = None, months: list[int] | None = None) -> DataFrame:
    """The table at a version (the last one by default), only ``months`` of it if given.

    The other months' folders are not opened.
    """
    number = latest(spark, path) if version is None else version
    if number is None:
        raise FileNotFoundError(f"no snapshot table at {path}")
    held = _manifest(spark, path, number)
    schema = StructType.fromJson(held["schema"])
    folders = [f"{path}/{f}" for m, f in sorted(held["months"].items()) if months is None or int(m) in months]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def stage(rows: DataFrame, path: str) -> dict[str, str]:
    """Write rows that carry ``month`` to a new data folder; nothing refers to it yet.

    Returns the months' folders. They are listed from the file system, not counted in Spark.
    """
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    rows.write.partitionBy(MONTH).parquet(f"{path}/{folder}")
    fs = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, f"{path}/{folder}"))]
    return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{MONTH}=")}


def commit(
    spark: SparkSession, path: str, base: int | None, months: dict[str, str], schema: StructType, replace: bool = False
) -> int:
    """Make ``months`` replace their namesakes of version ``base`` (with ``replace``, all of it),
    as the next version."""
    kept = {} if base is None or replace else _manifest(spark, path, base)["months"]
    number = 0 if base is None else base + 1
    written = json.dumps({"schema": schema.jsonValue(), "months": {**kept, **months}})
    ready, place = f"{path}/log/.{uuid.uuid4().hex}", f"{path}/log/{number:0{DIGITS}d}"
    out = _fs(spark, path).create(_path(spark, ready), False)
    out.write(bytearray(written.encode("utf-8")))
    out.close()
    jvm = _jvm(spark)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _fs(spark, path).getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(_path(spark, ready), _path(spark, place), no_options)
    except Py4JJavaError as error:
        _fs(spark, path).delete(_path(spark, ready), False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise ConcurrentCommit(f"version {number} of {path} was committed by another writer") from error
        raise
    return number


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` versions and the folders that only they refer to.

    Folders that no manifest ever named (a writer at work, or one that died) are left alone.
    Returns how many folders went.
    """
    if keep < 1:
        raise ValueError("the last version cannot expire")
    known = versions(spark, path)
    old, kept = known[:-keep], known[-keep:]
    used = {f for v in kept for f in _manifest(spark, path, v)["months"].values()}
    gone = {f for v in old for f in _manifest(spark, path, v)["months"].values()} - used
    fs = _fs(spark, path)
    # Manifests first: no reader may find a version whose files are going.
    for v in old:
        fs.delete(_path(spark, f"{path}/log/{v:0{DIGITS}d}"), False)
    for folder in gone:
        fs.delete(_path(spark, f"{path}/{folder}"), True)
    return len(gone)
