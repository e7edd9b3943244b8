"""Session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "voltpanel", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the cluster sets it.

    Only where it is unset and everything runs on this machine (tests, a laptop) does a
    fresh local folder stand in; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if not root:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _context_dir(spark: SparkSession) -> str | None:
    """The checkpoint folder of the context, where a session has one."""
    try:
        return spark.sparkContext.getCheckpointDir()
    except (AttributeError, NotImplementedError):  # a client session without a context
        return None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, label: str, build) -> DataFrame:
    """What ``build`` makes of ``rows``, kept in the shared folder under a digest of the rows.

    The same rows give the stored table back; other rows, or a run that died before its end,
    build it anew. The rows' order does not matter; ``label`` names what is built and how.
    """
    spark = rows.sparkSession
    told = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    digest = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*told)), F.sum(F.hash(*told).cast("long"))).first()
    mark = f"{shared_dir(spark).rstrip('/')}/{label}-" + "-".join(str(d) for d in digest)
    try:
        path = spark.read.parquet(mark).first()[0]
    except AnalysisException:  # no such folder
        path = scratch_path(spark, label)
        build(rows).write.parquet(path)
        spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("overwrite").parquet(mark)
    return spark.read.parquet(path)


def materialised(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, cut from their lineage,
    and safe from the loss of the executors that computed them."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
