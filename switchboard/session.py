"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "switchboard", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    A master, shuffle width and memory are left to the cluster unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


ONE_SPLIT = 128 * 1024 * 1024
_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without one, a local folder if the driver is the only machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="switchboard-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage through a written table, which survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Gives every core a share of a table too small to be split by the reader.

    A file below one split is read by a single task, which is slow for heavy
    text expressions.  Larger inputs arrive in many partitions already and are
    returned as they are, without a shuffle.
    """
    spark = df.sparkSession
    if not hasattr(df, "_jdf"):  # no plan statistics over a remote session
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism, key) if size < ONE_SPLIT else df


#: input of a task whose rows are multiplied before they are grouped
KEYED_SPLIT = 16 * 1024 * 1024
UNKNOWN_SIZE = 1_000_000


def by_key(df: DataFrame, key: str) -> DataFrame:
    """All rows of a key in one task, so that what is exploded from them is grouped by key without a further shuffle.

    The rows are moved once and whole, which is less than to move all that comes out of them.
    """
    if not hasattr(df, "_jdf"):  # no plan statistics over a remote session
        return df.repartition(key)
    tasks = -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // KEYED_SPLIT)
    if tasks > UNKNOWN_SIZE:  # rows that don't come from files have no size
        return df.repartition(key)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, tasks), key)
