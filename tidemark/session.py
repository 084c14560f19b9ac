"""Session helpers shared by tests, the bench and standalone jobs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "tidemark", partitions: int = 8) -> SparkSession:
    """A small local session; on a cluster the caller's own session is used as is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Window frames cost much CPU per byte, so small shuffles keep several tasks.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as ``spark.checkpoint.dir`` names it.

    Only a session in one process, as in tests, may go without the setting; it
    gets one temporary folder.  Anywhere else executors would write to their own
    disks, so a missing setting is an error.
    """
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if shared:
        return shared
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    return _LOCAL[context.applicationId]


def run_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; everything staged lies below it."""
    return f"{checkpoint_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{uuid.uuid4().hex}/{name}"


def _path(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _path(spark, path)
    return system.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where, system = _path(spark, path)
    return system.exists(where) and system.getFileStatus(where).isDirectory()


def snapshot(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table from another: its files' count, bytes and newest time; empty if it is not there."""
    where, system = _path(spark, path)
    if not system.exists(where):
        return ()
    files = system.listStatus(where)
    return len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def drop_staged(spark: SparkSession) -> None:
    """Delete all that this application staged; frames built before must not be read after it."""
    where, system = _path(spark, run_folder(spark))
    system.delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a reduced table to the shared folder and read it back.

    For tables that several branches of one plan read: the raw data is scanned
    once, the plan that follows starts at a parquet scan with statistics and
    column pruning, and the loss of an executor costs no recomputation.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
