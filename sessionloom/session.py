"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "sessionloom") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SESSIONLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode.

    A folder on one machine's disk is unreadable to other executors, so on a cluster the
    setting `spark.checkpoint.dir` is required.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sessionloom-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Files that a task of a partitioned write keeps open at a time.
OPEN_FILES = 8
_OPEN_FILES_SETTING = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def open_files(spark: SparkSession, most: int = OPEN_FILES) -> Iterator[None]:
    """Partitioned writes in here do not sort a task's rows first: it keeps a file open for each partition it meets.

    A task that meets more than `most` partitions sorts the rest of its rows, as it otherwise would all of them.
    """
    before = spark.conf.get(_OPEN_FILES_SETTING)
    spark.conf.set(_OPEN_FILES_SETTING, most)
    try:
        yield
    finally:
        spark.conf.set(_OPEN_FILES_SETTING, before)


def stable(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written partitions.

    Rows keep their partition and order, also when a lost executor forces a re-read.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
