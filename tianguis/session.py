"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which Catalyst may send a stored table to all tasks, whatever it guesses of its size.
SENT_ROWS = 100_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "tianguis", **conf: str) -> SparkSession:
    """Session with the settings the library relies on; sizes are left to the cluster and to AQE."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one the cluster names, or a scratch folder in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tianguis-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there, so lost executors lose nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder, for tables a job writes and reads back."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str = "filas", under: str | None = None) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder; smaller than a checkpoint, but its partitioning is lost.

    ``under`` names a folder of the caller's, which may be :func:`removed` when its tables have been used.
    """
    path = shared_path(df.sparkSession, purpose) if under is None else f"{under}/{purpose}-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Take away a folder of tables of this job that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def unsent(df: DataFrame) -> DataFrame:
    """``df``, never sent whole to the tasks if it has more than SENT_ROWS rows; it is counted, so it should be a stored table.

    Catalyst judges by the size of the files, and keys in compressed files are many times as large in the driver's memory.
    """
    return df.hint("merge") if df.count() > SENT_ROWS else df
