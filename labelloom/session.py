"""Session helpers: local test sessions and the shared folder for durable intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "12g", name: str = "labelloom") -> SparkSession:
    """Session for tests and the bench; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def durable_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates that outlive an executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and
    executors share one disk, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="labelloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages restart from files, not from the whole history."""
    durable_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Actions in here send Python workers batches of about ``most`` bytes; a longer row is a batch of its own.

    A batch is held by the JVM, outside its heap, and by the worker, once per task each.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def work_path(spark: SparkSession, name: str) -> str:
    """Fresh path for an intermediate table inside the durable folder."""
    return os.path.join(durable_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
