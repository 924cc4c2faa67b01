"""Small helpers around the Spark session: the shared folder and what is removed from it, lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it is known to be at most this large.
BROADCAST_BYTES = 256 * 1024 * 1024

# Fixed value: has shuffle files removed when what made them has been executed.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# The folder of the innermost scratch_folder.
_FOLDER: ContextVar[str | None] = ContextVar("rowloom_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; a cluster session
    without it is an error, since a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="rowloom-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below the :func:`scratch_folder` that is open."""
    folder = _FOLDER.get() or f"{shared_dir(spark).rstrip('/')}/rowloom"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[None]:
    """All scratch paths made in the block are removed at its end, and shuffle files as soon as nothing reads them.

    What is to be read later must be computed in the block, by :func:`materialize` or to a path made outside.
    """
    folder = scratch_path(spark, name)
    outer = _FOLDER.set(folder)
    try:
        with short_shuffles(spark):
            yield
    finally:
        _FOLDER.reset(outer)
        remove(spark, folder)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what the block executes are removed after it, not when the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder with all below it, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage (reliable checkpoint, survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialized ``df`` for broadcast if its measured size allows it.

    Beyond the bound ``df`` comes back unmarked and Spark shuffles the join instead.
    """
    if is_small(df, max_bytes):
        return F.broadcast(df)
    return df


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a materialized ``df``: the text length of its rows plus a fixed part per row."""
    widths = [F.octet_length(F.to_json(F.struct(*df.columns)))]
    size = df.select(F.sum(sum(widths) + F.lit(64)).alias("b")).first()["b"]
    return (size or 0) <= max_bytes
