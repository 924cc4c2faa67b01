"""A drop folder: files are converted when they have arrived whole, each once, failures kept as rows.

The folder is listed at every tick, hidden and empty files included. The state of the query keeps size and time stamp of
every path; a file settles when both have not changed for a while, and is handed on once, also across restarts.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from rowloom.functions.refs import path_extension
from rowloom.plans.convert import Options, convert_batch
from rowloom.session import materialize
from rowloom.sources.stores import qualified, store_of

# Seconds a file must not have changed, time between listings, days after which a file that has gone is
# forgotten, and file types watched.
SETTLE = 2.0
TICK = "1 second"
FORGET_DAYS = 7
WATCHED_TYPES = (".csv", ".txt", ".xlsx")

SEEN = "path string, length bigint, modified timestamp, seen bigint"


class FolderListing(DataSource):
    """A stream of what a folder holds at each tick: ``(path, length, modified, seen)``, ``seen`` in milliseconds."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SEEN

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return FolderReader(self.options["path"])


class FolderReader(DataSourceStreamReader):
    """Each tick is an offset; the folder is listed by a task, not by the driver."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(end["tick"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, place = store_of(self.folder)
        seen = int(time.time() * 1000)
        for entry in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if entry.type == fs.FileType.File:
                modified = entry.mtime
                yield f"{self.folder.rstrip('/')}/{entry.base_name}", entry.size, modified and modified.replace(tzinfo=None), seen


def arriving_files(spark: SparkSession, folder: str, since: str | None = None, settle: float = SETTLE) -> DataFrame:
    """Stream of ``(path, length, modified)`` of the supported files in ``folder``, each once when it has settled.

    A file settles when its size and time stamp have been the same for ``settle`` seconds of listings; with 0, when it is
    first seen. A file that goes before is never handed on. The content is not read here. ``since`` leaves out files
    modified before that time.
    """
    spark.dataSource.register(FolderListing)
    listed = spark.readStream.format("folder_listing").load(qualified(spark, folder))
    wanted = listed.filter(path_extension(F.col("path")).isin(*WATCHED_TYPES))
    if since is not None:
        wanted = wanted.filter(F.col("modified") >= F.lit(since).cast("timestamp"))

    def settled(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # gone for long: a file of that name would be a new one
            state.remove()
            return
        rows = pd.concat(list(batches))
        last = rows.loc[rows["seen"].idxmax()]
        now, length, modified = int(last["seen"]), int(last["length"]), last["modified"]
        stamp = 0 if pd.isna(modified) else int(pd.Timestamp(modified).value)
        was_length, was_stamp, start, done = state.get if state.exists else (None, None, now, False)
        if not done and (was_length, was_stamp) != (length, stamp):
            start = now
        ready = not done and now - start >= settle * 1000
        state.update((length, stamp, start, done or ready))
        state.setTimeoutDuration(FORGET_DAYS * 86_400_000)
        if ready:
            yield pd.DataFrame({"path": [key[0]], "length": [length], "modified": [modified]})

    return wanted.groupBy("path").applyInPandasWithState(
        settled, "path string, length bigint, modified timestamp",
        "length bigint, stamp bigint, start bigint, done boolean", "append", "ProcessingTimeTimeout",
    )


def watch_folder(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    options: Options = Options(),
    since: str | None = None,
    settle: float = SETTLE,
    available_now: bool = False,
) -> StreamingQuery:
    """Start converting files dropped in ``folder`` to tables below ``target``, and to files if ``options`` ask for them.

    Each micro-batch runs the batch conversion on its files and writes under its own
    ``batch_id``; a batch repeated after a failure replaces what it wrote before. With ``available_now`` the files that
    are there are taken as settled, and the query ends after them.
    """

    def convert(batch: DataFrame, batch_id: int) -> None:
        files = materialize(batch.select(
            "path", path_extension(F.col("path")).alias("extension"), "length", "modified", F.lit(None).cast("string").alias("message")))
        if not files.isEmpty():
            convert_batch(batch.sparkSession, files, target, options, batch_id, overwrite=True)

    writer = (
        arriving_files(spark, folder, since, 0 if available_now else settle).writeStream
        .foreachBatch(convert).option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TICK)
    return writer.start()
