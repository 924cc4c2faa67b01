"""One named file per output, however many tasks write it.

Text: tasks write their rows of an output as pieces, in order, each under a name of its attempt. A table of the pieces
that finished attempts report says what belongs to an output. One task per output then streams its pieces into a file,
compares the bytes with the sum of the pieces, and moves the file to its name. Workbooks: a task streams a workbook into
one piece. So a task that is repeated leaves the same files, and a reader never sees half of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.charset import UTF8, UTF16BE, UTF16LE, encode_raw
from rowloom.functions.refs import path_folder
from rowloom.session import scratch_path
from rowloom.sinks.naming import free_names
from rowloom.sinks.text import LINE_END
from rowloom.sources.stores import reason, store_of, walk

PIECES = "key string, first bigint, uri string, bytes bigint"
PLACED = "key string, file string, bytes bigint, status string, message string"
COPY_BYTES = 1 << 22


def new_piece(folder: str) -> tuple[str, Any]:
    """A stream to a new file in ``folder`` that no other attempt writes, and its URI."""
    uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    system, place = store_of(uri)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return uri, system.open_output_stream(place)


def stored_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces of finished attempts, as a table in the shared folder."""
    target = scratch_path(pieces.sparkSession, "pieces")
    pieces.write.parquet(target)
    return pieces.sparkSession.read.schema(PIECES).parquet(target)


def text_pieces(lines: DataFrame, encoding: str = UTF8, line_end: str = LINE_END) -> DataFrame:
    """``(key, first, uri, bytes)`` of ``lines(key, row, line)``: the lines of each key in row order, in pieces.

    Range partitioning keeps the order over tasks, so that an output of any size is written by many of them.
    """
    folder = scratch_path(lines.sparkSession, "text")
    end = line_end.encode(encoding if encoding in (UTF16LE, UTF16BE) else UTF8)
    value = encode_raw(F.col("line"), encoding).cast("binary").alias("value")
    # Range partitioning goes over its rows twice, so that only what is dealt is encoded.
    dealt = lines.select("key", F.col("row").cast("bigint").alias("row"), "line").repartitionByRange("key", "row")
    ordered = dealt.sortWithinPartitions("key", "row").select("key", "row", value)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = out = None
        first = size = 0
        uri = ""

        def piece() -> pd.DataFrame:
            out.close()
            return pd.DataFrame({"key": [key], "first": [first], "uri": [uri], "bytes": [size]})

        for batch in batches:
            for name, group in batch.groupby("key", sort=False):
                if out is None or name != key:
                    if out is not None:
                        yield piece()
                    key, first, size = name, int(group["row"].iloc[0]), 0
                    uri, out = new_piece(folder)
                data = b"".join(bytes(v) + end for v in group["value"])
                out.write(data)
                size += len(data)
        if out is not None:
            yield piece()

    return stored_pieces(ordered.mapInPandas(write, PIECES))


def output_names(wanted: DataFrame, overwrite: bool, inputs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(key, file)`` for ``wanted(key, folder, base, extension)``: the full name of each output.

    Without ``overwrite`` a name that is taken in its folder gets the next free number. With it an older file is
    replaced, but neither one of ``inputs(path)`` nor another output of the same call. ``known(key, file)`` are names
    given before: those keys keep them, and no other key gets one.
    """
    wanted = wanted.select("key", F.concat("folder", "base").alias("base"), "extension")
    taken = inputs.select(F.col("path").alias("name"))
    if not overwrite:
        folders = wanted.select(path_folder(F.col("base")).alias("path")).distinct()
        listed = walk(folders.select(F.regexp_replace("path", "(?<=.)/$", "").alias("path"), F.array().cast("array<string>").alias("todo")))
        # a file that is there twice on the way to its name is one
        taken = taken.unionByName(listed.filter("message is null").select(F.col("path").alias("name")))
    if known is None:
        return free_names(wanted, taken, "key").select("key", F.col("name").alias("file"))
    taken = taken.unionByName(known.select(F.col("file").alias("name")))
    fresh = free_names(wanted.join(known.select("key"), "key", "left_anti"), taken, "key").select("key", F.col("name").alias("file"))
    return fresh.unionByName(known.join(wanted.select("key"), "key", "left_semi").select("key", "file"))


def place_outputs(names: DataFrame, pieces: DataFrame, overwrite: bool, mark: bytes = b"") -> DataFrame:
    """Assemble each output of ``names(key, file, own)`` from its ``pieces``, and move it there; a row per output.

    An output without pieces is an empty file. Without ``overwrite`` a file that is there with other content stays, and the
    output has failed, unless it is the batch's ``own``. ``mark`` comes first in each. What cannot be written is a failed row. The pieces of an
    output are at most as many as tasks have written it.
    """
    of_key = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "uri", "bytes"))).alias("pieces"))
    joined = names.join(of_key, "key", "left").select("key", "file", "own", F.to_json("pieces").alias("pieces"))

    def blocks(uris: list[str]) -> Iterator[bytes]:
        if mark:
            yield mark
        for uri in uris:
            system, place = store_of(uri)
            with system.open_input_stream(place) as piece:
                while data := piece.read(COPY_BYTES):
                    yield data

    def same(there: Any, uris: list[str]) -> bool:
        for data in blocks(uris):
            if there.read(len(data)) != data:
                return False
        return not there.read(1)

    def place_one(file: str, own: bool, uris: list[str], size: int) -> int:
        from pyarrow import fs

        system, final = store_of(file)
        if not (overwrite or own) and system.get_file_info(final).type != fs.FileType.NotFound:
            with system.open_input_stream(final) as there:
                if not same(there, uris):  # else a lost attempt of this task has written it
                    raise FileExistsError(file)
            return size
        system.create_dir(final.rsplit("/", 1)[0], recursive=True)
        part, written = f"{final}.{uuid.uuid4().hex}.part", 0
        with system.open_output_stream(part) as out:
            for data in blocks(uris):
                out.write(data)
                written += len(data)
        if written != size:
            system.delete_file(part)
            raise OSError(f"{written} bytes of {size}")
        system.move(part, final)
        return written

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows = []
            for key, file, own, listed in zip(*(batch[c] for c in ("key", "file", "own", "pieces"))):
                parts = json.loads(listed) if listed else []
                try:
                    size = place_one(file, own, [p["uri"] for p in parts], sum(p["bytes"] for p in parts) + len(mark))
                    rows.append((key, file, size, "ok", None))
                except Exception as problem:
                    rows.append((key, file, None, "failed", reason(problem)))
            out = pd.DataFrame(rows, columns=["key", "file", "bytes", "status", "message"])
            yield out.astype({"bytes": "Int64"})

    return joined.mapInPandas(place, PLACED)
