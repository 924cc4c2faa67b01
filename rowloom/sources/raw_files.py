"""Text files read by path in tasks: small ones whole, large ones as byte ranges, each line once.

What both give is raw: bytes in a text column for charsets of one byte per character and for UTF-8, text already for
UTF-16, which is known by its byte order mark. A mark is taken off and reported. A file that cannot be read is a row
with a message.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.charset import UTF8, UTF16BE, UTF16LE
from rowloom.sources.stores import reason, store_of

# Bytes of a file that one task reads as a piece; even, so that characters of two bytes are not cut.
RANGE_BYTES = 16 * 1024 * 1024
# Bytes of small files that are one task's work, and of rows handed on at once.
TASK_BYTES = 64 * 1024 * 1024
BATCH_BYTES = 1 << 20
LOOK_BYTES = 1 << 16

# Byte order marks.
MARKS = {b"\xef\xbb\xbf": UTF8, b"\xff\xfe": UTF16LE, b"\xfe\xff": UTF16BE}
WHOLE = "path string, raw binary, mark string, message string"
LINES = "path string, block bigint, seq bigint, raw binary, mark string, message string"


def mark_of(start: bytes) -> tuple[str | None, int]:
    """The charset that a byte order mark names, and the bytes of the mark."""
    for mark, charset in MARKS.items():
        if start.startswith(mark):
            return charset, len(mark)
    return None, 0


def _as_raw(data: bytes, mark: str | None) -> bytes:
    """Bytes of UTF-16 as UTF-8, all others as they are."""
    return data.decode(mark, "replace").encode() if mark in (UTF16LE, UTF16BE) else data


def _lines(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lines that end at CR, LF or CRLF, one after the other without their ends, and where each starts.

    The places have one more, the end of the last line. As ``bytes.splitlines`` cuts, without an object per line.
    """
    points = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero((points == 10) | (points == 13))
    second = np.zeros(len(breaks), bool)  # an LF right behind a CR ends no line of its own
    second[1:] = (points[breaks[1:]] == 10) & (points[breaks[:-1]] == 13) & (np.diff(breaks) == 1)
    ends = (breaks - np.arange(len(breaks)))[~second]
    if len(points) and not (len(breaks) and breaks[-1] == len(points) - 1):
        ends = np.append(ends, len(points) - len(breaks))
    return np.delete(points, breaks), np.append(0, ends)


def _first_line(data: bytes, mark: str | None, at: int) -> int | None:
    """The first place from ``at`` on where a line starts, in bytes read from one unit before ``at``; None: not here."""
    unit = 2 if mark in (UTF16LE, UTF16BE) else 1
    ends = {UTF16LE: b"(?s)(?:..)*?(\r\x00\n\x00|\r\x00|\n\x00)", UTF16BE: b"(?s)(?:..)*?(\x00\r\x00\n|\x00\r|\x00\n)"}.get(
        mark, b"(?s).*?(\r\n|\r|\n)")
    found = re.match(ends, data)
    if found is None:
        return None
    return at - unit + found.end(1)


class _Range:
    """The lines that start in one range of a file."""

    def __init__(self, file, start: int, end: int) -> None:
        self.file, self.start, self.end, self.size = file, start, end, file.size()
        self.mark, self.skip = mark_of(file.read_at(min(3, self.size), 0))
        self.unit = 2 if self.mark in (UTF16LE, UTF16BE) else 1

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        return self.file.read_at(n, at) if n > 0 else b""

    def line_start(self, at: int) -> int:
        """The first place from ``at`` on where a line starts; the size of the file if there is none."""
        if at <= self.skip:
            return self.skip
        at += at % self.unit
        n = LOOK_BYTES
        while True:
            data = self.read(at - self.unit, n)
            place = _first_line(data, self.mark, at)
            cut = at - self.unit + len(data) < self.size
            # a CR at the very end of what was read may have its LF behind it
            if place is not None and not (cut and place == at - self.unit + len(data)):
                return place
            if not cut:
                return self.size if place is None else place
            n *= 4

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        first = self.line_start(self.start)
        last = self.size if self.end >= self.size else self.line_start(self.end)
        return _lines(_as_raw(self.read(first, last - first), self.mark) if first < last else b"")


def _dealt(files: DataFrame, size: Column) -> DataFrame:
    """Rows of a materialized listing spread over tasks of bounded work."""
    total = files.agg(F.sum(size), F.count(F.lit(1))).first()
    tasks = max((total[0] or 0) // TASK_BYTES, min(total[1], files.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(int(max(1, tasks)))


def whole_files(files: DataFrame) -> DataFrame:
    """``(path, raw, mark, message)`` of ``files(path, length)``, each read whole."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    system, place = store_of(path)
                    with system.open_input_stream(place) as there:
                        data = there.read()
                    mark, skip = mark_of(data[:3])
                    rows.append((path, _as_raw(data[skip:], mark), mark, None))
                    size += len(data)
                except Exception as problem:  # one row, not a failed job
                    rows.append((path, None, None, reason(problem)))
                if size >= BATCH_BYTES or len(rows) >= 1000:
                    yield _batch(rows, WHOLE)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, WHOLE)

    return _dealt(files.select("path", "length"), F.col("length") + 4096).mapInArrow(read, WHOLE)


def line_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, block, seq, raw, mark, message)``: the lines of ``files(path, length)``, by byte ranges.

    A line belongs to the range (``block``, its first byte) in which it starts, and ``seq`` counts the lines of a range
    from 0, so that block and seq are the order of the lines.
    """
    step = range_bytes - range_bytes % 2
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step).cast("bigint"))
    ranges = files.filter("length > 0").select("path", F.explode(starts).alias("block"), F.lit(step).alias("length"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    system, place = store_of(path)
                    with system.open_input_file(place) as there:
                        part = _Range(there, block, block + step)
                        data, places = part.lines()
                except Exception as problem:
                    yield _batch([(path, block, None, None, None, reason(problem))], LINES)
                    continue
                sizes = places + 64 * np.arange(len(places))
                first = 0
                while first < len(places) - 1:
                    end = min(int(np.searchsorted(sizes, sizes[first] + BATCH_BYTES)), len(places) - 1)
                    yield _line_batch(path, block, first, data, places[first : end + 1], part.mark)
                    first = end

    return _dealt(ranges, F.col("length")).select("path", "block").mapInArrow(read, LINES)


def _line_batch(path: str, block: int, first: int, data: np.ndarray, places: np.ndarray, mark: str | None) -> pa.RecordBatch:
    """Lines of a range from the ``first`` on, as :data:`LINES`."""
    n = len(places) - 1
    offsets = pa.py_buffer((places - places[0]).astype(np.int32))
    raw = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(data[places[0] : places[-1]])])
    text = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (path, mark, None)]
    return pa.RecordBatch.from_arrays(
        [text[0], pa.array(np.full(n, block)), pa.array(np.arange(first, first + n)), raw, text[1], text[2]],
        names=[x.split()[0] for x in LINES.split(", ")],
    )


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, _ARROW[kind]) for values, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields]
    )
