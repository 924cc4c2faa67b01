"""Texts as arrays of code points, for the numpy work inside tasks.

A batch of texts becomes one array with a line break before, between and after the texts, so that words,
n-grams and their hashes are found for all of them at once. The work is done in chunks of bounded size; a
text longer than a chunk is a chunk of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that are worked on at once: bounds the memory of a task.
CHUNK = 1 << 20
# Rows per Arrow batch: long texts must not pile up in one batch.
BATCH_ROWS = 512
# Fixed values of the mixing step: the odd multipliers of the SplitMix64 finalizer.
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
# Base of the rolling hash: any odd number.
BASE = 0x9E3779B97F4A7C15


def small_batches(spark: SparkSession) -> None:
    """Have Spark send texts to Python in small batches, unless the session asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    current = int(spark.conf.get(name) or 0)
    if current <= 0 or current > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def id_bucket(key: Column, n: int) -> Column:
    """CRC-32 of ``key`` as text, modulo ``n``; null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def text_slices(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive (first, end) slices of at most ``limit`` code points, or one longer text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_A)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of spans of a code point array, by a rolling hash modulo 2**64."""

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            for name, base in (("_powers", BASE), ("_inverses", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(points) + 1)
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self._powers[: len(points)], out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * self._inverses[starts])


class CodePoints:
    """The code points of some texts, with a line break before, between and after them."""

    def __init__(self, texts: list[str]) -> None:
        self.count = len(texts)
        joined = "\n" + "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        lengths = np.fromiter(map(len, texts), np.int64, self.count)
        self.starts = np.cumsum(lengths + 1) - lengths
        self.ends = self.starts + lengths

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text each position lies in."""
        return np.searchsorted(self.starts, positions, side="right") - 1

    def ascii_lower(self) -> np.ndarray:
        """The points with A-Z in lower case."""
        upper = (self.points >= 65) & (self.points <= 90)
        return np.where(upper, self.points + 32, self.points).astype(np.uint32)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the text of each."""
        solid = (self.points != 32) & ((self.points < 9) | (self.points > 13))
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        return starts, ends, self.owner(starts)
