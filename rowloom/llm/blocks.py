"""Blocks of documents as numbered words, and exchanges of what blocks hold in common.

A block holds the words of some documents: its vocabulary with hashes, and one number per word. Blocks are written once, as files in
the shared folder, so that every later pass reads the same words without parsing a text again, and so that a repeated
task sees the same block. A block is bounded by the bytes of its texts; a longer text is a block of its own.

An exchange compares all blocks without pairing them. Every block sends what it holds, as 64-bit hashes with whatever
belongs to them, to buckets by the hash; a bucket meets everything that all blocks hold of its hashes, and answers each
block. A value that very many documents share is sent once per block. The number of buckets grows with the words, so
the memory of a bucket does not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.components import written
from rowloom.llm.files import locate, new_file
from rowloom.llm.text import map_batches
from rowloom.llm.words import Numbers, word_hashes
from rowloom.session import scratch_path

# Bytes of text in a block, and words in a bucket (one of each is what a task holds in memory).
BLOCK_BYTES = 1 << 23
BUCKET_WORDS = 1 << 21
# Asks and answers read by one task at a time.
ROWS = 64

MANIFEST = "uri string, units bigint, words bigint"
ANSWERS = "uri string, round int, bucket int, blob binary"


class Block:
    """Units (texts or pieces of texts) of words: ``ids`` are the words' places in ``vocabulary``, ``ends`` the ends of the
    units in ``ids``, ``of`` the place of each unit's tag in ``tags``. Strings are made only when they are asked for."""

    FIELDS = {"vocabulary": pa.binary(), "hashes": pa.uint64(), "ids": pa.int32(), "ends": pa.int64(), "tags": pa.string(),
              "of": pa.int32()}

    def __init__(self, vocabulary: pa.Array, ids: np.ndarray, ends: np.ndarray, tags: list, of: np.ndarray,
                 hashes: np.ndarray | None = None) -> None:
        self.vocabulary, self.ids, self.ends, self.tags, self.of = vocabulary, ids, ends, tags, of
        self.hashes = word_hashes(self.words) if hashes is None else hashes

    @cached_property
    def words(self) -> list[bytes]:
        return self.vocabulary.to_pylist()

    @cached_property
    def unit(self) -> np.ndarray:
        """The unit of each word."""
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))


def save_block(folder: str, block: Block) -> str:
    table = pa.table({name: pa.array([getattr(block, name)], pa.list_(kind)) if name not in ("vocabulary", "tags")
                      else _one_list(getattr(block, name), kind) for name, kind in Block.FIELDS.items()})
    uri, stream = new_file(folder, "block")
    with stream, pa.ipc.new_stream(stream, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return uri


def _one_list(values: pa.Array | list, kind: pa.DataType) -> pa.Array:
    values = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def load_block(uri: str) -> Block:
    system, path = locate(uri)
    with system.open_input_stream(path) as stream:
        table = pa.ipc.open_stream(stream).read_all()
    got = {name: table.column(name).chunk(0).values for name in Block.FIELDS}
    numbers = {name: got[name].to_numpy() for name in ("hashes", "ids", "ends", "of")}
    return Block(got["vocabulary"], numbers["ids"], numbers["ends"], got["tags"].to_pylist(), numbers["of"], numbers["hashes"])


# Units of one text: lists of words, each with a tag.
Parse = Callable[[bytes], list[list[bytes]]]


def write_blocks(texts: DataFrame, parse: Parse, name: str) -> DataFrame:
    """The texts of ``(tag string, text binary)`` as blocks of numbered words: a manifest of their files."""
    folder = scratch_path(texts.sparkSession, name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, ends, tags, of, size, at = Numbers(), [], [], {}, [], 0, 0

        def block() -> pa.RecordBatch:
            vocabulary = pa.array(list(numbers), pa.binary())
            uri = save_block(folder, Block(vocabulary, np.concatenate(ids), np.array(ends, np.int64), list(tags), np.array(of, np.int32)))
            return pa.RecordBatch.from_pydict({"uri": [uri], "units": [len(ends)], "words": [at]})

        for batch in batches:
            for tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or b""
                if size and size + len(text) > BLOCK_BYTES:
                    yield block()
                    numbers, ids, ends, tags, of, size, at = Numbers(), [], [], {}, [], 0, 0
                size += len(text) + 1
                units = parse(text)
                ids.append(numbers([w for words in units for w in words]))
                place = tags.setdefault(tag, len(tags))
                for words in units:
                    at += len(words)
                    ends.append(at)
                    of.append(place)
        if size:
            yield block()

    return written(map_batches(texts.select("tag", "text"), work, MANIFEST), name)


def bucket_count(manifest: DataFrame) -> int:
    total = manifest.agg(F.sum("words")).first()[0] or 0
    return max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4, math.ceil(total / BUCKET_WORDS))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; it rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def bucket_slices(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Every bucket that occurs in rising hashes, and its slice of them."""
    at = bucket_of(sorted_hashes, buckets)
    firsts = np.flatnonzero(np.diff(at, prepend=-1))
    for first, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(at)]):
        yield int(at[first]), slice(first, end)


def small_rows(spark: SparkSession) -> None:
    """Blobs are large: few of them at a time reach a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def per_block(manifest: DataFrame, answers: DataFrame | None, work: Callable[[Block, dict], Iterator[pa.RecordBatch]],
              schema: str, keep_uri: bool = False) -> DataFrame:
    """``work(block, {round: {bucket: answer}})`` for every block, with the answers that it got."""
    rows = manifest.select("uri", F.lit(-1).alias("round"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("blob"))
    tasks = 4 * manifest.sparkSession.sparkContext.defaultParallelism
    if answers is None:
        dealt = rows.repartition(tasks)
    else:
        dealt = rows.unionByName(answers).repartition(tasks, "uri").sortWithinPartitions("uri", "round", "bucket")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, got = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for out in work(load_block(uri), got) if uri is not None else ():
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(out)), *out.columns], names=["uri", *out.schema.names]) if keep_uri else out

        for batch in batches:
            for row in batch.to_pylist():
                if row["uri"] != uri:
                    yield from done()
                    uri, got = row["uri"], {}
                if row["bucket"] >= 0:
                    got.setdefault(row["round"], {})[row["bucket"]] = row["blob"]
        yield from done()

    small_rows(manifest.sparkSession)
    return dealt.mapInArrow(blocks, f"uri string, {schema}" if keep_uri else schema)


def exchange(manifest: DataFrame, answers: DataFrame | None, number: int, buckets: int,
             ask: Callable[[Block, dict], Iterator[tuple[int, bytes]]],
             answer: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """One round: each block asks buckets, each bucket answers its asks; the answers of all rounds so far."""

    def asks(block: Block, got: dict) -> Iterator[pa.RecordBatch]:
        for bucket, blob in ask(block, got):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "blob": pa.array([blob], pa.binary())})

    def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        rows.sort(key=lambda row: row["uri"])
        blobs = [row.pop("blob") for row in rows]
        for row, blob in zip(rows, answer(blobs) if rows else []):
            if blob is not None:
                yield pa.RecordBatch.from_pydict({
                    "uri": [row["uri"]], "round": pa.array([number], pa.int32()),
                    "bucket": pa.array([row["bucket"]], pa.int32()), "blob": pa.array([blob], pa.binary())})

    asked = per_block(manifest, answers, asks, "bucket int, blob binary", keep_uri=True)
    dealt = asked.repartitionById(buckets, F.col("bucket"))
    got = written(dealt.mapInArrow(replies, ANSWERS), f"round-{number}")
    return got if answers is None else answers.unionByName(got)
