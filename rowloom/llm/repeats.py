"""Substring dedup: spans of words that occur in an earlier document too, by relative Lempel-Ziv parsing.

A window is ``WORDS`` consecutive words of one document. Every word that lies in a window whose words also stand in a
document with a smaller id is removed; windows are judged on the input.

Every document is factored against the reference text of all earlier documents. That text is cut by content, so that a
document meets only those reference blocks that can hold one of its windows: the anchor of a window is the smallest hash
of ``GRAM`` words in it, equal windows have equal anchors, and a bucket holds the stretches around its anchors of all
documents (see ``blocks.py``). Two exchanges do it:

1. Anchors. Blocks send their different anchors; those of one document alone end here, with all their windows.
2. Stretches. Blocks send the text of each different stretch of windows with one shared anchor, with the smallest
   document that holds it (any later document of the block repeats all of it). A bucket is a reference block: its windows
   are indexed by hash, each with the earliest document that holds it, and checked word by word. Each stretch is factored
   greedily: at a position that the index knows from an earlier document the factor follows that document as far as the
   words agree, and its windows are duplicates; windows across the end of a factor belong to no factor and are looked up
   themselves, as are positions where no factor starts.

A task holds one block of documents or one bucket. A passage that very many documents share is one stretch per block.

Defined results: documents are compared by id. Rows of one id are one document here: they do not make each other
duplicates. A row without an id is left whole and no reference for others. A null or empty text has no words; a text of
fewer words than a window keeps all. An empty table gives no rows. A text longer than a block is a block of its own.
Columns other than id and text are ignored, whatever their names; the id must be a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.blocks import Block, bucket_count, bucket_slices, exchange, per_block, write_blocks
from rowloom.llm.text import BASE, SpanHasher, mix
from rowloom.llm.words import Numbers, number_hashes, ranges, sliding_min

# Words of a window, and of the grams whose smallest hash is the anchor of a window.
WORDS, GRAM = 13, 3
# Windows of a stretch at most; their duplicates are the bits of a number.
STRETCH = 11

SCHEMA = "key bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, length: bigint>>, kept string"


class Windows(NamedTuple):
    """The windows of a block that lie in one document with an id: their first word, anchor, and document."""

    hashes: np.ndarray
    first: np.ndarray
    anchors: np.ndarray
    documents: np.ndarray


def _windows(block: Block, words: int) -> Windows:
    hashes = block.hashes[block.ids]
    n = len(hashes) - words + 1
    if n <= 0:
        return Windows(hashes, *[np.zeros(0, t) for t in (np.int64, np.uint64, np.int64)])
    grams = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams = grams * np.uint64(BASE) + hashes[i : len(grams) + i]
    # minima are small numbers; mixed anew they spread over all buckets
    anchors = mix(sliding_min(mix(grams), words - GRAM + 1) ^ np.uint64(BASE))
    unit = block.unit
    named = np.array([tag is not None for tag in block.tags])[block.of]
    ids = np.array([int(tag) if tag is not None else 0 for tag in block.tags], np.int64)[block.of]
    first = np.flatnonzero((unit[:n] == unit[words - 1 :]) & named[unit[:n]])
    return Windows(hashes, first, anchors[first], ids[unit[first]])


class Anchors(NamedTuple):
    """The different anchors of a block in rising order, which of them more than one document has, and each window's."""

    values: np.ndarray
    several: np.ndarray
    of: np.ndarray


def _anchors(windows: Windows) -> Anchors:
    values, of = np.unique(windows.anchors, return_inverse=True)
    low = np.full(len(values), np.iinfo(np.int64).max)
    high = np.full(len(values), np.iinfo(np.int64).min)
    np.minimum.at(low, of, windows.documents)
    np.maximum.at(high, of, windows.documents)
    return Anchors(values, low < high, of)


def _shared_anchors(blobs: list[bytes]) -> list[bytes]:
    """Which anchors of each block occur in more than one block, or in two documents of one."""
    values, several = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        values.append(np.frombuffer(blob, np.uint64, n, 8))
        several.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=8 + 8 * n), count=n).astype(bool))
    all_values, inverse, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[inverse[np.concatenate(several)]] = True
    ends = np.cumsum([len(v) for v in values])
    return [np.packbits(part).tobytes() for part in np.split(shared[inverse], ends[:-1])]


class Stretches(NamedTuple):
    """Stretches of windows with one shared anchor: all of a block, and the different ones among them.

    ``starts`` and ``counts`` are the first word and the number of windows of each stretch; ``of`` its place among the
    different ones, whose earliest stretch is ``first``; those are in rising order of ``anchors``.
    """

    starts: np.ndarray
    counts: np.ndarray
    documents: np.ndarray
    of: np.ndarray
    first: np.ndarray
    anchors: np.ndarray


def _stretches(block: Block, windows: Windows, shared: np.ndarray, words: int) -> Stretches:
    kept = np.flatnonzero(shared)
    first, anchors, documents = windows.first[kept], windows.anchors[kept], windows.documents[kept]
    if not len(kept):
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none, none, anchors)
    follows = (np.diff(first, prepend=-2) == 1) & (np.diff(anchors, prepend=np.uint64(0)) == 0)
    runs = np.flatnonzero(~follows)
    place = np.arange(len(first)) - np.repeat(runs, np.diff([*runs, len(first)]))
    begins = np.flatnonzero(place % STRETCH == 0)
    starts, counts = first[begins], np.diff([*begins, len(first)])
    anchors, documents = anchors[begins], documents[begins]
    spans = SpanHasher()(windows.hashes, starts, starts + counts + words - 1)
    order = np.lexsort((starts, documents, counts, spans, anchors))
    same = np.ones(len(order), bool)
    for values in (anchors, spans, counts):
        same[1:] &= values[order][1:] == values[order][:-1]
    same[0] = False
    # equal hashes are taken for equal words only after a look at the words
    leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    for i in range(words - 1 + STRETCH):
        inside = same & (i < counts[order] + words - 1)
        at, other = starts[order][inside] + i, starts[order[leader]][inside] + i
        same[np.flatnonzero(inside)[block.ids[at] != block.ids[other]]] = False
    leaders = np.flatnonzero(~same)
    of = np.empty(len(order), np.int64)
    of[order] = np.searchsorted(leaders, np.where(same, leader, np.arange(len(order))))
    return Stretches(starts, counts, documents, of, order[leaders], anchors[order[leaders]])


def _text(block: Block, stretches: Stretches, part: slice, words: int) -> bytes:
    """The earliest documents, window counts and words of some different stretches."""
    first = stretches.first[part]
    sizes = stretches.counts[first] + words - 1
    flat = block.ids[ranges(stretches.starts[first], sizes)]
    text = b" ".join(map(block.words.__getitem__, flat.tolist()))
    packed = zstandard.ZstdCompressor(level=1).compress(text)
    return (len(first).to_bytes(8, "little") + stretches.documents[first].astype("<i8").tobytes()
            + stretches.counts[first].astype(np.uint8).tobytes() + packed)


def _factored(blobs: list[bytes], words: int) -> list[bytes | None]:
    """Factor the stretches of all blocks against each other; the duplicate windows of each stretch, as bits."""
    numbers, documents, counts, ids, sizes = Numbers(), [], [], [], []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        sizes.append(n)
        documents.append(np.frombuffer(blob, "<i8", n, 8))
        counts.append(np.frombuffer(blob, np.uint8, n, 8 + 8 * n).astype(np.int64))
        ids.append(numbers(zstandard.ZstdDecompressor().decompress(blob[8 + 9 * n :]).split()))
    bits = factor(np.concatenate(ids), np.concatenate(documents), np.concatenate(counts), words)
    return [part.astype("<u2").tobytes() if part.any() else None for part in np.split(bits, np.cumsum(sizes)[:-1])]


def _sources(ids: np.ndarray, at: np.ndarray, documents: np.ndarray, words: int) -> np.ndarray:
    """For each window (of rising words ``at``) the window with the same words in the earliest document."""
    hashes = SpanHasher()(number_hashes(ids), at, at + words)
    source = np.arange(len(at))
    open_ = np.arange(len(at))
    while len(open_):
        order = open_[np.lexsort((open_, documents[open_], hashes[open_]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = hashes[order][1:] != hashes[order][:-1]
        leader = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        equal = np.ones(len(order), bool)
        for i in range(words):
            equal &= ids[at[order] + i] == ids[at[leader] + i]
        source[order[equal]] = leader[equal]
        open_ = order[~equal]  # other words of the same hash look for a leader among themselves
    return source


def factor(ids: np.ndarray, documents: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """Greedy factors of stretches against those of earlier documents, as the bits of their duplicate windows.

    ``ids`` are the words of all stretches one after another, ``counts`` their numbers of windows, ``documents`` theirs.
    """
    lengths = counts + words - 1
    starts = np.cumsum(lengths) - lengths
    at = ranges(starts, counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    source = _sources(ids, at, documents[owner], words)
    known = documents[owner[source]] < documents[owner]
    window = np.cumsum(counts) - counts  # the first window of each stretch
    ends = starts + lengths
    bits = np.zeros(len(counts), np.int64)
    cursor, live = np.zeros(len(counts), np.int64), np.arange(len(counts))
    while len(live):
        here = window[live] + cursor[live]
        hit = known[here]
        cursor[live[~hit]] += 1  # no factor starts here
        who, here = live[hit], here[hit]
        own, other = at[here] + words, at[source[here]] + words
        limit = np.minimum(ends[who] - own, ends[owner[source[here]]] - other)
        more, going = np.zeros(len(who), np.int64), np.arange(len(who))
        while len(going):  # the factor follows its source as far as the words agree
            going = going[more[going] < limit[going]]
            going = going[ids[own[going] + more[going]] == ids[other[going] + more[going]]]
            more[going] += 1
        bits[who] |= ((1 << (more + 1)) - 1) << cursor[who]
        cursor[who] += more + 1  # the first window across the end of the factor
        live = live[cursor[live] < counts[live]]
    return bits


def _joined(answers: dict[int, bytes], n: int, anchors: np.ndarray, buckets: int) -> np.ndarray:
    """The bits that buckets gave for rising anchors."""
    bits = np.zeros(n, bool)
    for bucket, part in bucket_slices(anchors, buckets):
        bits[part] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=part.stop - part.start)
    return bits


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(key, n_words, n_removed, spans, kept)`` for every row: removed spans of words, and the other words."""
    if words < GRAM:
        raise ValueError(f"a window needs at least {GRAM} words")
    rows = df.select(F.col(key).cast("bigint").cast("string").alias("tag"), F.col(text).cast("binary").alias("text"))
    manifest = write_blocks(rows, lambda t: [t.split()], "documents")
    buckets = bucket_count(manifest)

    def ask_anchors(block: Block, got: dict) -> Iterator[tuple[int, bytes]]:
        found = _anchors(_windows(block, words))
        for bucket, part in bucket_slices(found.values, buckets):
            n = part.stop - part.start
            yield bucket, n.to_bytes(8, "little") + found.values[part].tobytes() + np.packbits(found.several[part]).tobytes()

    def stretches(block: Block, got: dict) -> Stretches:
        windows = _windows(block, words)
        found = _anchors(windows)
        shared = _joined(got.get(1, {}), len(found.values), found.values, buckets)
        return _stretches(block, windows, shared[found.of], words)

    def ask_stretches(block: Block, got: dict) -> Iterator[tuple[int, bytes]]:
        found = stretches(block, got)
        for bucket, part in bucket_slices(found.anchors, buckets):
            yield bucket, _text(block, found, part, words)

    def result(block: Block, got: dict) -> Iterator[pa.RecordBatch]:
        found = stretches(block, got)
        bits = np.zeros(len(found.first), np.int64)
        for bucket, part in bucket_slices(found.anchors, buckets):
            if bucket in got.get(2, {}):
                bits[part] = np.frombuffer(got[2][bucket], "<u2")
        # a later document of the block repeats its stretch from the earliest one there
        late = found.documents > found.documents[found.first][found.of]
        bits = np.where(late, (1 << found.counts) - 1, bits[found.of])
        cover = np.zeros(len(block.ids) + 1, np.int64)
        for i in range(STRETCH):
            twice = found.starts[(bits >> i & 1) == 1] + i
            cover += np.bincount(twice, minlength=len(cover)) - np.bincount(twice + words, minlength=len(cover))
        yield from _results(block, np.cumsum(cover)[:-1] > 0)

    answers = exchange(manifest, None, 1, buckets, ask_anchors, _shared_anchors)
    answers = exchange(manifest, answers, 2, buckets, ask_stretches, lambda blobs: _factored(blobs, words))
    return per_block(manifest, answers, result, SCHEMA)


def _results(block: Block, removed: np.ndarray, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A row per document, few at a time."""
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    ends = block.ends.tolist()
    starts = [0, *ends[:-1]]
    for low in range(0, len(ends), rows):
        out: list[tuple] = []
        tags = [block.tags[i] for i in block.of[low : low + rows].tolist()]
        for start, end, tag in zip(starts[low : low + rows], ends[low : low + rows], tags):
            gone = removed[start:end]
            ids = block.ids[start:end]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))) if gone.any() else np.zeros(0, np.int64)
            spans = [{"start": s, "length": e - s} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
            left = ids[~gone] if spans else ids
            kept = b" ".join(map(block.words.__getitem__, left.tolist()))
            out.append((None if tag is None else int(tag), len(ids), len(ids) - len(left), spans, kept))
        keys, n, n_removed, spans, kept = zip(*out)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(spans, pa.list_(struct)), pa.array(kept, pa.binary()).cast(pa.string()),
        ], names=["key", "n_words", "n_removed", "spans", "kept"])
