"""Periodic runs in texts: stretches of words that repeat with a period, and the texts with each run cut to one period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
``max(6, 4 * q)`` that no neighbouring word extends keeping period q. All words are compared exactly.

Method: periods below ``LAGS`` come from direct scans, one per period, over all texts of a chunk at once. For longer ones
there is a scale per doubling of the period. The scale of periods ``low <= q < 2 * low`` looks at spans of ``2 * low``
words and keeps the position of the smallest hash in every ``low + 1`` consecutive spans (minimizers). Such a window and
the one q words further both fit in a run of four periods and hold the same words, so their minima lie q words apart;
and as a span is longer than q, no equal span lies between them. So every run shows as two consecutive equal minimizers
at the distance of its period. Each such pair is extended word by word in both directions, which gives the run.

Tasks work on whole texts in chunks of bounded size; a longer text is a chunk of its own. Nothing is shuffled.

Defined results: a null or empty text has no words, no runs and an empty collapsed text. Rows are independent: repeated
rows and null keys each give their own row. Ties between periods of one stretch go to the smallest period. An empty table
gives no rows. Columns other than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.text import CHUNK, SpanHasher, map_batches
from rowloom.llm.words import Numbers, number_hashes, sliding_argmin

# Periods below this are scanned one by one; at least 2.
LAGS = 8
# A run holds at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN = "struct<start: bigint, length: bigint, period: bigint>"
SCHEMA = f"key bigint, n_words bigint, runs array<{RUN}>, longest {RUN}, collapsed string"


def _lag_runs(ids: np.ndarray, unit: np.ndarray, q: int) -> Iterator[tuple[int, int, int]]:
    same = np.zeros(len(ids) - q + 2, np.int8)
    same[1:-1] = (ids[:-q] == ids[q:]) & (unit[:-q] == unit[q:])
    edges = np.flatnonzero(np.diff(same))
    starts, lengths = edges[::2], edges[1::2] - edges[::2] + q
    enough = lengths >= max(LEAST_WORDS, LEAST_PERIODS * q)
    yield from ((s, n, q) for s, n in zip(starts[enough].tolist(), lengths[enough].tolist()))


def _reach(ids: np.ndarray, at: int, q: int, low: int, high: int, step: int) -> int:
    """The last position from ``at`` in the direction of ``step`` at which words q apart are equal, within low..high."""
    size = 64
    while True:
        if step > 0:
            end = min(high, at + size)
            differ = np.flatnonzero(ids[at:end] != ids[at + q : end + q])
            if len(differ):
                return at + int(differ[0])
            if end == high:
                return high
            at = end
        else:
            first = max(low, at - size)
            differ = np.flatnonzero(ids[first:at] != ids[first + q : at + q])
            if len(differ):
                return first + int(differ[-1]) + 1
            if first == low:
                return low
            at = first
        size *= 2


def _scale_runs(ids: np.ndarray, unit: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: SpanHasher,
                hashes: np.ndarray, low: int) -> Iterator[tuple[int, int, int]]:
    """Runs with a period of ``low`` to ``2 * low - 1`` words, from equal minimizers."""
    width, window = 2 * low, low + 1
    n = len(ids) - width + 1
    if n < window:
        return
    at = np.arange(n)
    grams = spans(hashes, at, at + width)
    first = np.arange(n - window + 1)
    whole = unit[first] == unit[first + window + width - 2]
    chosen = np.unique(sliding_argmin(grams, window)[whole])
    if not len(chosen):
        return
    order = np.lexsort((chosen, grams[chosen], unit[chosen]))
    places = chosen[order]
    distance = np.diff(places)
    pair = (grams[places[1:]] == grams[places[:-1]]) & (unit[places[1:]] == unit[places[:-1]])
    pair &= (distance >= low) & (distance < 2 * low)
    seeds, periods = places[:-1][pair], distance[pair]
    order = np.lexsort((seeds, periods))
    done, last = -1, -1
    for p, q in zip(seeds[order].tolist(), periods[order].tolist()):
        if q == last and p < done:
            continue  # inside the stretch found before
        owner = unit[p]
        begin, end = int(starts[owner]), int(ends[owner]) - q
        if (ids[p : p + width] != ids[p + q : p + q + width]).any():
            continue  # equal hashes of different words
        left, right = _reach(ids, p, q, begin, end, -1), _reach(ids, p, q, begin, end, 1)
        done, last = right, q
        if right - left + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
            yield left, right - left + q, q


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each list of words, by start, then period."""
    numbers = Numbers()
    ids = numbers([w for words in texts for w in words])
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(counts)
    starts = ends - counts
    unit = np.repeat(np.arange(len(texts)), counts)
    found: dict[tuple[int, int], int] = {}

    def keep(runs: Iterator[tuple[int, int, int]]) -> None:
        for s, n, q in runs:  # periods only rise from scan to scan
            found.setdefault((s, n), q)

    most = int(counts.max(initial=0))
    for q in range(1, min(LAGS, most // LEAST_PERIODS + 1)):
        keep(_lag_runs(ids, unit, q))
    spans, hashes, low = SpanHasher(), number_hashes(ids), LAGS
    while LEAST_PERIODS * low <= most:
        keep(sorted(_scale_runs(ids, unit, starts, ends, spans, hashes, low), key=lambda r: r[2]))
        low *= 2
    result: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (s, n), q in sorted(found.items(), key=lambda r: (r[0][0], r[1])):
        owner = int(unit[s])
        result[owner].append((s - int(starts[owner]), n, q))
    return result


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, runs, longest, collapsed)`` for every row; ``key`` must be a whole number.

    ``longest`` is the run with most periods, null where a text has none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "length", "period")
        struct = pa.struct([(name, pa.int64()) for name in names])
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for first, end in _slices(texts):
                words = [t.split() for t in texts[first:end]]
                runs = find_runs(words)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first),
                    pa.array(map(len, words), pa.int64()),
                    pa.array([[dict(zip(names, r)) for r in rs] for rs in runs], pa.list_(struct)),
                    pa.array([dict(zip(names, longest(rs))) if rs else None for rs in runs], struct),
                    pa.array([collapse(w, rs) for w, rs in zip(words, runs)], pa.binary()).cast(pa.string()),
                ], names=["key", "n_words", "runs", "longest", "collapsed"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text"))
    return map_batches(rows, work, SCHEMA)
