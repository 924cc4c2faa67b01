"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds the vectors of its letters, each permuted by
its place: V(abc) = shift2(a) * shift1(b) * c. A text is the bundle (the sum) of its trigrams, a language the
bundle of the trigrams of all its training texts, and a text belongs to the language with the largest cosine.

Training sums over all training rows on the executors: a task sends one vector per language, Spark adds them
up, and only languages x dimensions numbers reach the driver.

Trigrams are taken around each letter, in lower case; a neighbour that is no letter counts as a blank. Defined
results: null text or a text without letters gives ``und`` and score 0; so does every text if nothing could be
learned. Ties go to the language that sorts first. Texts of any length are read whole. An empty table
gives no rows, and teaches nothing. Training ignores columns other than those named; ``predict`` and ``keep_known`` keep
them, but for columns of the names that ``predict`` adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.text import CodePoints, map_batches, text_slices

UNDETERMINED = "und"
DIMENSIONS = 512
# Languages are few by nature; their vectors go to every task, so their number is checked.
MAX_LANGUAGES = 10_000
# Trigram vectors held at once: texts of many different letters have very many trigrams.
VECTOR_ROWS = 1 << 15
# Largest table of letter triples; beyond it trigrams are found by sorting instead.
DENSE_KEYS = 1 << 22


class LetterSpace:
    """Random vectors of letters and the bundles of texts made of them."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.known = np.zeros(0x110000, bool)
        self.lower = np.zeros(0x110000, np.uint32)  # 0: no letter
        self.vectors: dict[int, np.ndarray] = {}

    def _learn(self, points: np.ndarray) -> None:
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        for point in np.flatnonzero(seen & ~self.known).tolist():
            char = chr(point)
            if char.isalpha():
                small = char.lower()
                self.lower[point] = ord(small) if len(small) == 1 else point
            self.known[point] = True

    def _vector(self, point: int) -> np.ndarray:
        if point not in self.vectors:
            random = np.random.Generator(np.random.PCG64([self.seed, point]))
            self.vectors[point] = (random.integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.vectors[point]

    def trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Letter vectors; the distinct trigrams as numbers made of letter rows; each trigram's place among them and its text."""
        chunk = CodePoints(texts)
        self._learn(chunk.points)
        letters = self.lower[chunk.points]
        at = np.flatnonzero(letters)
        seen = np.zeros(0x110000, bool)
        seen[letters] = True
        seen[0] = True
        alphabet = np.flatnonzero(seen)
        dense = np.zeros(0x110000, np.int64)
        dense[alphabet] = np.arange(len(alphabet))
        code, m = dense[letters], len(alphabet)
        keys = (code[at - 1] * m + code[at]) * m + code[at + 1]
        if m**3 <= DENSE_KEYS:
            table = np.zeros(m**3, bool)
            table[keys] = True
            distinct = np.flatnonzero(table)
            place = np.zeros(m**3, np.int64)
            place[distinct] = np.arange(len(distinct))
            rows = place[keys]
        else:
            distinct, rows = np.unique(keys, return_inverse=True)
        own = np.array([self._vector(int(p)) for p in alphabet], np.int8).reshape(m, self.dimensions)
        return own, distinct, rows, chunk.owner(at)

    def bound(self, own: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """The vectors of some distinct trigrams."""
        m = len(own)
        vectors = np.roll(own[distinct // (m * m)], 2, axis=1) * np.roll(own[distinct // m % m], 1, axis=1)
        return (vectors * own[distinct % m]).astype(np.float32)

    def bundle(self, texts: list[str], group: np.ndarray | None = None, groups: int | None = None) -> np.ndarray:
        """Sum of the trigram vectors of each text, or of each group of texts; the sums are exact in any order."""
        own, distinct, rows, owner = self.trigrams(texts)
        if group is not None:
            owner = group[owner]
        n = len(texts) if groups is None else groups
        out = np.zeros((n, self.dimensions), np.float64)
        for low in range(0, len(distinct), VECTOR_ROWS):
            some = distinct[low : low + VECTOR_ROWS]
            part = slice(None) if len(some) == len(distinct) else (rows >= low) & (rows < low + len(some))
            self._add(out, self.bound(own, some), rows[part] - low, owner[part], sorted_=group is None)
        return out

    def _add(self, out: np.ndarray, vectors: np.ndarray, rows: np.ndarray, owner: np.ndarray, sorted_: bool) -> None:
        n, width = len(out), max(1, len(vectors))
        step = max(1, (1 << 22) // width)  # bounds the table of counts
        if not sorted_ and n > step:
            order = np.argsort(owner, kind="stable")
            owner, rows = owner[order], rows[order]
        for first in range(0, n, step):
            last = min(n, first + step)
            lo, hi = (0, len(rows)) if step >= n else np.searchsorted(owner, [first, last])
            if lo < hi:
                flat = (owner[lo:hi] - first) * width + rows[lo:hi]
                counts = np.bincount(flat, minlength=(last - first) * width).reshape(last - first, width)
                out[first:last] += counts.astype(np.float32) @ vectors


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # one row of unit length per language
    seed: int

    @property
    def dimensions(self) -> int:
        return self.prototypes.shape[1]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS,
          seed: int = 9) -> LanguageModel:
    """Bundle all rows of ``docs`` with text and language into one prototype per language."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = LetterSpace(dimensions, seed), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, end in text_slices(texts):
                names = sorted(set(langs[first:end]))
                index = {name: i for i, name in enumerate(names)}
                group = np.array([index[x] for x in langs[first:end]], np.int64)
                for name, vector in zip(names, space.bundle(texts[first:end], group, len(names))):
                    total[name] = total.get(name, 0) + np.rint(vector).astype(np.int64)
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(vector)],
                names=["lang", "place", "value"],
            )

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    partial = map_batches(rows, sums, "lang string, place int, value bigint")
    # Exact sums in any order. The numbers kept per task are few; Spark adds them up before it sends them.
    added = partial.groupBy("lang", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("double").alias("value"))
    collected = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
    learned = collected.select("lang", F.transform("v", lambda x: x["value"]).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(learned) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    learned.sort(key=lambda r: r["lang"])
    vectors = np.array([r["v"] for r in learned], np.float64).reshape(len(learned), dimensions)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return LanguageModel(tuple(r["lang"] for r in learned), vectors / np.where(norms == 0, 1, norms), seed)


def judge(model: LanguageModel, space: LetterSpace, texts: list[str]) -> list[tuple[str, float]]:
    """Language and score of each text."""
    out: list[tuple[str, float]] = []
    for first, end in text_slices(texts):
        vectors = space.bundle(texts[first:end])
        norms = np.linalg.norm(vectors, axis=1)
        if not model.languages:
            out += [(UNDETERMINED, 0.0)] * (end - first)
            continue
        cosines = vectors @ model.prototypes.T / np.where(norms == 0, 1, norms)[:, None]
        best = cosines.argmax(axis=1)
        top = np.clip(cosines[np.arange(end - first), best], 0, 1)
        out += [
            (model.languages[b], float(c)) if n > 0 else (UNDETERMINED, 0.0) for b, c, n in zip(best, top, norms)
        ]
    return out


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of the text column; no shuffle."""
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = LetterSpace(model.dimensions, model.seed)
        for batch in batches:
            judged = judge(model, space, [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()])
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([x for x, _ in judged], pa.string()), pa.array([x for _, x in judged], pa.float64())],
                names=[*kept, "lang_pred", "score"],
            )

    rows = docs.select(*kept, F.col(text).alias("_llm_input"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, work, f"{fields}{', ' if kept else ''}lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, min_score: float = 0.0, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``min_score``, all columns kept; no shuffle."""
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = LetterSpace(model.dimensions, model.seed)
        for batch in batches:
            judged = judge(model, space, [x or "" for x in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([name != UNDETERMINED and score >= min_score for name, score in judged], pa.bool_()))

    return map_batches(docs, keep, docs.schema)
