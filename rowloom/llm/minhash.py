"""MinHash fingerprints of documents, and near-duplicates found by bands of them.

A text is its set of five-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; fewer words make one
shingle of all). Each of 128 universal hash functions ``(a * x + b) mod 2**64 >> 32`` gives the smallest value
over the set; the fingerprint keeps the low 16 bits of each, in hex. The share of equal places is an unbiased
estimate of the Jaccard similarity, up to one chance in 65,536 per place.

Defined results: null texts count as empty; an empty text has the fingerprint of all ones, so two empty texts
are alike. Equal texts have equal fingerprints. Repeated ids are rows of their own. Texts of any length are taken whole, a
longer one than a piece by itself. An empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.components import components, written
from rowloom.llm.order import descending_slices
from rowloom.llm.text import CodePoints, SpanHasher, map_batches, mix, text_slices

WORDS = 5
PERMUTATIONS = 128
# 21 bands of 6 places: a pair with similarity 0.8 shares a band with a chance of 99.8 %.
BANDS, ROWS = 21, 6
SIMILARITY = 0.8
ROUNDING = 1e-9  # room for sums of similarities, which are quotients of whole numbers
# Texts that are hashed at once: the hashes of their shingles stay in the processor's cache.
PIECE = 1 << 18


class MinHasher:
    def __init__(self, permutations: int = PERMUTATIONS, words: int = WORDS, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        self.a = random.integers(0, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = random.integers(0, 2**63, permutations, np.uint64)
        self.place = random.integers(0, 2**63, words, np.uint64) * np.uint64(2) + np.uint64(1)
        self.words = words
        self.hasher = SpanHasher()

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of all texts in order, and the text of each."""
        chunk = CodePoints(texts)
        starts, ends, owner = chunk.words()
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        word = self.hasher(chunk.ascii_lower(), starts, ends)
        counts = np.bincount(owner, minlength=len(texts))
        # a word starts a shingle if enough words of its text follow, or if it is the first of a short text
        nth = np.arange(len(word)) - (np.cumsum(counts) - counts)[owner]
        span = np.minimum(counts, self.words)[owner]
        first = np.flatnonzero(nth + span <= counts[owner])
        total = np.zeros(len(first), np.uint64)
        for k in range(self.words):
            inside = k < span[first]
            at = np.minimum(first + k, len(word) - 1)
            total += np.where(inside, word[at] * self.place[k], np.uint64(0))
        return mix(total), owner[first]

    def signatures(self, texts: list[str]) -> np.ndarray:
        """One row of 16-bit values per text."""
        out = np.full((len(texts), len(self.a)), 0xFFFF, np.uint16)
        for first, end in text_slices(texts, PIECE):
            x, owner = self.shingles(texts[first:end])
            if not len(x):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rows = first + owner[cuts]
            hashes = np.empty_like(x)
            for k, (a, b) in enumerate(zip(self.a, self.b)):
                np.multiply(x, a, out=hashes)
                np.add(hashes, b, out=hashes)
                out[rows, k] = (np.minimum.reduceat(hashes, cuts) >> np.uint64(32)) & np.uint64(0xFFFF)
        return out


def hex_rows(signatures: np.ndarray) -> list[str]:
    big = signatures.astype(">u2")
    return [row.tobytes().hex() for row in big]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint)`` of every row; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            made = hex_rows(hasher.signatures(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, F.col(text).alias("_llm_input")), work, f"`{key}` {kind}, fingerprint string")


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness to each other and to the next text.

    Rows are taken in descending ``key`` (null last, ties by text); after the last comes the first. The edit
    replaces the last third of the code points by the first as many of the next text. One shuffle deals the
    texts into slices of that order; a task streams through its slice and holds one piece of it at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher()

        def solve(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
            texts = [x for _, x in rows] + [following]
            edited = []
            for own, after in zip(texts, texts[1:]):
                n = len(own) // 3
                edited.append(own[: len(own) - n] + after[:n])
            signs, edits = hasher.signatures(texts), hasher.signatures(edited)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in rows], pa.int64()),
                    pa.array([len(x) for _, x in rows], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array(hex_rows(signs[:-1]), pa.string()),
                    pa.array(hex_rows(edits), pa.string()),
                    pa.array((signs[:-1] == edits).mean(axis=1)),
                    pa.array((signs[:-1] == signs[1:]).mean(axis=1)),
                ],
                names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        held: list[tuple[int | None, str]] = []
        size, current, first, ended = 0, None, "", False
        for batch in batches:
            for k, x, at, ahead in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = x or ""
                if at != current:
                    if held:
                        yield solve(held, first)
                    held, size, current, first, ended = [], 0, at, x, False
                if ended:
                    continue
                if held and (ahead or size > PIECE):
                    yield solve(held, x)
                    held, size = [], 0
                if ahead:
                    ended = True
                else:
                    held.append((k, x))
                    size += len(x)
        if held:
            yield solve(held, first)

    rows = descending_slices(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")), "key", "text")
    schema = ("key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return map_batches(rows.select("key", "text", "_slice", "_ahead"), work, schema).withColumnRenamed("key", key)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    similarity: float = SIMILARITY) -> DataFrame:
    """``(key, class_id, similarity)`` of every row: the smallest key of its class and its likeness to that row.

    Rows with the same set of shingles count once. Two rows link if they share a band and the exact Jaccard similarity
    of their shingles is at least ``similarity``; classes are the closure of links, so a row can be less like the
    smallest one than that. Within a band every member is compared with the smallest one (the leader); those that
    are alike need no comparison among themselves and leave; the others go into another round, until none is left.
    One that leaves is compared with one that stays only where both can be alike: the Jaccard distance is a metric, so
    their distances to the leader differ by at most that of the two. So a band costs one comparison per member and
    round, and more only for members at the edge of a group.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            made = hex_rows(hasher.signatures(texts))
            sets = []
            for first, end in text_slices(texts, PIECE):
                x, owner = hasher.shingles(texts[first:end])
                cuts = np.searchsorted(owner, np.arange(1, end - first))
                sets += [np.unique(s).view(np.int64) for s in np.split(x, cuts)]
            digest = [hashlib.sha256(s.tobytes()).hexdigest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.string()), pa.array(digest, pa.string()), pa.array(sets, pa.list_(pa.int64()))],
                names=[key, "fingerprint", "same", "shingles"],
            )

    kind = docs.schema[key].dataType.simpleString()
    made = map_batches(docs.select(key, F.col(text).alias("_llm_input")), work,
                       f"`{key}` {kind}, fingerprint string, same string, shingles array<bigint>")
    made = written(made, "shingles")
    points = written(made.groupBy("same").agg(F.min(key).alias("id"), F.first("fingerprint").alias("fingerprint"),
                                              F.first("shingles").alias("shingles")), "points")
    sets = points.select("same", "shingles")

    def likeness(pairs: DataFrame) -> DataFrame:
        """``pairs(a, b)`` with their ``similarity``."""
        both = pairs.join(sets.select(F.col("same").alias("a"), "shingles"), "a").join(
            sets.select(F.col("same").alias("b"), F.col("shingles").alias("others")), "b")
        shared = F.size(F.array_intersect("shingles", "others"))
        alike = shared / F.greatest(F.size("shingles") + F.size("others") - shared, F.lit(1))
        return both.select("a", "b", alike.alias("similarity"))

    alike_enough = F.col("similarity") >= similarity
    wide = 4 * ROWS
    band = F.explode(F.array(*[F.concat(F.lit(f"{i}:"), F.substring("fingerprint", 1 + i * wide, wide)) for i in range(BANDS)]))
    open_ = written(points.select("same", "id", band.alias("band")), "bands")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same"))
    found = sets.sparkSession.createDataFrame([], "a string, b string")
    while not open_.isEmpty():
        lead = open_.groupBy("band").agg(first.alias("lead"), F.count(F.lit(1)).alias("n"))
        member = open_.join(lead.filter("n > 1"), "band").filter(F.col("same") != F.col("lead.same"))
        member = written(member.select("band", "same", "id", F.col("lead.same").alias("leader")), "members")
        told = written(likeness(member.select(F.col("leader").alias("a"), F.col("same").alias("b")).distinct()), "told")
        near = written(told.filter(alike_enough).select("a", "b"), "links")
        told = member.join(told.select(F.col("a").alias("leader"), F.col("b").alias("same"), "similarity"), ["leader", "same"])
        told = written(told, "told")
        open_ = written(told.filter(~alike_enough).select("same", "id", "band"), "bands")
        gone = told.filter(alike_enough).select("band", F.col("same").alias("x"), F.col("similarity").alias("sx"))
        edge = told.filter(~alike_enough & (F.col("similarity") >= 2 * similarity - 1 - ROUNDING))
        edge = edge.select("band", F.col("same").alias("y"), F.col("similarity").alias("sy"))
        across = gone.join(edge, "band").filter(F.col("sy") >= F.col("sx") + similarity - 1 - ROUNDING)
        across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        across = written(likeness(across).filter(alike_enough).select("a", "b"), "links")
        found = found.unionByName(near).unionByName(across)
    roots = components(found)
    rooted = written(points.select("same", "id").join(roots, F.col("same") == F.col("node"), "left").select(
        "same", "id", F.coalesce("root", "same").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(first.alias("least"))
    classed = written(rooted.join(least, "root").select("same", F.col("least.id").alias("class_id"), F.col("least.same").alias("least")), "classes")
    alike = likeness(classed.filter("same != least").select(F.col("same").alias("a"), F.col("least").alias("b")))
    named = classed.join(alike.select(F.col("a").alias("same"), "similarity"), "same", "left").select(
        "same", "class_id", F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    return made.select(key, "same").join(named, "same").select(key, "class_id", "similarity")
