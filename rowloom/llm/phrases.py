"""Phrase collocations: frequent phrases of 2 to 4 words whose parts seldom stand alone, per group of documents.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words. A
phrase is a row of words inside a piece; ``f`` counts all its places, overlapping ones included. Candidates have a count
``a`` of at least ``least``. Cutting a candidate after k words gives ``l`` and ``r``, the counts of both parts, and
``floor(2,000,000 * a / (l + r))``; the cut with the lowest value gives the score, the smallest k among equal ones. A
candidate goes if a longer candidate that holds it is at least ``cover`` percent as frequent.

Method: Rabin-Karp fingerprints. A block of documents (``blocks.py``) hashes all its phrases of one length at once, as
differences of prefix polynomials over word hashes, and counts each fingerprint, with the place of its first occurrence
in the block as pointer. Buckets add the counts of all blocks and say which fingerprints are frequent enough; a phrase
of n words is asked for only where both its parts of n - 1 words were. At the end blocks look the frequent fingerprints
up by their pointers, compare every other occurrence with the words found there, and count an occurrence with other
words as the phrase that it is. Only these phrases become text, and their counts are added up by text: two phrases of
one fingerprint can make a phrase come as far as this, but no count is ever mixed.

A task holds one block or one bucket. Counts are added up in each task before they are shuffled, so that a very common
phrase is one row per task. All arithmetic is on whole numbers; products are decimals of 38 places.

Defined results: a null or empty text has no words; a null group is ``und``. Repeated rows count as often as they stand.
Equal scores go by ``a``, then by the phrase in byte order. An empty table gives no rows. Columns other than the group
and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.blocks import Block, bucket_count, bucket_slices, exchange, per_block, write_blocks
from rowloom.llm.components import written
from rowloom.llm.text import SpanHasher
from rowloom.llm.words import word_hashes

LONGEST = 4
UPPER = bytes(range(65, 91))
ENDS = b".,;:!?\n\x0b\x0c\r"
# One pass over a text: lower case, and a line feed for each end of a piece.
FOLD = bytes.maketrans(UPPER + ENDS, UPPER.lower() + b"\n" * len(ENDS))
SCALE = 2_000_000

COUNTS = "group string, n int, phrase string, f bigint"


def pieces(text: bytes) -> list[list[bytes]]:
    """The words of each piece that has any."""
    return [words for words in map(bytes.split, text.translate(FOLD).split(b"\n")) if words]


class Grams:
    """The phrases of one block: fingerprints of those that can be frequent, by length."""

    def __init__(self, block: Block, got: dict, buckets: int, longest: int) -> None:
        self.block, self.buckets = block, buckets
        self.group = block.of[block.unit]
        seeds = word_hashes([t.encode() for t in block.tags])
        # the group is part of every word, so phrases of two groups differ
        self.points = block.hashes[block.ids] ^ seeds[self.group]
        self.left = np.repeat(block.ends, np.diff(block.ends, prepend=0)) - np.arange(len(block.ids))
        self.places = {}
        self.hash = SpanHasher()
        before = np.arange(len(block.ids))
        for n in range(2, longest + 1):
            # a phrase can be frequent only if both its parts of n - 1 words are
            if n == 2:
                starts = before[self.left >= 2]
            else:
                frequent = np.zeros(len(block.ids) + 1, bool)
                frequent[before] = True
                starts = before[frequent[before + 1] & (self.left[before] >= n)]
            prints = self.hash(self.points, starts, starts + n)
            values, first, of, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
            self.places[n] = (starts, values, first, of, counts)
            if n - 1 not in got:
                break
            before = starts[self._frequent(got[n - 1], values)[of]]

    def _frequent(self, answers: dict[int, bytes], values: np.ndarray) -> np.ndarray:
        bits = np.zeros(len(values), bool)
        for bucket, part in bucket_slices(values, self.buckets):
            bits[part] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=part.stop - part.start)
        return bits

    def ask(self, n: int) -> Iterator[tuple[int, bytes]]:
        """Fingerprints of ``n`` words and their counts, by bucket."""
        _, values, _, _, counts = self.places[n]
        for bucket, part in bucket_slices(values, self.buckets):
            yield bucket, values[part].tobytes() + counts[part].astype("<u4").tobytes()

    def counted(self, n: int, answers: dict[int, bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First words and counts of the different frequent phrases of ``n`` words, occurrences compared word by word."""
        starts, values, first, of, counts = self.places[n]
        frequent = self._frequent(answers, values)
        ids = self.block.ids
        at = np.flatnonzero(frequent[of])
        pointer = starts[first[of[at]]]
        same = np.ones(len(at), bool)
        for i in range(n):
            same &= ids[starts[at] + i] == ids[pointer + i]
        same &= self.group[starts[at]] == self.group[pointer]
        sums = np.bincount(of[at[same]], minlength=len(values))
        kept = np.flatnonzero(sums)
        yield starts[first[kept]], sums[kept]
        other = starts[at[~same]]  # other words with the fingerprint of a frequent phrase
        if len(other):
            yield other, np.ones(len(other), np.int64)

    def rows(self, starts: np.ndarray, n: int, counts: np.ndarray, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """The phrases as text."""
        vocabulary = self.block.vocabulary
        groups = pa.array(self.block.tags, pa.string())
        for low in range(0, len(starts), size):
            part = starts[low : low + size]
            words = [vocabulary.take(pa.array(self.block.ids[part + i])) for i in range(n)]
            phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, b" ")
            yield pa.RecordBatch.from_arrays([
                groups.take(pa.array(self.group[part])), pa.array(np.full(len(part), n, np.int32)),
                phrase.cast(pa.string()), pa.array(counts[low : low + size].astype(np.int64)),
            ], names=["group", "n", "phrase", "f"])


def _answers(least: int):
    def answer(blobs: list[bytes]) -> list[bytes]:
        values = [np.frombuffer(blob, np.uint64, len(blob) // 12) for blob in blobs]
        counts = [np.frombuffer(blob, "<u4", offset=8 * (len(blob) // 12)) for blob in blobs]
        _, of = np.unique(np.concatenate(values), return_inverse=True)
        # sums of at most as many counts as there are words, far below 2**53
        sums = np.bincount(of, weights=np.concatenate(counts))
        frequent = (sums >= least)[of]
        return [np.packbits(part).tobytes() for part in np.split(frequent, np.cumsum([len(v) for v in values])[:-1])]

    return answer


def phrase_counts(df: DataFrame, group: str = "lang", text: str = "text", least: int = 30, longest: int = LONGEST) -> DataFrame:
    """``(group, n, phrase, f)``: exact counts of all words, and of the phrases of up to ``longest`` words with at least
    ``least`` places."""
    tag = F.coalesce(F.col(group).cast("string"), F.lit("und"))
    manifest = write_blocks(df.select(tag.alias("tag"), F.col(text).cast("binary").alias("text")), pieces, "pieces")
    buckets = bucket_count(manifest)
    answers = None
    for n in range(2, longest + 1):
        def ask(block: Block, got: dict, n: int = n) -> Iterator[tuple[int, bytes]]:
            yield from Grams(block, {**dict.fromkeys(range(1, n - 1), {}), **got}, buckets, n).ask(n)

        answers = exchange(manifest, answers, n - 1, buckets, ask, _answers(least))

    def count(block: Block, got: dict) -> Iterator[pa.RecordBatch]:
        got = {**dict.fromkeys(range(1, longest), {}), **got}
        grams = Grams(block, got, buckets, longest)
        singles = np.arange(len(block.ids))
        # a word may stand in several groups of one block
        keys = grams.group.astype(np.int64) * max(len(block.vocabulary), 1) + block.ids
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        yield from grams.rows(singles[first], 1, counts)
        for n in range(2, longest + 1):
            for starts, counts in grams.counted(n, got[n - 1]):
                yield from grams.rows(starts, n, counts)

    found = per_block(manifest, answers, count, COUNTS)
    summed = found.groupBy("group", "n", "phrase").agg(F.sum("f").alias("f"))
    return written(summed.filter((F.col("n") == 1) | (F.col("f") >= least)), "phrases")


def _part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(counts: DataFrame, top: int = 2000, cover: int = 80) -> DataFrame:
    """``(group, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each group by score, of ``phrase_counts``."""
    candidates = counts.filter("n > 1").select("group", "phrase", F.col("f").alias("a"), F.col("n").alias("size"),
                                               F.split("phrase", " ").alias("words"))
    # every part of a candidate is at least as frequent, so it has a row
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select(
        "group", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("first"),
        _part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"))
    table = counts.select("group", "phrase", "f")
    left = table.select("group", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = table.select("group", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = [F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r")]
    value = F.call_function("div", wide[0] * F.lit(SCALE).cast("decimal(7,0)"), wide[1] + wide[2])
    scored = (cuts.join(left, ["group", "first"]).join(right, ["group", "rest"])
              .groupBy("group", "phrase", "a").agg(F.min(F.struct(value.alias("score"), "cut", "l", "r")).alias("best")))
    # the most frequent longer candidate around each phrase
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")))))
    around = (candidates.filter("size > 2").select("group", inner.alias("phrase"), F.col("a").alias("longer"))
              .groupBy("group", "phrase").agg(F.max("longer").alias("longer")))
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * cover
    alone = scored.join(around, ["group", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    order = Window.partitionBy("group").orderBy(F.col("best.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = alone.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("n = 1").groupBy("group").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "group").select("group", F.col("rank").cast("bigint").alias("rank"), "phrase", "a",
                                               "best.l", "best.r", "n", "best.score")
