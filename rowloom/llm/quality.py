"""Quality classifier on supervised subword embeddings.

The words and the character n-grams of a text are hashed to rows of one embedding table; a text is the average
of its rows, a softmax over two classes turns it into a score. The table and the output layer are learned
together by stochastic gradient descent in numpy, on bags of hashed features that the executors make.

As the average is linear, a trained model needs one number per row of the table (the difference of the two
classes), which is all that scoring looks up: the same result as averaging vectors, without their width.

Training takes at most ``sample`` rows per class (the smallest hashes of the id), and of these as many as have ``entries``
features together, so that the bags fit on the driver; a bag has at most ``buckets`` entries however long its text.
Everything else covers all rows.

Defined results: a null or empty text has an empty bag and gets the score of the output layer's bias; without
labels of both classes every score is the share of class 1 (0.5 without labels). Several labels of one id count
as their maximum. Ids that repeat in the documents are scored row by row. Rows with a null id are scored, and no
label is theirs. An empty table gives no rows. Other columns stay as they are, but for one named ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.components import written
from rowloom.llm.text import CodePoints, SpanHasher, map_batches, mix, text_slices

SAMPLE = 2500  # training rows per class, at most
ENTRIES = 1 << 23  # features of all training rows, at most: what the driver holds of them is 64 MB
BUCKETS = 1 << 16
WIDTH = 16
EPOCHS = 6
RATE = 0.4
NGRAMS = (2, 3)
REPEATED = 0x5EED  # the row of the mark that a word repeats the one before it


def features(texts: list[str], hasher: SpanHasher, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words and character n-grams, and the text of each.

    N-grams lie inside the word with a blank on both sides. A word that repeats the one before it also counts
    as a mark of its own, which is the same for all words.
    """
    chunk = CodePoints(texts)
    starts, ends, owner = chunk.words()
    points = chunk.points.copy()
    points[(points == 32) | ((points >= 9) & (points <= 13))] = 32
    mask = np.uint64(buckets - 1)
    words = hasher(points, starts, ends)
    again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
    rows = [(words & mask).astype(np.int64), np.full(len(again), REPEATED & (buckets - 1))]
    owners = [owner, owner[again]]
    of_point = np.zeros(len(points), np.int32)
    solid = points != 32
    of_point[starts[1:]] = np.diff(owner)
    if len(owner):
        of_point[starts[0]] = owner[0]
    of_point = np.cumsum(of_point)  # text of each point from its first word on
    wide = points.astype(np.uint64)
    for n in NGRAMS:
        count = max(0, len(points) - n + 1)
        key = np.full(count, n, np.uint64)
        inside = np.ones(count, bool)
        for k in range(n):
            key = key * np.uint64(0x110001) + wide[k : k + count]
            if 0 < k < n - 1 or n < 3:
                inside &= solid[k : k + count]
        inside &= solid[:count] | solid[n - 1 : n - 1 + count]
        at = np.flatnonzero(inside)
        rows.append((mix(key[at]) & mask).astype(np.int64))
        owners.append(of_point[np.where(solid[at], at, at + 1)])
    return np.concatenate(rows), np.concatenate(owners).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # one number per row of the embedding table
    bias: float

    def scores(self, texts: list[str], hasher: SpanHasher) -> np.ndarray:
        rows, owner = features(texts, hasher, len(self.weights))
        total = np.bincount(owner, self.weights[rows], len(texts))
        count = np.bincount(owner, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def _bags(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """The hashed features of each training row with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            ids, counts = [], []
            for first, end in text_slices(texts):
                rows, owner = features(texts[first:end], hasher, buckets)
                flat, n = np.unique(owner * buckets + rows, return_counts=True)
                cuts = np.searchsorted(flat, np.arange(1, end - first) * buckets)
                ids += np.split((flat % buckets).astype(np.int32), cuts)
                counts += np.split(n.astype(np.int32), cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int32()))],
                names=["label", "place", "ids", "counts"],
            )

    return map_batches(docs.select("label", "place", F.col(text).alias("text")), count,
                       "label int, place bigint, ids array<int>, counts array<int>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text",
          sample: int = SAMPLE, entries: int = ENTRIES, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS,
          rate: float = RATE, seed: int = 6) -> QualityModel:
    """Learn from the ``labels`` (0 or 1) of ``docs``; both are taken as given, so hold rows out before.

    The model is fitted on at most ``sample`` ids of each class, those of the smallest hash, and of these on as many as
    have ``entries`` different features together, texts counted alike for both classes. Of rows that share an id the
    smallest text counts.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("_key").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("_key").agg(F.max("label").alias("label"))
    place = F.xxhash64("_key", F.lit(seed))
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).withColumn("place", place).orderBy("place", "_key").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * sample small rows, so the broadcast is bounded; the texts are not shuffled.
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")
    rows = rows.groupBy("_key", "label", "place").agg(F.min("text").alias("text"))
    bags = written(_bags(rows, "text", buckets), "bags")
    # A small row per text tells how many fit; only the features of these reach the driver, as arrays.
    kinds = bags.select("label").distinct().count()
    sizes = Window.partitionBy("label").orderBy("place", F.size("ids")).rowsBetween(Window.unboundedPreceding, 0)
    fit = bags.withColumn("_sum", F.sum(F.size("ids")).over(sizes)).filter(F.col("_sum") <= entries // max(1, kinds))
    table = fit.select("label", "place", "ids", "counts").toArrow()
    table = table.take(pc.sort_indices(table, sort_keys=[("place", "ascending"), ("label", "ascending")]))
    target = table.column("label").to_numpy().astype(np.float64)
    if len(set(target.tolist())) < 2:
        share = min(max(target.mean() if len(target) else 0.5, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(buckets), float(np.log(share / (1 - share))))
    ids, shares = [], []
    for chunk_ids, chunk_counts in zip(table.column("ids").chunks, table.column("counts").chunks):
        cuts = chunk_ids.offsets.to_numpy()
        each = np.split(chunk_ids.values.to_numpy()[: cuts[-1]], cuts[1:-1]), np.split(chunk_counts.values.to_numpy()[: cuts[-1]], cuts[1:-1])
        for own, counts in zip(*each):
            ids.append(own)
            shares.append(counts.astype(np.float32) / max(1, int(counts.sum())))
    del table
    return descend(ids, shares, target, buckets, width, epochs, rate, seed)


def descend(ids: list[np.ndarray], shares: list[np.ndarray], target: np.ndarray, buckets: int, width: int, epochs: int,
            rate: float, seed: int) -> QualityModel:
    """Stochastic gradient descent on bags: the features of each text, their shares, and its label (0 or 1)."""
    random = np.random.default_rng(seed)
    table = (random.random((buckets, width), np.float32) - 0.5) / width
    out = np.zeros((width, 2), np.float32)
    bias = np.zeros(2, np.float32)
    # Both classes weigh the same, so that the score does not lean to the frequent one.
    weight = np.where(target == 1, len(target) / (2 * target.sum()), len(target) / (2 * (1 - target).sum()))
    steps, done = epochs * len(ids), 0
    for _ in range(epochs):
        for i in random.permutation(len(ids)).tolist():
            speed = np.float32(rate * (1 - done / steps) * weight[i])
            done += 1
            mean = shares[i] @ table[ids[i]]
            logits = mean @ out + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[int(target[i])] -= 1
            back = out @ chance
            out -= speed * np.outer(mean, chance)
            bias -= speed * chance
            # Every feature of the text gets the text's step, scaled by its share of the most frequent one.
            table[ids[i]] -= speed * np.minimum(1, shares[i] * len(ids[i]))[:, None] * back
    gap = out[:, 1] - out[:, 0]
    return QualityModel((table @ gap).astype(np.float64), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` in place of the text column; no shuffle."""
    kept = [c for c in docs.columns if c not in (text, "score")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            scores = [model.scores(texts[first:end], hasher) for first, end in text_slices(texts)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.float64())], names=[*kept, "score"])

    rows = docs.select(*kept, F.col(text).alias("_llm_input"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, judge, f"{fields}{', ' if kept else ''}score double")
