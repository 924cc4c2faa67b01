"""Conversations as one stream of tokens, with shared beginnings stored once.

Conversations that share their first turns are merged in a prefix tree: a node is a turn after a given history. The
tree is written depth first; every node's tokens appear once. A node carries the position of its first token in its
conversation (positions go on from the parent, whatever lies between in the stream) and the intervals of the
stream it may attend to: those of its ancestors, merged where they touch, besides its own tokens so far.

How the tree is made: a task streams through a conversation and chains the digests of its turns, so equal
histories have equal node names and no comparison of texts is needed. Sorting the distinct conversations by their
chain of names puts them in depth-first order; a node belongs to the first conversation that passes through it, so
(rank of that conversation, depth) orders the nodes. Only sums and sorts are shuffled: neither a common first turn
nor a conversation that occurs very often gathers in one task.

Template: ``<|turn|>`` role, line break, text, ``<|end|>``, line break. Control strings inside roles and texts get a
backslash after their first character and backslashes are doubled, which is undone by reading back.
The text of assistant turns is under the loss mask. Tokens are those of a byte-level BPE vocabulary of the tokenizers
library, or code points without one; a turn's head, text and end are tokenized apart.

Defined results: null roles and texts are empty; null turns come first; repeated turns are kept, ordered by role and
text; a null conversation id is a conversation of its own; other ids must be whole numbers. Texts of any length are taken
whole. An empty table gives an empty forest. Columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.components import written
from rowloom.llm.text import map_batches
from rowloom.llm.token_store import worker_tokenizer
from rowloom.session import checked_broadcast

NAME_BYTES = 16
TURN, END = "<|turn|>", "<|end|>\n"
LEARNED = "assistant"
# Strings that steer models: those of this template and of other common ones.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """``text`` without any control string in it."""
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Codec:
    """Texts to ids and back."""

    def __init__(self, vocabulary: str | None) -> None:
        self.words = worker_tokenizer(vocabulary) if vocabulary else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.words:
            return self.words.encode(texts)
        return [np.frombuffer(x.encode("utf-32-le"), "<u4") for x in texts]

    def decode(self, ids: np.ndarray) -> str:
        if self.words:
            return self.words.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return np.asarray(ids, "<u4").tobytes().decode("utf-32-le")


def chained(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each turn with its depth, its node's name, and on the last turn the names of the whole conversation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "depth", "role", "text", "node", "path"]
        current, path = object(), bytearray()
        held: list = []  # the last turn read, as the next one tells whether its conversation is over

        def batch_of(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            rows = []
            for key, who, said in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if key != current:
                    if held:
                        held[0][5] = bytes(path)
                    current, path = key, bytearray()
                rows += held
                data = who.encode(), said.encode()
                name = hashlib.sha256(path[-NAME_BYTES:] + len(data[0]).to_bytes(8, "little") + data[0] + data[1]).digest()
                held = [[key, len(path) // NAME_BYTES, who, said, name[:NAME_BYTES], None]]
                path += name[:NAME_BYTES]
            if rows:
                yield batch_of(rows)
        if held:
            held[0][5] = bytes(path)
            yield batch_of(held)

    rows = turns.select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"
    )
    return map_batches(dealt, work, "conv bigint, depth int, role string, text string, node binary, path binary")


def tokenized(nodes: DataFrame, vocabulary: str | None) -> DataFrame:
    """Nodes in order with their tokens, and the place of the first one within its task's part of the stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, codec = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            codec = codec or Codec(vocabulary)
            roles, texts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            heads = codec.encode([f"{TURN}{escape(r)}\n" for r in roles])
            bodies = codec.encode([escape(t) for t in texts])
            end = codec.encode([END])[0]
            ids = [np.concatenate([h, b, end]).astype(np.int32) for h, b in zip(heads, bodies)]
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = place + np.cumsum(sizes) - sizes
            place += int(sizes.sum())
            first = np.array([len(h) for h in heads], np.int32)
            last = first + np.array([len(b) for b in bodies], np.int32)
            learned = np.array([r == LEARNED for r in roles], bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(sizes),
                 pa.array(ids, pa.list_(pa.int32())), pa.array(first), pa.array(last), pa.array(learned)],
                names=["owner", "depth", "node", "part", "place", "n", "ids", "text_start", "text_end", "learned"],
            )

    schema = ("owner bigint, depth int, node binary, part int, place bigint, n bigint, ids array<int>, text_start int, "
              "text_end int, learned boolean")
    return map_batches(nodes, work, schema)


def placed(steps: DataFrame) -> DataFrame:
    """Position and attention intervals of every node, from the steps of all distinct conversations."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, position, spans = None, 0, []
        for batch in batches:
            out = []
            for at, node, owner, start, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if at != rank:
                    rank, position, spans = at, 0, []
                if owner == at:
                    out.append((node, position, [{"start": s, "end": e} for s, e in spans]))
                if spans and spans[-1][1] == start:
                    spans[-1] = (spans[-1][0], start + n)
                else:
                    spans.append((start, start + n))
                position += n
            if out:
                nodes, positions, attends = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), pa.array(positions, pa.int64()),
                     pa.array(attends, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["node", "position", "attends"],
                )

    dealt = steps.repartition("rank").sortWithinPartitions("rank", "depth")
    return map_batches(dealt.select("rank", "depth", "node", "owner", "start", "n"), work,
                       "node binary, position bigint, attends array<struct<start: bigint, end: bigint>>")


class Forest:
    """The written tree: ``nodes`` is the stream, one row per node in order of ``start``; ``leaves`` tells the
    rank of each conversation (by its path), and ``steps`` the nodes of each rank."""

    def __init__(self, nodes: DataFrame, leaves: DataFrame, paths: DataFrame, steps: DataFrame) -> None:
        self.nodes, self.leaves, self.paths, self.steps = nodes, leaves, paths, steps


def format_conversations(turns: DataFrame, vocabulary: str | None = None, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> Forest:
    """Write the prefix tree of all conversations to the shared folder.

    ``nodes``: node, start, n, position, attends, ids, text_start, text_end (the text within ids), loss_start, loss_end
    (the part of ids that is learned, empty for other roles).
    """
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chain = written(chained(turns, conv, turn, role, text), "turns")
    leaves = chain.filter("path is not null").select("conv", "path")
    distinct = leaves.select("path").distinct().repartitionByRange(parts, "path").sortWithinPartitions("path")
    paths = written(distinct.withColumn("rank", F.monotonically_increasing_id()), "paths")
    at = F.sequence(F.lit(0), (F.octet_length("path") / NAME_BYTES).cast("int") - 1)
    steps = paths.select("rank", F.posexplode(F.transform(at, lambda i: i)).alias("depth", "i"), "path").select(
        "rank", "depth", F.expr(f"substring(path, {NAME_BYTES} * i + 1, {NAME_BYTES})").alias("node")
    )
    steps = written(steps, "steps")
    owners = steps.groupBy("node").agg(F.min("rank").alias("owner"), F.min("depth").alias("depth"))
    contents = chain.select("node", "role", "text").dropDuplicates(["node"])
    ordered = contents.join(owners, "node").select("owner", "depth", "node", "role", "text")
    ordered = ordered.repartitionByRange(parts, "owner", "depth").sortWithinPartitions("owner", "depth")
    made = written(tokenized(ordered, vocabulary), "tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one small row per task
    totals = made.groupBy("part").agg(F.sum("n").alias("total"))
    offsets = written(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")), "offsets")
    made = made.join(checked_broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("place"))
    where = made.select("node", "owner", "start", "n")
    positions = placed(steps.join(where, "node"))
    nodes = made.join(positions, "node").select(
        "node", "start", "n", "position", "attends", "ids", "text_start", "text_end",
        F.col("text_start").alias("loss_start"), F.when(F.col("learned"), F.col("text_end")).otherwise(F.col("text_start")).alias("loss_end"),
    )
    stream = nodes.repartitionByRange(parts, "start").sortWithinPartitions("start")
    return Forest(written(stream, "nodes"), leaves, paths, steps)


def digests(forest: Forest, vocabulary: str | None = None) -> DataFrame:
    """Every conversation read back from the stream:
    ``(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens)``.

    A distinct conversation is read once, however many have it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, codec, state, seen, kept = None, None, None, {}, 0
        names = ["rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

        def result() -> list:
            n, turns, chars, loss, formatted, tokens = state
            return [rank, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, tokens]

        def batch_of(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            codec, rows = codec or Codec(vocabulary), []
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                at, _, start, position, a, b, la, lb = (c[i].as_py() for c in columns[:8])
                if at != rank:
                    if state:
                        rows.append(result())
                    rank, state = at, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if position != state[5]:
                    raise ValueError("the positions of a conversation do not follow each other")
                if start not in seen:  # shared turns come again and again
                    if kept > 1 << 22:
                        seen, kept = {}, 0
                    ids = columns[8][i].values.to_numpy(zero_copy_only=False)
                    head, body, tail = codec.decode(ids[:a]), codec.decode(ids[a:b]), codec.decode(ids[b:])
                    loss = codec.decode(ids[la:lb]) if lb > la else ""
                    said = unescape(head[len(TURN) : -1]), unescape(body), unescape(loss)
                    seen[start] = (*said, len(head) + len(body) + len(tail), len(ids))
                    kept += len(body)
                role, text, loss, chars, tokens = seen[start]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
                state[5] += tokens
            if rows:
                yield batch_of(rows)
        if state:
            yield batch_of([result()])

    read = forest.steps.join(forest.nodes, "node").select(
        "rank", "depth", "start", "position", "text_start", "text_end", "loss_start", "loss_end", "ids"
    )
    dealt = read.repartition("rank").sortWithinPartitions("rank", "depth")
    schema = ("rank bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint, n_tokens bigint")
    found = map_batches(dealt, work, schema)
    by_path = written(forest.paths.join(found, "rank").drop("rank"), "digests")
    return forest.leaves.join(by_path, "path").drop("path")
