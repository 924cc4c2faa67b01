"""Token ids in binary shards: one array of ids, with document boundaries and keys in Elias-Fano code.

A shard file holds the ids of its documents one after the other (16 bits each if the vocabulary allows it, else
32), then the Elias-Fano code of the ends of the documents, then that of their keys, then a footer of fixed
size. Shards follow each other in ascending key order (null first, ties by text); a manifest lists them. The
place of a document is found by select on the boundary code, without a table of 64-bit offsets.

Tokenizing: byte-level BPE never joins across a single blank between two characters that are no white space,
so a text is cut there, and a word that a worker has met is looked up instead of encoded again. A new word of common
letters, digits and signs is cut further, where the vocabulary itself cuts it, and only pieces that are new are
encoded. The result is that of encoding the whole text at once. The vocabulary file is named by a path; tasks read it there.

Defined results: a null text is empty, an empty text is the end id alone. Repeated keys are rows of their own;
keys must be whole numbers or null, which come first. An empty table gives an empty manifest. Columns other than key and
text are ignored, whatever their names.
A task writes its shards as it reads, and rolls to a new one at ``shard_ids`` ids; the shards of a lost attempt
are not in the manifest and are never read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.components import written
from rowloom.llm.eliasfano import EliasFano, encode
from rowloom.llm.files import locate, new_file
from rowloom.llm.text import map_batches, text_slices
from rowloom.session import scratch_path

END_ID = 2
SHARD_IDS = 1 << 24
KNOWN_WORDS = 1 << 20  # different words a Python worker remembers
JOINED = 256  # words encoded in one call
# Letters and marks whose kind no version of Unicode doubts, and the pieces that a byte-level vocabulary cuts words of them
# into, a line end between two of them included. ``<`` is none of them, as special tokens begin with it.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIGNS = "!\"#$%&'()*+,\\-./:;=>?@\\[\\\\\\]^_`{|}~"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|\n")
PLAIN_WORD = re.compile(f"[{LETTERS}0-9{SIGNS}]+(?:\n[{LETTERS}0-9{SIGNS}]+)*")
PLAIN_CHARACTERS = {chr(i) for i in range(0x250) if re.match(f"[ \n{LETTERS}0-9{SIGNS}]", chr(i))}
READ_IDS = 1 << 20  # ids of a shard that a reader holds
MAGIC = b"RLTOKEF1"
# width of an id, documents, documents with null key, ids, first key, offset of the boundaries, of the keys, magic
FOOTER = "<IQQQqQQ8s"
MANIFEST = "part int, seq int, path string, documents bigint, ids bigint"


class Known(dict):
    """Numbers of texts in the order in which they are met, and the ids each stands for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, text: str) -> int:
        self[text] = n = len(self)
        self.new.append(text)
        return n

    def numbers(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, texts), np.int64, len(texts))

    def add(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the new texts: each has ``lengths`` of them from its place in ``starts`` on."""
        self.starts = np.concatenate([self.starts, len(self.ids) + starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.new = []

    def spread(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts with these numbers, one after the other, and how many each has."""
        lengths = self.lengths[at]
        stops = np.cumsum(lengths)
        places = np.arange(int(stops[-1]) if len(stops) else 0)
        return self.ids[places + np.repeat(self.starts[at] - stops + lengths, lengths)], lengths


class WordTokenizer:
    """Whole texts to ids with a byte-level BPE vocabulary of the tokenizers library."""

    def __init__(self, path: str, known: int = KNOWN_WORDS) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        # one character of a byte-level token stands for one byte
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.known = known
        self.blank = re.compile(r"(?<=\S) (?=\S)")
        self.words, self.pieces = Known(), Known()
        self.cuttable = self._cuttable()
        if self.cuttable:
            from tokenizers import pre_tokenizers

            one = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.byte_level = {ord(c): one.pre_tokenize_str(c)[0][0] for c in PLAIN_CHARACTERS}
            self.of_pieces = Tokenizer.from_file(path)
            self.of_pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")

    def _cuttable(self) -> bool:
        """Does the vocabulary cut texts as :data:`PIECE` does, and hold no added token of plain characters alone?"""
        import json

        made = json.loads(self.tokenizer.to_str())
        cut = made["pre_tokenizer"] or {}
        added = [t["content"] for t in made["added_tokens"]]
        return (
            made["normalizer"] is None and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
            and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
            and all(set(x) - PLAIN_CHARACTERS for x in added)
        )

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Encode new pieces, none of which the vocabulary cuts further."""
        parts, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first in range(0, len(pieces), JOINED):
            joined = "\0".join(pieces[first : first + JOINED]).translate(self.byte_level)
            stops = np.flatnonzero(np.frombuffer((joined + "\0").encode("utf-32-le"), "<u4") == 0)
            ids = np.array(self.of_pieces.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), stops - np.arange(len(stops))) + 1
            parts.append(ids)
            lengths.append(np.diff(cuts, prepend=0))
        sizes = np.concatenate(lengths)
        self.pieces.add(np.concatenate(parts), np.cumsum(sizes) - sizes, sizes)

    def _learn(self, words: list[str]) -> None:
        """Encode new words without blanks in them, each with the blank before it.

        Words of common characters are looked up by their pieces, so that a word with a comma behind it is not encoded
        again. Words that may not be encoded by themselves get no ids.
        """
        fits = [m is not None for m in map(PLAIN_WORD.fullmatch, words)] if self.cuttable else [False] * len(words)
        plain_at = [i for i, word in enumerate(words) if not fits[i] and word and word.strip() == word]
        plain = [words[i] for i in plain_at]
        if len(self.pieces) > self.known:
            self.pieces = Known()
        # one call for all words: a blank belongs to the first piece of the word behind it
        cut = PIECE.findall("".join([" " + word for word in compress(words, fits)]))
        at = self.pieces.numbers(cut)
        if self.pieces.new:
            self._learn_pieces(self.pieces.new)
        ids, of_piece = self.pieces.spread(at)
        firsts = np.flatnonzero(np.fromiter((p[0] == " " for p in cut), bool, len(cut)))
        of_cut = np.add.reduceat(of_piece, firsts) if len(cut) else of_piece
        parts, lengths = [ids], [of_cut]
        for first in range(0, len(plain), JOINED):
            joined = " " + " ".join(plain[first : first + JOINED])
            data = np.frombuffer(joined.encode(), np.uint8)
            stops = np.append(np.flatnonzero(data == 32)[1:], len(data))
            ids = self._raw([joined])[0]
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), stops) + 1
            parts.append(ids)
            lengths.append(np.diff(cuts, prepend=0))
        found, order = np.concatenate(lengths), np.concatenate([np.flatnonzero(fits), np.array(plain_at, np.int64)])
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[order], sizes[order] = np.cumsum(found) - found, found
        self.words.add(np.concatenate(parts), starts, sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [text.split(" ") for text in texts]
        words = [w for p in pieces for w in p[1:]]
        if len(self.words) > self.known:
            self.words = Known()
        at = self.words.numbers(words)
        if self.words.new:
            self._learn(self.words.new)
        flat, lengths = self.words.spread(at)
        counts = np.cumsum([0, *(len(p) - 1 for p in pieces)])
        ends = np.concatenate([[0], np.cumsum(lengths)])[counts]
        odd = np.concatenate([[0], np.cumsum(lengths == 0)])[counts]
        firsts = self._raw([p[0] for p in pieces])
        out = []
        for i, (text, first) in enumerate(zip(texts, firsts)):
            if odd[i] < odd[i + 1] or pieces[i][0] != pieces[i][0].strip() or (not pieces[i][0] and text):
                # other white space beside a blank: cut at the safe blanks only, without remembering
                out.append(np.concatenate(self._raw(self._cut(text))))
            else:
                out.append(np.concatenate([first, flat[ends[i] : ends[i + 1]]]))
        return out

    def _cut(self, text: str) -> list[str]:
        """Pieces of bounded size where possible, each with the blank before it."""
        parts, joined, size = [], [], 0
        for k, piece in enumerate(self.blank.split(text)):
            joined.append(" " + piece if k else piece)
            size += len(piece) + 1
            if size > 4096:
                parts.append("".join(joined))
                joined, size = [], 0
        return [*parts, "".join(joined)]


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, with the words it has met: Spark reuses workers for many tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("_rowloom_worker", types.ModuleType("_rowloom_worker")).__dict__
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


class ShardWriter:
    """One shard file: ids as they come, the rest when it is closed."""

    def __init__(self, folder: str, name: str, width: int) -> None:
        self.path, self.out = new_file(folder, name)
        self.width, self.ends, self.keys, self.nulls, self.count = width, [], [], 0, 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.count += len(ids)
        self.ends.append(self.count)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def close(self) -> tuple[str, int, int]:
        base = self.keys[0] if self.keys else 0
        boundaries = encode(np.array(self.ends, np.uint64))
        keys = encode(np.array([k - base for k in self.keys], np.uint64))
        at = self.count * self.width
        self.out.write(boundaries)
        self.out.write(keys)
        self.out.write(struct.pack(FOOTER, self.width, len(self.ends), self.nulls, self.count, base, at, at + len(boundaries), MAGIC))
        self.out.close()
        return self.path, len(self.ends), self.count


class Shard:
    """A shard file, read in parts."""

    def __init__(self, path: str) -> None:
        system, place = locate(path)
        self.file = system.open_input_file(place)
        size = struct.calcsize(FOOTER)
        footer = self.file.read_at(size, self.file.size() - size)
        (self.width, self.documents, self.nulls, self.ids, self.base, bounds, keys, magic) = struct.unpack(FOOTER, footer)
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.ends = EliasFano(lambda at, n: self.file.read_at(n, bounds + at))
        self.gaps = EliasFano(lambda at, n: self.file.read_at(n, keys + at))

    def read(self, first: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - first) * self.width, first * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """Key and ids of the i-th document, found by select."""
        key = None if i < self.nulls else self.base + self.gaps[i - self.nulls]
        return key, self.read(self.ends[i - 1] if i else 0, self.ends[i])

    def all_documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, start and ids of every document, by blocks of bounded size."""
        ends = self.ends.all().astype(np.int64)
        keys: list[int | None] = [None] * self.nulls + [self.base + int(g) for g in self.gaps.all()]
        i = 0
        while i < len(ends):
            start = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, start + READ_IDS, side="right")))
            block = self.read(start, int(ends[j - 1]))
            for k in range(i, j):
                first = int(ends[k - 1]) if k else 0
                yield keys[k], first, block[first - start : int(ends[k]) - start]
            i = j

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, tokenizer: str, target: str | None = None, key: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all texts as shards below ``target``; returns the manifest, which is a table in the shared folder."""
    spark = docs.sparkSession
    folder = target or scratch_path(spark, "tokens")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, shard, done = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            words = words or worker_tokenizer(tokenizer)
            width = 2 if max(words.size, end_id + 1) <= 1 << 16 else 4
            for first, end in text_slices(texts):
                for key_, ids in zip(keys[first:end], words.encode(texts[first:end])):
                    shard = shard or ShardWriter(folder, f"shard-{part:06d}-{len(done):04d}", width)
                    shard.add(key_, np.append(ids, np.uint32(end_id)))
                    if shard.count >= shard_ids:
                        done.append(shard.close())
                        shard = None
        if shard:
            done.append(shard.close())
        if done:
            paths, documents, ids = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32()), pa.array(paths),
                 pa.array(documents, pa.int64()), pa.array(ids, pa.int64())],
                names=["part", "seq", "path", "documents", "ids"],
            )

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(parts, "key").sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    return written(map_batches(dealt, store, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document, read from the shards of ``manifest``.

    ``start`` counts the ids of all documents before it in key order.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one small row per shard
    shards = manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("bigint")))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, rows = Shard(path), []
                for key_, start, ids in shard.all_documents():
                    rows.append((key_, offset + start, len(ids), zlib.crc32(ids.tobytes())))
                shard.close()
                columns = zip(*rows) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 names=["key", "start", "n_tokens", "ids_crc32"])

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = shards.select("path", "before").repartition(parts)
    return map_batches(rows, load, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("key", key)


def documents_of(spark: SparkSession, paths: list[str]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a few shards, for looking into them."""
    for path in paths:
        shard = Shard(path)
        for i in range(shard.documents):
            yield shard.document(i)
        shard.close()
