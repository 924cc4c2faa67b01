"""Benchmark decontamination by edit distance, with the pigeonhole principle.

Texts and test items are compared as words (runs of letters, digits and ``_``) in lower case with single blanks.
An item of m characters may be changed in k = floor(rate * m) places. Cut into k + 1 pieces, at least one piece of
a match is unchanged, so every match holds an exact piece. One Aho-Corasick automaton finds the pieces of all
items in one pass over a text; around each hit Myers' bit-parallel algorithm gives the smallest edit distance of the
item to a passage of the text, and where that passage ends.

The items are the stated query set: they are taken in blocks of bounded size, each block against all texts, without
a shuffle. Texts of any length are read whole, and windows that overlap are checked as one, so the work for a text
is bounded by its length times the items whose pieces it holds.

Defined results: a null text counts as empty; an item without words matches nothing; an item shorter than
1 / rate characters must occur unchanged, as whole words. Repeated ids are judged row by row; of an item that occurs
several times in a text, the match with the smallest distance is reported, the first of equal ones. Ids must be whole
numbers or null. Texts of any length are searched whole. An empty table of documents or items gives no matches. Other
columns are ignored by ``contaminated`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.components import written
from rowloom.llm.text import map_batches

RATE = 0.05
# Characters of items in one block: bounds what a task holds.
BLOCK_CHARS = 4 << 20

NO_WORD = re.compile(r"\W+")


def normal(text: str | None) -> str:
    """Words in lower case, with one blank before, between and after them; empty without words."""
    words = NO_WORD.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def budget_of(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of about equal length with their offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_end(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any passage of ``text``, and the first place such a one ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = down | ~(horizontal | up) & full
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score < best:
            best, end = score, j
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
    return best, end


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float) -> None:
        import ahocorasick

        self.ids: dict[str, list[int | None]] = defaultdict(list)
        for key, text in items:
            if plain := normal(text):
                self.ids[plain].append(key)
        self.items = list(self.ids)
        self.budgets = [budget_of(x, rate) for x in self.items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            for offset, piece in pieces(item, self.budgets[i]):
                places[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}

    def _verify(self, i: int, text: str, windows: list[list[int]]) -> tuple[int, int, int] | None:
        item, budget = self.items[i], self.budgets[i]
        if i not in self.masks:
            self.masks[i] = char_masks(item), char_masks(item[::-1])
        best = None
        for first, end in windows:
            part = text[first:end]
            at = part.find(item)
            if at >= 0:
                distance, start, stop = 0, first + at, first + at + len(item)
            else:
                distance, last = best_end(self.masks[i][0], len(item), part)
                if distance > budget:
                    continue
                back = part[max(0, last - len(item) - distance) : last][::-1]
                start, stop = first + last - best_end(self.masks[i][1], len(item), back)[1], first + last
            if best is None or distance < best[0]:
                best = distance, start, stop
            if distance == 0:
                break
        return best

    def matches(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """``(item id, distance, first word, last word)`` of every item that ``text`` holds."""
        plain = normal(text)
        if not plain or not self.items:
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for last, (size, where) in self.automaton.iter(plain):
            for i, offset in where:
                starts[i].append(last + 1 - size - offset)
        found = []
        for i, at in starts.items():
            budget, size, windows = self.budgets[i], len(self.items[i]), []
            for s in sorted(set(at)):
                first, end = max(0, s - budget), min(len(plain), s + size + budget)
                if windows and first <= windows[-1][1]:
                    windows[-1][1] = end
                else:
                    windows.append([first, end])
            if hit := self._verify(i, plain, windows):
                distance, start, stop = hit
                first_word = len(plain[:start].split())
                words = len(plain[start:stop].split())
                found += [(key, distance, first_word, first_word + max(words, 1) - 1) for key in self.ids[self.items[i]]]
        return found


def blocks(benchmark: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items in lists of at most ``block_chars`` characters (or one longer item)."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.select(F.col(key).cast("bigint"), text).toLocalIterator():
        if block and size + len(row[1] or "") > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1] or ""))
        size += len(row[1] or "")
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(key, item_key, distance, first_word, last_word)`` of every item in every text."""
    schema = f"`{key}` bigint, `{item_key}` bigint, distance int, first_word int, last_word int"
    rows = docs.select(F.col(key).cast("bigint"), F.col(text).alias("_llm_input"))

    def search(items: list[tuple[int | None, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                found = [
                    (k, *match)
                    for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for match in matcher.matches(x)
                ]
                if found:
                    k, item, distance, first, last = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k, pa.int64()), pa.array(item, pa.int64()), pa.array(distance, pa.int32()),
                         pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                        names=[key, item_key, "distance", "first_word", "last_word"],
                    )

        return map_batches(rows, work, schema)

    out, held = None, None
    for items in blocks(benchmark, item_key, item_text, block_chars):
        if held is not None:  # more than one block: each is done before the next one is read
            done = written(search(held), "contaminated")
            out = done if out is None else out.unionByName(done)
        held = items
    if held is None:
        return docs.sparkSession.createDataFrame([], schema)
    last = search(held)
    return last if out is None else out.unionByName(last)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
          rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no shuffle."""
    place = docs.columns.index(text)

    def drop(kept: DataFrame, items: list[tuple[int | None, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(x) for x in batch.column(place).to_pylist()], pa.bool_()))

        return map_batches(kept, work, docs.schema)

    kept, first = docs, True
    for items in blocks(benchmark, item_key, item_text, block_chars):
        kept = drop(kept if first else written(kept, "clean"), items)
        first = False
    return kept
