"""SimHash near-duplicates: a self-join of the binary trie of all fingerprints.

A fingerprint bit is 1 if it is set in more than half of the XXH64 hashes (seed 42) of a text's word shingles,
repeats included. Two fingerprints link if they differ in at most ``max_bits`` bits.

The join walks the trie against itself: a pair of nodes carries the bits in which their paths differ, and is
dropped as soon as that number exceeds the budget. To spread the walk, the bits are cut into ``max_bits + 1``
blocks; two fingerprints that link agree in one block at least, so for each block the bits are rotated to put
it first, and the walk below each value of the block is a piece of work of its own. Every distinct fingerprint
counts once, so groups of copies do not grow the work. A piece with more than ``CELL`` fingerprints is cut by
walking four more levels in Spark, or all levels on which its nodes have one child: each pair of nodes below it that
are there and within the budget becomes a piece. Texts with one fingerprint but different check words cannot be cut
by it. Walked, very many of them would be handed on level by level once for each node near them, so a fingerprint of more
than a quarter of ``CELL`` texts does not take part in the walk: its texts are a piece, and so are they and all texts
within the budget of it. Above ``CELL`` such pieces are cut into ranges, and each pair of ranges is a piece. So a text is
dealt once more for each such fingerprint near it, and one that has it once per range of the others. Pieces
hand on the links of a spanning forest, at most one per fingerprint, so that groups of near copies do not
emit all their pairs; components over these reach the same documents as all links would.

A text can have several fingerprints, from differently mixed hashes: the tries of all are walked side by side, and
two texts link if any of their fingerprints do. With ``check`` words, which are further fingerprints, the two
must also differ in at most ``check_bits`` bits over all of these. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
in lower case.

Defined results: a null text counts as empty; fewer words than a shingle make one shingle of all; no word
gives fingerprint zero, which links like any other. Repeated ids are rows of their own that share a class by
their texts; a null id is never the smallest of a class unless the class has no other. Texts of any length are taken
whole. An empty table gives no rows. Columns other than id and text are ignored by ``classes`` and kept by
``representatives``, which joins by names that no column of its input should have (``_llm_key, _llm_hash, _llm_rows``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.components import components, discard, written
from rowloom.llm.text import BASE, MIX_A, map_batches, mix
from rowloom.session import checked_broadcast

SEED = 42
BITS = 64
CELL = 1 << 16  # fingerprints that one walk takes at most
SPLIT_BITS = 4  # levels walked at once when a piece is cut
HOT_CLASS = 1024  # a class with more points is not gathered by its root
DENSE = 4096  # node pairs with more row pairs are compared in blocks


@dataclass(frozen=True)
class Fingerprint:
    """How texts are fingerprinted: shingles of ``words`` words, or the different ``long`` words alone.

    Frequent words are short; without them and without repeats, texts of one language have little in common.
    ``count`` fingerprints of 64 bits are made: the first from the hashes, the others from hashes mixed anew.

    With ``window`` each fingerprint is that of as many words of the text only: those from the place where two words
    following each other have the smallest hash, mixed anew for each fingerprint. Texts that share most of their word
    pairs mostly choose the same place, wherever words were added, cut off or changed, and there differ in few bits or
    none. So a small budget finds them, and unrelated texts seldom meet.
    """

    words: int = 3
    long: int = 0  # bytes of a long word; 0: all words and repeats
    count: int = 1
    window: int = 0  # words of a chosen part; 0: the whole text


def fingerprint(text: str | None, kind: Fingerprint) -> list[int]:
    """The fingerprints of one text."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return [0] * kind.count
    if kind.window:
        return _window_prints(parts, kind)
    if kind.long:
        different = set(parts)
        parts = [w for w in different if len(w) >= kind.long] or list(different)
    plain = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(kind.words, len(parts)) - 1
    digest = xxhash.xxh64_intdigest
    view = memoryview(plain)
    pairs = zip(starts[: len(parts) - span].tolist(), ends[span:].tolist())
    hashes = np.array([digest(view[s:e], SEED) for s, e in pairs], "<u8")
    total = np.zeros((kind.count, BITS), np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)]
        for i in range(kind.count):
            own = mix(part + np.uint64(i * MIX_A % 2**64)) if i else part
            total[i] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view("<u8").ravel().tolist()


def _window_prints(parts: list[bytes], kind: Fingerprint) -> list[int]:
    """A fingerprint of each window that a smallest hash of two words chooses."""
    import xxhash

    numbers = {word: i for i, word in enumerate(dict.fromkeys(parts))}
    hashes = np.array([xxhash.xxh64_intdigest(word, SEED) for word in numbers], np.uint64)
    own = hashes[[numbers[word] for word in parts]]
    pairs = own.copy()
    pairs[:-1] = own[:-1] * np.uint64(BASE) + own[1:]
    out = []
    for i in range(kind.count):
        first = int(np.argmin(mix(pairs ^ np.uint64((i + 1) * MIX_A % 2**64))))
        part = own[first : first + kind.window].astype("<u8")
        total = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out += np.packbits(2 * total > len(part), bitorder="little").view("<u8").tolist()
    return out


def fingerprints(docs: DataFrame, key: str, text: str, kinds: list[Fingerprint]) -> DataFrame:
    """``(key, fp0, fp1, ...)`` as signed 64-bit numbers, a column per fingerprint of each kind; no shuffle."""
    names = [f"fp{i}" for i in range(sum(k.count for k in kinds))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made = np.array([[f for k in kinds for f in fingerprint(x, k)] for x in texts], np.uint64)
            made = made.reshape(len(texts), len(names)).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(made[:, i])) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    fields = ", ".join(f"{n} bigint" for n in names)
    return map_batches(docs.select(key, F.col(text).alias("_llm_input")), work, f"`{key}` {kind}, {fields}")


def rotated(value: np.ndarray, by: np.ndarray) -> np.ndarray:
    """64-bit values rotated to the left."""
    by = by.astype(np.uint64)
    return np.where(by == 0, value, (value << by) | (value >> ((np.uint64(64) - by) & np.uint64(63))))


class Forest:
    """The trees that links have joined so far: rows of one point, and points of one tree, need no further link."""

    def __init__(self, points: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        self.ids, self.point = np.unique(points, return_inverse=True)
        self.root = np.arange(len(self.ids))
        self.keep = keep

    def joined(self, a0: int, a1: int, b0: int, b1: int) -> bool:
        """Whether the rows of both ranges are in one tree already."""
        one = self.root[self.point[a0]]
        return bool((self.root[self.point[a0:a1]] == one).all() and (self.root[self.point[b0:b1]] == one).all())

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link the rows ``i`` with the rows ``j``, those that ``keep`` says."""
        apart = self.root[self.point[i]] != self.root[self.point[j]]
        i, j = i[apart], j[apart]
        if self.keep is not None and len(i):
            good = self.keep(i, j)
            i, j = i[good], j[good]
        if not len(i):
            return
        trees, place = np.unique(self.root[self.point[np.concatenate([i, j])]], return_inverse=True)
        lower = np.arange(len(self.ids))
        lower[trees] = trees[_forest(place[: len(i)], place[len(i) :], len(trees))]
        self.root = lower[self.root]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Every point that is not the smallest of its tree, behind that one."""
        leaf = self.root != np.arange(len(self.ids))
        return self.ids[self.root[leaf]], self.ids[leaf]


def trie_links(values: np.ndarray, cell: np.ndarray, side: np.ndarray, depth: np.ndarray, budget: np.ndarray,
               forest: Forest) -> None:
    """Add the pairs of rows within the budget of their cell to ``forest``, by walking pairs of trie nodes.

    A cell's values share their first ``depth`` bits on each side; ``side`` is 0 for a cell that is joined
    with itself, else 1 or 2. Rows must be sorted by cell, side and value, so that a trie node is a range.
    Where the budget is too large for the levels below a node pair to drop much, its rows are compared at once.
    """
    cuts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])]))
    ends = np.append(cuts[1:], len(values))
    own = side[cuts] == 0
    match = np.zeros(len(cuts), bool)
    match[:-1] = (cell[cuts[1:]] == cell[cuts[:-1]]) & ~own[:-1]
    first = np.flatnonzero(match)
    # a node pair: two ranges of rows, their depth and the bits left; the same range twice for a node with itself
    a0 = np.concatenate([cuts[own], cuts[first]])
    a1 = np.concatenate([ends[own], ends[first]])
    b0 = np.concatenate([cuts[own], cuts[first + 1]])
    b1 = np.concatenate([ends[own], ends[first + 1]])
    level, left = depth[a0].copy(), budget[a0].copy()
    while len(a0):
        same = a0 == b0
        size = (a1 - a0) * (b1 - b0)
        live = (left >= 0) & ~(same & (a1 - a0 < 2)) & (size > 0)
        # the budget left is for the bits below the node; those above have been paid for
        below = (BITS - level).astype(np.uint64)
        mask = np.where(below >= 64, np.uint64(2**64 - 1), (np.uint64(1) << (below & np.uint64(63))) - np.uint64(1))
        narrow = np.log2(np.maximum(np.minimum(a1 - a0, b1 - b0), 1))
        done = live & ((size <= 64) | (level >= BITS) | (2 * left >= narrow))
        small = done & (size <= DENSE)
        if small.any():
            for i, j, node in _row_pairs(a0[small], a1[small], b0[small], b1[small]):
                ok = (i != j) & (~same[small][node] | (i < j))
                i, j, node = i[ok], j[ok], node[ok]
                near = np.bitwise_count((values[i] ^ values[j]) & mask[small][node]) <= left[small][node]
                forest.add(i[near], j[near])
        for n in np.flatnonzero(done & ~small).tolist():
            _dense_pairs(values, int(a0[n]), int(a1[n]), int(b0[n]), int(b1[n]), mask[n], int(left[n]), forest)
        go = np.flatnonzero(live & ~done)
        a0, a1, b0, b1, level, left, same = a0[go], a1[go], b0[go], b1[go], level[go], left[go], same[go]
        if not len(go):
            break
        bit = np.uint64(1) << (np.uint64(63) - level.astype(np.uint64))
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        cross = ~same
        a0, a1, b0, b1, level, left = (
            np.concatenate(x)
            for x in (
                (a0, am, a0, am[cross]),
                (am, a1, am, a1[cross]),
                (b0, bm, bm, b0[cross]),
                (bm, b1, b1, bm[cross]),
                (level + 1, level + 1, level + 1, (level + 1)[cross]),
                (left, left, left - 1, (left - 1)[cross]),
            )
        )


def _dense_pairs(values: np.ndarray, a0: int, a1: int, b0: int, b1: int, mask: np.uint64, left: int, forest: Forest,
                 step: int = 512) -> None:
    """Add the pairs of two ranges of rows that differ in at most ``left`` bits of ``mask``, block by block."""
    right = values[b0:b1] & mask
    for i0 in range(a0, a1, step):
        i1 = min(i0 + step, a1)
        own = (values[i0:i1] & mask)[:, None]
        for j0 in range(i0 if a0 == b0 else b0, b1, step):
            j1 = min(j0 + step, b1)
            if forest.joined(i0, i1, j0, j1):
                continue
            i, j = np.nonzero(np.bitwise_count(own ^ right[None, j0 - b0 : j1 - b0]) <= left)
            if i0 == j0:
                i, j = i[i < j], j[i < j]
            forest.add(i + i0, j + j0)


def _row_pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray,
               limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of rows of each node pair and the node pair's index, in pieces of bounded size."""
    # a node pair with many rows of equal value is cut into row ranges first
    wide = np.maximum(b1 - b0, 1)
    step = np.maximum(1, limit // wide)
    parts = -(-(a1 - a0) // step)
    node = np.repeat(np.arange(len(a0)), parts)
    nth = np.arange(len(node)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = a0[node] + nth * step[node]
    count = (np.minimum(first + step[node], a1[node]) - first) * wide[node]
    total = np.cumsum(count)
    at = 0
    while at < len(node):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        n = count[at:end]
        piece = np.repeat(np.arange(at, end), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield first[piece] + place // wide[node[piece]], b0[node[piece]] + place % wide[node[piece]], node[piece]
        at = end


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First row of each range whose ``bit`` is set: where the node's two children meet."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (values[np.minimum(mid, len(values) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(points: DataFrame, max_bits: int, check_bits: int = 0, cell_rows: int = CELL) -> DataFrame:
    """A spanning forest ``(a, b)`` of the links between ``points(id, fp[, fp..., check...])``, distinct but for the id.

    All columns that begin with ``fp`` are fingerprints, all that begin with ``check`` are check words.
    """
    blocks = max_bits + 1
    starts = [BITS * i // blocks for i in range(blocks + 1)]
    prints = [c for c in points.columns if c.startswith("fp")]
    checks = [c for c in points.columns if c.startswith("check")]
    carried = ["id", *checks]
    cell_columns = ["cell", "side", "depth", "budget", "value", *carried]
    cells_schema = "cell string, side int, depth int, budget int, value bigint, " + ", ".join(f"{c} bigint" for c in carried)

    hot = _hot_values(points, prints, cell_rows // 4)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = batch.columns[len(prints) :]

            def emit(rows: np.ndarray, cell: list[str], side: int, depth: int, budget: int, value: np.ndarray) -> pa.RecordBatch:
                numbers = (pa.array(np.full(len(rows), x, np.int32)) for x in (side, depth, budget))
                return pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.string()), *numbers, pa.array(value.view(np.int64)), *(c.take(pa.array(rows)) for c in more)],
                    names=cell_columns,
                )

            for trie in range(len(prints)):
                value = batch.column(trie).to_numpy().view(np.uint64)
                common = np.isin(value, hot[trie])
                for h in hot[trie]:
                    # what has the fingerprint, and what is near it; of two such fingerprints the smaller one has the pair
                    mine = np.flatnonzero(value == h)
                    near = np.flatnonzero((np.bitwise_count(value ^ h) <= max_bits) & (value != h) & (~common | (value > h)))
                    for rows, kind, side in ((mine, "=", 0), (mine, "~", 1), (near, "~", 2)):
                        if len(rows):
                            yield emit(rows, [f"{trie}:0:{kind}{h:x}"] * len(rows), side, BITS, 0, value[rows])
                rows = np.flatnonzero(~common)
                if not len(rows):
                    continue
                for block in range(blocks):
                    depth = starts[block + 1] - starts[block]
                    turned = rotated(value[rows], np.full(len(rows), starts[block]))
                    head = (turned >> np.uint64(64 - depth)).tolist()
                    yield emit(rows, [f"{trie}:{block}:{x:x}" for x in head], 0, depth, max_bits, turned)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = len(cell_columns)
        for batch in batches:
            cell = batch.column(0)
            side, depth, budget = (batch.column(i).to_numpy() for i in (1, 2, 3))
            value = batch.column(4).to_numpy().view(np.uint64)
            # what the cell holds on both sides; a cell that is joined with itself has one side
            n1, n2, has1, has2, and1, and2, or1, or2 = (
                batch.column(wide + i).to_numpy(zero_copy_only=False) for i in range(len(SHAPE))
            )
            own = side == 0
            n2, has2, and2, or2 = (np.where(own, x, y) for x, y in ((n1, n2), (has1, has2), (and1, and2), (or1, or2)))
            and1, and2, or1, or2 = (x.astype(np.int64).view(np.uint64) for x in (and1, and2, or1, or2))

            def emit(rows: np.ndarray, name: list[str], side: np.ndarray, depth: np.ndarray,
                     budget: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pc.binary_join_element_wise(cell.take(pa.array(rows)), pa.array(name, pa.string()), ""),
                     *(pa.array(x.astype(np.int32)) for x in (side, depth, budget)),
                     *(c.take(pa.array(rows)) for c in batch.columns[4:wide])],
                    names=cell_columns,
                )

            # Levels on which each side has one child are walked at once.
            below = (np.uint64(1) << np.minimum(BITS - depth, BITS - 1).astype(np.uint64)) - np.uint64(1)
            vary = ((and1 ^ or1) | (and2 ^ or2)) & below
            for shift in (1, 2, 4, 8, 16, 32):
                vary |= vary >> np.uint64(shift)
            next_depth = BITS - np.bitwise_count(vary).astype(np.int64)
            left = budget - np.bitwise_count((and1 ^ and2) & below & ~vary).astype(np.int64)
            equal = depth >= BITS
            straight = ~equal & ((next_depth - depth >= SPLIT_BITS) | (next_depth == BITS))
            rows = np.flatnonzero(straight & (left >= 0))
            if len(rows):
                yield emit(rows, [""] * len(rows), side[rows], next_depth[rows], left[rows])

            # One fingerprint on each side: ranges of rows against each other, in the first block that has the pair.
            rows = np.flatnonzero(equal)
            if len(rows):
                # pieces of common fingerprints are of no block but the first
                block = np.array([int(c.split(":")[1]) for c in cell.take(pa.array(rows)).to_pylist()])
                differ = rotated((and1 ^ and2)[rows], (BITS - np.array(starts)[block]) % BITS)
                seen = np.zeros(len(rows), bool)
                for b in range(blocks):
                    bits = ((1 << (starts[b + 1] - starts[b])) - 1) << (BITS - starts[b + 1])
                    seen |= (b < block) & (differ & np.uint64(bits) == 0)
                rows = rows[~seen]
            if len(rows):
                groups = [-(-2 * n[rows] // cell_rows) for n in (n1, n2)]
                right, alone = side[rows] == 2, own[rows]
                ids = batch.column(5).to_numpy().view(np.uint64)[rows]
                group = (mix(ids) % np.where(right, groups[1], groups[0]).astype(np.uint64)).astype(np.int64)
                partners = np.where(right, groups[0], groups[1])
                for h in range(int(partners.max())):
                    some = partners > h
                    mine, at = group[some], rows[some]
                    second = np.where(alone[some], mine > h, right[some])
                    x, y = np.where(second, h, mine), np.where(second, mine, h)
                    new = np.where(alone[some] & (mine == h), 0, np.where(second, 2, 1))
                    name = [f"/{a}-{b}" for a, b in zip(x.tolist(), y.tolist())]
                    yield emit(at, name, new, np.full(len(at), BITS + 1), budget[at])

            bits = np.minimum(SPLIT_BITS, BITS - depth)
            child = ((value >> (BITS - depth - bits).astype(np.uint64)) & ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            there = np.where(side == 2, has1, has2).astype(np.int64)
            for flip in range(1 << SPLIT_BITS):
                rows = np.flatnonzero(~straight & ~equal & (budget >= flip.bit_count()) & (flip < (1 << bits)) & ((there >> (child ^ flip)) & 1 == 1))
                if not len(rows):
                    continue
                mine, other, old = child[rows], child[rows] ^ flip, side[rows]
                right = (old == 2) | ((old == 0) & (other < mine))
                x, y = np.where(right, other, mine), np.where(right, mine, other)
                new = np.where(old != 0, old, 0 if flip == 0 else np.where(right, 2, 1))
                name = [f"/{a:x}.{b:x}" for a, b in zip(x.tolist(), y.tolist())]
                yield emit(rows, name, new, (depth + bits)[rows], budget[rows] - flip.bit_count())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by cell, side and unsigned value; whole cells are gathered to a bounded number.
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            value = table.column("value").to_numpy().view(np.uint64)
            cell = table.column("cell").combine_chunks().dictionary_encode()
            cell = (cell.combine_chunks() if isinstance(cell, pa.ChunkedArray) else cell).indices.to_numpy()
            side, depth, budget = (table.column(c).to_numpy() for c in ("side", "depth", "budget"))
            check = [table.column(c).to_numpy().view(np.uint64) for c in checks]

            def agree(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int64) for c in check) <= check_bits

            forest = Forest(table.column("id").to_numpy(), agree if check else None)
            trie_links(value, cell, side, np.minimum(depth, BITS).astype(np.int64), budget.astype(np.int64), forest)
            a, b = forest.links()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def whole_cells(last: bool) -> pa.Table | None:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            if last:
                held = []
                return table
            cell = table.column("cell").to_pylist()
            end = len(cell)
            while end and cell[end - 1] == cell[-1]:
                end -= 1
            if not end:
                return None
            rest = table.slice(end).combine_chunks().to_batches()
            held = rest
            return table.slice(0, end)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * cell_rows and (ready := whole_cells(False)) is not None:
                yield solve(ready)
        if held and (ready := whole_cells(True)) is not None and ready.num_rows:
            yield solve(ready)

    work = map_batches(points.select(*prints, *carried), deal, cells_schema)
    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out, past = None, []
    while work is not None:
        one, two = F.col("side") < 2, F.col("side") == 2
        sizes = work.groupBy("cell").agg(
            F.count(F.lit(1)).alias("rows"), F.min("depth").alias("at"), F.min("side").alias("least"),
            F.count_if(one).alias("n1"), F.count_if(two).alias("n2"),
        )
        large = written(sizes.filter((F.col("rows") > cell_rows) & (F.col("at") <= BITS)), "large")
        # A large piece has many rows, so there are few of them: at most all rows / cell_rows.
        small = work if large.isEmpty() else work.join(large.select("cell"), "cell", "left_anti")
        # A cell without rows on its other side has no pairs.
        large = large.filter((F.col("least") == 0) | ((F.col("n1") > 0) & (F.col("n2") > 0))).select("cell", "n1", "n2")
        done, past = past, []
        if large.isEmpty():
            work = None
        else:
            rest = work.join(large.select("cell"), "cell", "left_semi").select(*_columns(cells_schema)).repartition(parts)
            rest = written(rest, "rest")
            shape = written(rest.groupBy("cell").agg(
                *[F.coalesce(F.bit_or(F.when(on, F.expr(CHILD))), F.lit(0)).alias(n) for n, on in (("has1", one), ("has2", two))],
                *[F.coalesce(sum_(F.when(on, F.col("value"))), F.lit(0)).alias(f"{n}{i}")
                  for n, sum_ in (("and", F.bit_and), ("or", F.bit_or)) for i, on in ((1, one), (2, two))],
            ).join(large, "cell"), "shape")
            shaped = rest.join(shape, "cell").select(*_columns(cells_schema), *[F.col(c).cast("bigint") for c in SHAPE])
            work = written(map_batches(shaped, cut, cells_schema), "cells")
            past = [work]
            done += [rest, shape]
        # The sign bit flipped makes the order of signed numbers that of unsigned ones.
        order = F.col("value").bitwiseXOR(F.lit(-(2**63)).cast("bigint"))
        dealt = small.select(*_columns(cells_schema)).repartition("cell").sortWithinPartitions("cell", "side", order)
        pairs = written(map_batches(dealt, join, "a bigint, b bigint"), "pairs")
        out = pairs if out is None else out.unionByName(pairs)
        discard(points, [file.rsplit("/", 1)[0] for table in done for file in table.inputFiles()[:1]])
    return out


def _hot_values(points: DataFrame, prints: list[str], most: int) -> list[np.ndarray]:
    """Of each trie the fingerprints that more than ``most`` points have: at most all points / ``most``."""
    each = points.select(F.posexplode(F.array(*prints)).alias("trie", "value"))
    found = each.groupBy("trie", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).collect()
    return [np.sort(np.array([r["value"] for r in found if r["trie"] == t], np.int64).view(np.uint64)) for t in range(len(prints))]


# What a large cell holds on each side: rows, children over the next levels as a bit set, bits all values have, any has.
SHAPE = ["n1", "n2", "has1", "has2", "and1", "and2", "or1", "or2"]
CHILD = (f"shiftleft(1L, cast(shiftrightunsigned(value, {BITS} - depth - least({SPLIT_BITS}, {BITS} - depth))"
         f" & (shiftleft(1, least({SPLIT_BITS}, {BITS} - depth)) - 1) as int))")


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2,
            long: int = 0, tries: int = 1, check: Fingerprint | None = None, check_bits: int = 0, window: int = 0) -> DataFrame:
    """``(key, fp, component_id, text_hash, root)`` for every row: its first fingerprint, the smallest key it is linked
    to, and what tells rows and classes apart where ids repeat: the XXH64 of its text and a number of its class."""
    kinds = [Fingerprint(words, long, tries, window)] + ([check] if check else [])
    row = F.struct(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h")).alias("row")
    made = fingerprints(docs.select(row, F.col(text).alias("text")), "row", "text", kinds)
    prints = [c for c in made.columns if c != "row"]
    made = written(made.select(F.col("row.k").alias(key), F.col("row.h").alias("text_hash"), *prints), "fingerprints")
    points = made.groupBy(*prints).agg(F.min(key).alias("smallest"))
    # Any distinct number will do as the name of a point; it is written down with it.
    points = written(points.withColumn("id", F.monotonically_increasing_id()), "points")
    named = [f"{'fp' if i < tries else 'check'}{i}" for i in range(len(prints))]
    found = links(points.select("id", *[F.col(c).alias(n) for c, n in zip(prints, named)]), max_bits, check_bits)
    roots = components(found)
    rooted = points.join(roots, points["id"] == roots["node"], "left").select(
        *prints, "smallest", F.coalesce("root", "id").alias("root")
    )
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    # Classes of very many points are few (at most all points / HOT_CLASS): their rows stay where they are.
    hot = checked_broadcast(least.filter(F.col("n") > HOT_CLASS).select("root", "component_id"))
    cold = least.filter(F.col("n") <= HOT_CLASS).select("root", "component_id")
    classed = rooted.join(hot, "root").unionByName(rooted.join(hot.select("root"), "root", "left_anti").join(cold, "root"))
    classed = written(classed.select(*prints, "component_id", "root"), "classes")
    return made.join(classed, prints).select(key, F.col("fp0").alias("fp"), "component_id", "text_hash", "root")


def representatives(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class in ``found`` (of :func:`classes`) the row with the smallest key.

    All columns are kept, and one row per class stays. Of rows with that key in one class it is the one with the smallest
    hash of its text, then the smallest other columns; rows of one key in different classes stay side by side. A null
    key stays if its class has no other.
    """
    least = found.filter(F.col(key).eqNullSafe(F.col("component_id"))).groupBy("root", "text_hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("component_id").alias("k"))
    least = least.groupBy("root").agg(F.min(F.struct("text_hash", "n", "k")).alias("one"))
    counted = written(least.select(F.col("one.k").alias("_llm_key"), F.col("one.text_hash").alias("_llm_hash"),
                                   F.col("one.n").alias("_llm_rows")), "representatives")
    # The texts are dealt by key once, at any size; which rows stay is too much to be broadcast.
    same = F.col(key).eqNullSafe(F.col("_llm_key")) & (F.xxhash64(F.col(text)) == F.col("_llm_hash"))
    joined = docs.join(counted.hint("merge"), same)
    single = joined.filter("_llm_rows = 1").select(*[docs[c] for c in docs.columns])
    if counted.filter("_llm_rows > 1").isEmpty():
        return single
    plain = [f.name for f in docs.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "array", "struct", "variant")]
    row = F.min_by(F.struct(*docs.columns), F.struct(*plain)).alias("row")
    repeated = joined.filter("_llm_rows > 1").groupBy("_llm_key", "_llm_hash").agg(row)
    return single.unionByName(repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns]))
