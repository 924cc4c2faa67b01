"""Elias-Fano coding of non-decreasing whole numbers, with a select structure.

Of ``n`` numbers below ``u`` the low ``l = floor(log2(u / n))`` bits are stored as they are; the rest is a bit
vector of at most ``2 n`` bits with a one at ``high + index``: together 2 + l bits per number. The place of every
512th one is kept in 32 bits, so that the i-th number is found by reading one sample and a few words.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

SAMPLE = 512
HEAD = "<QQQQQ"  # numbers, low bits, bytes of the low part, of the high part, of the samples


def encode(values: np.ndarray) -> bytes:
    """``values`` (uint64, non-decreasing) as bytes."""
    n = len(values)
    if not n:
        return struct.pack(HEAD, 0, 0, 0, 0, 0)
    universe = int(values[-1]) + 1
    low_bits = max(0, (universe // n).bit_length() - 1)
    if low_bits:
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little").tobytes()
    else:
        low = b""
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    if ones[-1] >= 1 << 32:
        raise ValueError("too many numbers for 32-bit samples; write smaller shards")
    vector = np.zeros((int(ones[-1]) // 64 + 1) * 64, np.uint8)
    vector[ones] = 1
    high = np.packbits(vector, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    return struct.pack(HEAD, n, low_bits, len(low), len(high), len(samples)) + low + high + samples


class EliasFano:
    """Numbers read from where ``read(offset, size)`` gives bytes of the coded form, as far as they are needed."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self.read = read
        self.n, self.low_bits, low, high, samples = struct.unpack(HEAD, read(0, struct.calcsize(HEAD)))
        self.low_at = struct.calcsize(HEAD)
        self.high_at = self.low_at + low
        self.samples_at, self.high_size = self.high_at + high, high

    def __len__(self) -> int:
        return self.n

    def _select(self, i: int) -> int:
        """Place of the i-th one of the high part."""
        at = self.samples_at + 4 * (i // SAMPLE)
        place, rest = struct.unpack("<I", self.read(at, 4))[0], i % SAMPLE
        word, skip = place // 64, place % 64
        while True:
            block = np.frombuffer(self.read(self.high_at + 8 * word, min(512, self.high_size - 8 * word)), "<u8").copy()
            block[0] &= np.uint64((2**64 - 1) << skip & (2**64 - 1))
            counts = np.cumsum(np.bitwise_count(block).astype(np.int64))
            if counts[-1] > rest:
                k = int(np.searchsorted(counts, rest, side="right"))
                before = int(counts[k - 1]) if k else 0
                bits = np.flatnonzero(np.unpackbits(block[k : k + 1].view(np.uint8), bitorder="little"))
                return (word + k) * 64 + int(bits[rest - before])
            rest, word, skip = rest - int(counts[-1]), word + len(block), 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        high = self._select(i) - i
        if not self.low_bits:
            return high
        bit = i * self.low_bits
        size = (bit % 8 + self.low_bits + 7) // 8
        word = int.from_bytes(self.read(self.low_at + bit // 8, size), "little")
        return high << self.low_bits | (word >> bit % 8) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every number, as uint64."""
        vector = np.unpackbits(np.frombuffer(self.read(self.high_at, self.high_size), np.uint8), bitorder="little")
        high = (np.flatnonzero(vector)[: self.n] - np.arange(self.n)).astype(np.uint64)
        if not self.low_bits:
            return high
        size = (self.n * self.low_bits + 7) // 8
        bits = np.unpackbits(np.frombuffer(self.read(self.low_at, size), np.uint8), bitorder="little")
        bits = bits[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        low = (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return high << np.uint64(self.low_bits) | low
