"""Words of UTF-8 texts as arrays of whole numbers, for the numpy work inside tasks.

A word is ``[^\\x20\\x09-\\x0D]+``, which is what ``bytes.split()`` gives on UTF-8. A word's number is exact (equal
numbers, equal words) inside one table of words; its 64-bit hash is the same everywhere.
"""

from __future__ import annotations

import numpy as np
import xxhash

from rowloom.llm.text import mix


class Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def number_hashes(numbers: np.ndarray) -> np.ndarray:
    """Spread numbers over 64 bits."""
    return mix(numbers.astype(np.uint64) + np.uint64(1))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    low, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    return low


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the minimum of every ``width`` consecutive values, the first of equal ones."""
    low, at, reach = values, np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        n = len(low) - step
        later = low[step:] < low[:n]
        low, at = np.where(later, low[step:], low[:n]), np.where(later, at[step:], at[:n])
        reach += step
    return at


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``counts[i]`` numbers each, one after another."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - before, counts)
