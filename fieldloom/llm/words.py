"""Words of many texts at once, as numpy arrays.

A word is a longest run of bytes other than the six ASCII spaces (0x20, 0x09-0x0D).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 4096), _BASE, np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS


@dataclass
class Words:
    """``data``: all texts, each followed by a line feed; word i of them is data[start[i]:start[i]+length[i]]
    and belongs to text ``text[i]``; ``first[t]:first[t + 1]`` are the words of text t."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal in every process."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at = np.arange(int(self.length.sum())) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        byte = self.data[np.repeat(self.start, self.length) + at].astype(np.uint64) + np.uint64(1)
        byte *= _powers(int(self.length.max()))[at]
        return mix(np.add.reduceat(byte, np.cumsum(self.length) - self.length))


def split(texts: list[bytes], lower: bool = True) -> Words:
    """The words of ``texts``, in order; ``lower`` maps A-Z to a-z first."""
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        data = _LOWER[data]
    space = np.ones(len(data) + 1, bool)
    np.take(_SPACE, data, out=space[1:])
    start = np.flatnonzero(space[:-1] & ~space[1:])
    end = np.flatnonzero(~space[:-1] & space[1:])
    ends = np.cumsum(sizes)
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    return Words(data, start, end - start, np.repeat(np.arange(len(texts)), np.diff(first)), first)


class Index:
    """Places in a sorted array, from 1 (0: not there), by a hash table whose second and later entries of a
    slot are found by bisection."""

    BITS = 18

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        slot = self._slots(known)
        self.first = np.zeros(1 << self.BITS, np.int32)
        self.first[slot[::-1]] = np.arange(len(known), 0, -1)
        self.code = np.zeros(1 << self.BITS, np.uint64)
        self.code[slot[::-1]] = known[::-1]
        self.more = np.bincount(slot, minlength=1 << self.BITS) > 1

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, asked: np.ndarray) -> np.ndarray:
        slot = self._slots(asked)
        hit = self.code[slot] == asked
        out = np.where(hit, self.first[slot], 0)  # an empty slot holds code 0 and place 0
        late = np.flatnonzero(~hit & self.more[slot])
        if len(late):
            at = np.minimum(np.searchsorted(self.known, asked[late]), len(self.known) - 1)
            out[late] = np.where(self.known[at] == asked[late], at + 1, 0)
        return out
