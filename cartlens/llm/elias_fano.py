"""Elias-Fano sequences and the bigram trie of one shard, as views of one memory-mapped buffer."""

from __future__ import annotations

import mmap

import numpy as np

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence: low bytes stored plainly, high parts in unary with a rank directory.

    ``low_bytes`` is the number of bytes below the high part, the least for which there are no more high buckets
    than values; a bucket's values are found through the zeros of the unary code.
    """


    def __init__(self, n: int, low_bytes: int, high: np.ndarray, directory: np.ndarray, low: np.ndarray) -> None:
        self.n, self.low_bytes = n, low_bytes
        self.high, self.directory, self.low = high, directory, low

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n, low_bytes = len(values), 0
        while (universe >> (8 * low_bytes)) > max(n, 1):
            low_bytes += 1
        values = values.astype(np.uint64)
        upper = (values >> np.uint64(8 * low_bytes)).astype(np.int64) if low_bytes < 8 else np.zeros(n, np.int64)
        buckets = (universe >> (8 * low_bytes)) + 1
        bits = np.zeros((n + buckets + 7) // 8 * 8, np.uint8)
        upper += np.arange(n)
        bits[upper] = 1  # a one for each value behind a zero for each earlier bucket
        del upper
        high = np.packbits(bits)
        directory = np.concatenate([[0], np.cumsum(8 - _POPCOUNT[high])]).astype(np.uint32)
        low = values.view(np.uint8).reshape(n, 8)[:, :low_bytes].ravel().copy()
        return cls(n, low_bytes, high, directory, low)

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the unary code (from 0)."""
        byte = np.searchsorted(self.directory, k, "right") - 1
        left = k - self.directory[byte]
        bits = np.unpackbits(self.high[byte]).reshape(-1, 8)
        order = np.cumsum(1 - bits, axis=1, dtype=np.int64)
        return byte * 8 + (order <= left[:, None]).sum(axis=1)

    def bucket(self, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 index of the values with this high part."""
        end = self._select_zero(upper) - upper
        start = np.where(upper > 0, self._select_zero(np.maximum(upper - 1, 0)) - (upper - 1), 0)
        return start, end

    def _low(self, index: np.ndarray) -> np.ndarray:
        value = np.zeros(len(index), np.uint64)
        for k in range(self.low_bytes):
            value |= self.low[index * self.low_bytes + k].astype(np.uint64) << np.uint64(8 * k)
        return value

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: a search among the successors of its bucket only."""
        found = np.full(len(values), -1, np.int64)
        if not self.n:
            return found
        shift = np.uint64(8 * self.low_bytes)
        upper = (values >> shift).astype(np.int64)
        target = values & np.uint64((1 << (8 * self.low_bytes)) - 1)
        # Neighbouring queries often share their bucket.
        heads = np.flatnonzero(np.r_[True, upper[1:] != upper[:-1]]) if len(upper) else np.zeros(0, np.int64)
        lo, hi = (np.repeat(v, np.diff(np.r_[heads, len(upper)])) for v in self.bucket(upper[heads]))
        end = hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < target[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
        inside = np.flatnonzero(lo < end)
        match = self._low(lo[inside]) == target[inside]
        found[inside[match]] = lo[inside[match]]
        return found

    def access(self, index: np.ndarray) -> np.ndarray:
        """The values at the given positions."""
        ones = self._ones()
        byte = np.searchsorted(ones, index, "right") - 1
        left = index - ones[byte]
        bits = np.unpackbits(self.high[byte]).reshape(-1, 8)
        place = byte * 8 + (np.cumsum(bits, axis=1, dtype=np.int64) <= left[:, None]).sum(axis=1)
        upper = (place - index).astype(np.uint64)
        return (upper << np.uint64(8 * self.low_bytes)) | self._low(index)

    def _ones(self) -> np.ndarray:
        return np.arange(len(self.directory), dtype=np.int64) * 8 - self.directory


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays as read-only views of one anonymous memory map."""
    offsets, size = [], 0
    for a in arrays:
        offsets.append(size)
        size += (a.nbytes + 7) // 8 * 8
    buffer = mmap.mmap(-1, max(size, 8))
    for a, at in zip(arrays, offsets, strict=True):
        buffer[at : at + a.nbytes] = a.tobytes()
    view = memoryview(buffer)
    return [np.frombuffer(view, a.dtype, len(a), at) for a, at in zip(arrays, offsets, strict=True)]


#: Quantised log10 probabilities: steps of 1/4096, down to -15.99.
STEP = 4096.0


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-logs * STEP), 0, 65535).astype(np.uint16)


class BigramTrie:
    """Contexts with their successors: level 1 the sorted context ids, with monotone pointers into level 2;
    level 2 the successors, each as (context number, successor id) in one monotone sequence, so that a search
    stays within a context; with a quantised log probability for each, and a back-off weight for each context."""

    BITS = 40

    def __init__(self, contexts: np.ndarray, pairs: np.ndarray, logs: np.ndarray, backoff: np.ndarray) -> None:
        """``pairs``: sorted (context number << 40 | successor)."""
        first = np.searchsorted(pairs >> np.uint64(self.BITS), np.arange(len(contexts) + 1, dtype=np.uint64))
        level = EliasFano.build(pairs, max(1, len(contexts)) << self.BITS)
        pointers = EliasFano.build(first, len(pairs) + 1)
        parts = [contexts, quantise(logs), quantise(backoff)]
        for e in (level, pointers):
            parts += [e.high, e.directory, e.low]
        views = mapped(parts)
        self.contexts, self.logs, self.backoffs = views[:3]
        self.level = EliasFano(level.n, level.low_bytes, *views[3:6])
        self.pointers = EliasFano(pointers.n, pointers.low_bytes, *views[6:9])

    def successors(self, context: np.ndarray) -> np.ndarray:
        """How many successors the contexts (by number) have."""
        return (self.pointers.access(context + 1) - self.pointers.access(context)).astype(np.int64)

    def log_probability(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each pair's probability, and where it was found."""
        at = self.level.find(pairs)
        found = at >= 0
        return np.where(found, self.logs[np.maximum(at, 0)] / -STEP if len(self.logs) else 0.0, 0.0), found

    def backoff(self, context: np.ndarray) -> np.ndarray:
        return self.backoffs[context] / -STEP
