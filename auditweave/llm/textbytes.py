"""Words of many texts at once, as numpy arrays over the bytes of an Arrow batch.

A word is a run of bytes other than the space and 0x09 to 0x0D, which in UTF-8 equals a run of
characters other than those. Words become 64-bit hashes of their bytes and length; all work is
done in pieces of about a megabyte, so a batch of long texts needs little memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 20
_random = np.random.default_rng(20240607)
_TABLE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _PIECE)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & (1 << 64) - 1], np.uint64))[0])


class Texts:
    """Some texts: ``data`` bytes, text i at ``bounds[i]:bounds[i + 1]``, words by ``first, last`` byte offsets.

    ``word_bounds[i]:word_bounds[i + 1]`` are the words of text i, ``hashes`` the words' hashes.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        self.bounds = bounds
        inside = ~_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = bounds[:-1][bounds[:-1] < len(data)]
        begins[starts] = inside[starts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        stops = bounds[1:][bounds[1:] > 0] - 1
        ends[stops] = inside[stops]
        self.first = np.flatnonzero(begins)
        self.last = np.flatnonzero(ends) + 1
        self.word_bounds = np.searchsorted(self.first, bounds)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.first), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.last, self.first[i] + _PIECE, "right")))
            at, end = self.first[i], self.last[j - 1]
            sums = np.zeros(end - at + 1, np.uint64)
            np.cumsum(_TABLE[self.data[at:end]] * _power(_BASE, end - at), out=sums[1:])
            a, b = self.first[i:j] - at, self.last[i:j] - at
            h = (sums[b] - sums[a]) * _power(_BASE_INVERSE, end - at)[a]
            out[i:j] = mix64(h + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            i = j
        return out

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, i: int) -> list[str]:
        a, b = self.word_bounds[i], self.word_bounds[i + 1]
        return [self.data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(self.first[a:b], self.last[a:b], strict=True)]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; of use only where k words of the text are left."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    n = len(hashes) - k + 1
    total = np.zeros(n, np.uint64)
    for t in range(k):
        total += hashes[t:t + n] * np.uint64(mix_int(t + 1) | 1)
    return mix64(total)


def columns_of(batch: pa.RecordBatch, text: str, size: int = 2 << 20, lower: bool = False) -> Iterator[tuple[slice, Texts]]:
    """The rows of a batch in slices of about ``size`` bytes of text, at least one row each. NULL: empty."""
    column = batch.column(text).cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield slice(i, j), Texts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lower)
        i = j
