"""An FM-index over word sequences, and matching statistics of many patterns at once.

The Burrows-Wheeler transform of all sequences, each closed by a separator, is kept as a wavelet
matrix: one bit plane per bit of the alphabet with counts per 64 bits, so the index takes
log2(distinct words) bits a word. A backward step of any number of patterns is one pass over the
planes in numpy.
"""

from __future__ import annotations

import numpy as np

_ONE, _LOW = np.uint64(1), np.uint64(63)


class FMIndex:
    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        words = np.concatenate(sequences)
        self.alphabet, codes = np.unique(words, return_inverse=True)
        self.n = len(words) + len(sequences)
        symbols = np.zeros(self.n, np.int64)
        is_word = np.ones(self.n, bool)
        is_word[ends] = False
        symbols[is_word] = codes + 1
        order = np.where(is_word, symbols + len(sequences) - 1, 0)
        order[ends] = np.arange(len(sequences))
        bwt = symbols[_sorted_suffixes(order) - 1]  # before the first word stands the last separator
        self._planes(bwt)
        counts = np.bincount(bwt, minlength=len(self.alphabet) + 1)
        starts = np.cumsum(counts) - counts
        self.base = starts - self._descend(np.arange(len(counts)), np.zeros(len(counts), np.int64))

    def _planes(self, bwt: np.ndarray) -> None:
        self.levels = max(1, int(len(self.alphabet)).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels):
            bit = ((bwt >> (self.levels - 1 - level)) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view(np.uint64)
            ones = np.cumsum(np.bitwise_count(packed), dtype=np.int64)
            self.bits.append(packed)
            self.counts.append(np.append(0, ones))
            self.zeros.append(len(bwt) - int(ones[-1]))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            block = at >> 6
            below = self.bits[level][block] & ((_ONE << (at.astype(np.uint64) & _LOW)) - _ONE)
            ones = self.counts[level][block] + np.bitwise_count(below)
            at = np.where((symbols >> (self.levels - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def encode(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for words that the index does not hold."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front."""
        both = self._descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        low, high = np.split(both + np.tile(self.base[symbols], 2), 2)
        return low, np.where(symbols > 0, high, low)


def _sorted_suffixes(rank: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; separators differ, so sequences of 62 words need seven rounds at most."""
    n, k = len(rank), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - k] = rank[k:] + 1
        pair = rank * np.int64(n + 1) + second
        order = np.argsort(pair)
        new = np.empty(n, np.int64)
        in_order = pair[order]
        new[order] = np.cumsum(np.append(0, in_order[1:] != in_order[:-1]))
        if new[order[-1]] == n - 1 or k >= n:
            return order
        rank, k = new, 2 * k


def repeated_windows(index: FMIndex, patterns: list[np.ndarray], need: np.ndarray, length: int) -> np.ndarray:
    """Per pattern a mask: bit s is set when the index holds words s .. s + length at least ``need`` times.

    The match P[i:e] is extended to the left while it occurs often enough, and every start at which
    it is ``length`` long or longer is reported. Where it fails at f, doubling and halving finds the
    longest P[f:e'] that still occurs often enough, and the match goes on from there; no longer
    match that contains f exists.
    """
    sizes = np.array([len(p) for p in patterns], np.int64)
    table = np.zeros((len(patterns), int(sizes.max())), np.int64)
    table[np.arange(table.shape[1]) < sizes[:, None]] = index.encode(np.concatenate(patterns))
    masks = np.zeros(len(patterns), np.uint64)
    end, start = sizes.copy(), sizes.copy()
    low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), index.n, np.int64)
    probing = np.zeros(len(sizes), bool)
    fail = np.zeros(len(sizes), np.int64)      # where the last extension failed
    good, bad = fail.copy(), fail.copy()       # lengths from there known to occur often enough, or not
    kept_low, kept_high = fail.copy(), fail.copy()
    length_now = fail.copy()                   # length being probed
    live = np.flatnonzero(sizes >= length)
    while len(live):
        at = start[live] - 1
        lo, hi = index.step(table[live, at], low[live], high[live])
        enough = hi - lo >= need[live]
        start[live], low[live], high[live] = at, lo, hi
        in_probe = probing[live]

        lanes = live[~in_probe & enough]
        hit = lanes[end[lanes] - start[lanes] >= length]
        masks[hit] |= _ONE << start[hit].astype(np.uint64)

        lanes = live[~in_probe & ~enough]
        fail[lanes], good[lanes], bad[lanes] = start[lanes], 0, end[lanes] - start[lanes]
        probing[lanes] = True

        ended = live[in_probe & (at == fail[live])]
        fine = high[ended] - low[ended] >= need[ended]
        lanes = ended[fine]
        good[lanes], kept_low[lanes], kept_high[lanes] = length_now[lanes], low[lanes], high[lanes]
        lanes = ended[~fine]
        bad[lanes] = length_now[lanes]

        judged = np.concatenate([live[~in_probe & ~enough], ended])
        solved = judged[bad[judged] - good[judged] == 1]
        end[solved] = fail[solved] + good[solved]
        start[solved] = fail[solved]
        some = good[solved] > 0
        low[solved] = np.where(some, kept_low[solved], 0)
        high[solved] = np.where(some, kept_high[solved], index.n)
        probing[solved] = False
        hit = solved[good[solved] >= length]
        masks[hit] |= _ONE << start[hit].astype(np.uint64)

        again = judged[bad[judged] - good[judged] > 1]
        doubled = np.maximum(1, 2 * good[again])
        length_now[again] = np.where(doubled < bad[again], doubled, (good[again] + bad[again]) // 2)
        start[again] = fail[again] + length_now[again]
        low[again], high[again] = 0, index.n

        reach = np.where(probing, fail + bad - 1, end)  # no match to come ends later
        live = live[(reach[live] >= length) & (probing[live] | (start[live] > 0))]
    return masks
