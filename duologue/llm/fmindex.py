"""A compressed FM-index over word sequences, with matching statistics up to a bounded length.

The Burrows-Wheeler transform is kept in a wavelet matrix of bit-packed levels. Beside it stand the
lengths of common prefixes of neighbouring suffixes, held at ``depth``, as one byte and as one bit
vector for each length; these lead from the interval of a pattern to that of its prefix. Text,
suffix array and ranks are forgotten once the index is built. Places are sampled: only for full-depth
intervals of two or more suffixes the earliest is kept. ``nbytes`` tells the memory: about 13 bytes
a symbol at depth 20 and 2^15 different symbols, where words of text have six or seven.

Suffixes are sorted to ``depth``, which is all that patterns of at most that length need: interval
bounds are then exact, whatever the order among suffixes that are equal to the depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class BitVector:
    """n bits packed in 64-bit words, with a count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)
        self.ones = int(self.before[-1])

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Bounds:
    """Starts of consecutive intervals, as bits; finds the interval that a place lies in."""

    def __init__(self, starts: np.ndarray):
        self.n = len(starts)
        padded = np.zeros((len(starts) // 64 + 1) * 64, np.uint8)
        padded[: len(starts)] = starts
        padded[len(starts)] = 1
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        full, number = self.words != 0, np.arange(len(self.words))
        self.last = np.maximum.accumulate(np.where(full, number, 0)).astype(np.int32)
        self.next = np.minimum.accumulate(np.where(full, number, len(self.words))[::-1])[::-1].astype(np.int32)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.last.nbytes + self.next.nbytes

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, word, bit = np.uint64(1), at >> 6, (at & 63).astype(np.uint64)
        upto = (np.uint64(2) << bit) - one  # bit 63 wraps to all ones
        low, high = self.words[word] & upto, self.words[word] & ~upto
        before = np.where(low != 0, word, self.last[np.maximum(word - 1, 0)])
        x = np.where(low != 0, low, self.words[before])
        for k in (1, 2, 4, 8, 16, 32):
            x = x | x >> np.uint64(k)
        lo = before * 64 + np.bitwise_count(x).astype(np.int64) - 1
        after = np.where(high != 0, word, self.next[np.minimum(word + 1, len(self.words) - 1)])
        x = np.where(high != 0, high, self.words[after])
        return lo, after * 64 + np.bitwise_count((x & (~x + one)) - one)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            vector = BitVector(bits)
            self.levels.append((shift, vector, len(symbols) - vector.ones))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        #: where each symbol's occurrences begin in the last level
        self.base = np.zeros(sigma, np.int64)
        self.base = self.descend(np.arange(sigma), np.zeros(sigma, np.int64))

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + sum(v.nbytes for _, v, _ in self.levels)

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the occurrences of each symbol before ``at`` end in the last level."""
        for shift, vector, zeros in self.levels:
            ones = vector.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before ``at``."""
        return self.descend(symbol, at) - self.base[symbol]


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    out[: max(0, len(x) - k)] = x[k:]
    return out


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array to ``depth``, by doubling, and for each of its places the prefix in common with the place before, held at depth."""
    n, step, ranks = len(text), 1, [text.astype(np.int64)]
    while 2 * step <= depth:
        rank = ranks[-1]
        key = rank * (int(rank.max()) + 1) + _ahead(rank, step)
        order = np.argsort(key)
        sorted_key, new = key[order], np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        ranks.append(new)
        step *= 2
    rank = ranks[-1]
    order = np.argsort(rank * (int(rank.max()) + 1) + _ahead(rank, depth - step))
    left, right = order[:-1], order[1:]
    common = np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = left + common[1:], right + common[1:]
        same = (np.maximum(a, b) < n) & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        common[1:][same] += 1 << k
    return order, np.minimum(common, depth).astype(np.uint8)


class FMIndex:
    """Index of strings that zeros separate; symbols are 1..sigma-1. ``depth`` bounds patterns and statistics."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.n, self.depth = len(text), depth
        order, self.common = sorted_suffixes(text, depth)
        self.prefixes = [Bounds(self.common < k) for k in range(1, depth)]
        starts = np.flatnonzero(self.common < depth)
        many = np.diff(np.r_[starts, self.n]) > 1
        flags = np.zeros(self.n, np.uint8)
        flags[starts[many]] = 1
        self.repeated, self.earliest = BitVector(flags), np.minimum.reduceat(order, starts)[many].astype(np.int32)
        counts = np.bincount(text, minlength=sigma)
        self.before = np.r_[0, np.cumsum(counts)[:-1]]
        self.wavelet = WaveletMatrix(text[order - 1], sigma)

    @property
    def nbytes(self) -> int:
        return self.wavelet.nbytes + self.before.nbytes + self.common.nbytes + self.repeated.nbytes + self.earliest.nbytes + sum(b.nbytes for b in self.prefixes)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of symbol + pattern."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.before[symbol] + both[: len(lo)], self.before[symbol] + both[len(lo) :]

    def prefix(self, lo: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``length`` symbols of the patterns whose intervals begin at lo."""
        first, last = np.zeros(len(lo), np.int64), np.full(len(lo), self.n, np.int64)
        for k in np.unique(length[length > 0]).tolist():
            own = length == k
            first[own], last[own] = self.prefixes[k - 1].around(lo[own])
        return first, last

    def first_place(self, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The earliest text place of full-depth intervals; ``own`` where the interval is one suffix."""
        several = hi - lo > 1
        place = own.copy()
        if several.any():
            place[several] = self.earliest[self.repeated.rank(lo[several])]
        return place

    def statistics(self, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Streams strings text[begins:ends] from their ends; yields (string numbers, places, lo, hi) where ``depth`` symbols match.

        The matching statistic of a place is the longest match that starts there. It grows by one
        symbol a step. Where the symbol does not extend the match, the match loses symbols at its
        end until it does: the next shorter prefix whose interval is larger is its parent. Symbols
        that the index does not hold are zero. A string is left as soon as it can reach no further
        match of full depth.
        """
        live = np.flatnonzero(ends - begins >= self.depth)
        at, length = ends[live].copy(), np.zeros(len(live), np.int64)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        lengths_after = np.r_[self.common, np.uint8(0)]
        while len(live):
            full = np.flatnonzero(length == self.depth)
            if len(full):
                lo[full], hi[full] = self.prefix(lo[full], length[full] - 1)
                length[full] -= 1
            symbol = text[at - 1]
            new_lo, new_hi = self.extend(symbol, lo, hi)
            grown = (new_hi > new_lo) & (symbol > 0)
            lost = ~grown & ((length == 0) | (symbol == 0))
            short = np.flatnonzero(~grown & ~lost)
            lo, hi = np.where(grown, new_lo, lo), np.where(grown, new_hi, hi)
            length += grown
            at -= grown | lost
            lo[lost], hi[lost], length[lost] = 0, self.n, 0
            if len(short):
                length[short] = np.maximum(lengths_after[lo[short]], lengths_after[hi[short]])
                lo[short], hi[short] = self.prefix(lo[short], length[short])
            hit = np.flatnonzero(grown & (length == self.depth))
            if len(hit):
                yield live[hit], at[hit], lo[hit], hi[hit]
            keep = (at > begins[live]) & (at - begins[live] + length >= self.depth)
            live, at, length, lo, hi = live[keep], at[keep], length[keep], lo[keep], hi[keep]
