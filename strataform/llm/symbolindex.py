"""A full-text index of vectors written as strings of symbols, searched backwards.

A unit vector is turned by a fixed rotation and each of its coordinates is cut into cells: one symbol a coordinate, so a
vector is a string. The index is that of Burrows and Wheeler for these strings: for every coordinate the suffixes that
start there are sorted, and (symbol, rank of the suffix one further right) in sorted order is what a step to the left
needs; the symbols are kept beside them, one byte each, to see how far a match goes. As symbols of different coordinates differ, matches are aligned by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Width of a cell, symbols that a match must have in a row, and independent rotations.
CELL, MATCH, ROTATIONS = 0.1, 8, 5


def rotation(size: int, k: int) -> np.ndarray:
    """The k-th fixed orthonormal matrix."""
    return np.linalg.qr(np.random.default_rng([size, k]).normal(size=(size, size)))[0]


def strings(unit: np.ndarray, k: int) -> np.ndarray:
    """The symbols of unit vectors under the k-th rotation, one row a vector."""
    return (np.floor(unit @ rotation(unit.shape[1], k) / CELL) + np.ceil(1 / CELL)).astype(np.int32)


@dataclass
class SymbolIndex:
    """order[j]: the vectors in the order of their suffixes from coordinate j; keys[j]: symbol * rows + rank, sorted."""

    rows: int
    symbols: np.ndarray
    order: list[np.ndarray]
    keys: list[np.ndarray]

    @classmethod
    def build(cls, symbols: np.ndarray) -> SymbolIndex:
        n, size = symbols.shape
        if (int(symbols.max(initial=0)) + 1) * max(n, 1) >= 1 << 31:
            raise ValueError("a shard has too many vectors for its keys")
        rank = np.arange(n, dtype=np.int32)  # the last suffixes are one symbol long: equal ones keep the order of the vectors
        order, keys = [], []
        for j in range(size - 1, -1, -1):
            key = symbols[:, j].astype(np.int32) * np.int32(n) + rank
            by = np.argsort(key, kind="stable").astype(np.int32)
            order.append(by)
            keys.append(key[by])
            rank = np.empty(n, dtype=np.int32)
            rank[by] = np.arange(n, dtype=np.int32)
        return cls(n, symbols.astype(np.uint8), order[::-1], keys[::-1])

    def matches(self, symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, start, end) of stretches of equal symbols, at least so many in a row.

        Every place is the right end of a search that steps to the left while any suffix of the index goes on to match.
        Searches of all queries advance together, so a step is two binary searches over one coordinate's keys. A stretch
        is reported once it is long enough; longer ones come as overlapping spans.
        """
        m, size = symbols.shape
        query, end, lo, hi = (np.zeros(0, dtype=np.int32) for _ in range(4))
        found: list[tuple[np.ndarray, ...]] = []
        every = np.arange(m, dtype=np.int32)
        full = np.full(m, self.rows, dtype=np.int32)
        for j in range(size - 1, -1, -1):
            if j >= least - 1:
                query = np.r_[query, every]
                end = np.r_[end, np.full(m, j, dtype=np.int32)]
                lo = np.r_[lo, np.zeros(m, dtype=np.int32)]
                hi = np.r_[hi, full]
            base = symbols[query, j] * np.int32(self.rows)
            lo = np.searchsorted(self.keys[j], base + lo).astype(np.int32)
            hi = np.searchsorted(self.keys[j], base + hi).astype(np.int32)
            going = hi > lo
            query, end, lo, hi = query[going], end[going], lo[going], hi[going]
            done = end - j + 1 >= least
            if done.any():
                n = (hi - lo)[done].astype(np.int64)
                at = np.repeat(lo[done], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append((np.repeat(query[done], n).astype(np.int64), self.order[j][at].astype(np.int64), np.full(len(at), j), np.repeat(end[done], n).astype(np.int64)))
                query, end, lo, hi = query[~done], end[~done], lo[~done], hi[~done]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(4))

    def maximal(self, symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, start, end) of all maximal stretches: those that go on neither to the left nor to the right.

        Of the stretches found, those whose next symbols to the right agree belong to a search that began further right;
        the others are followed to the left as far as they agree.
        """
        q, v, start, end = self.matches(symbols, least)
        last = symbols.shape[1] - 1
        after = np.minimum(end + 1, last)
        whole = (end == last) | (self.symbols[v, after] != symbols[q, after])
        q, v, start, end = q[whole], v[whole], start[whole], end[whole]
        going = np.flatnonzero(start > 0)
        while len(going):
            going = going[self.symbols[v[going], start[going] - 1] == symbols[q[going], start[going] - 1]]
            start[going] -= 1
            going = going[start[going] > 0]
        return q, v, start, end


def merged(query: np.ndarray, vector: np.ndarray, start: np.ndarray, end: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, symbols): spans of a pair merged, and how many symbols they cover; each pair once."""
    pair = query * rows + vector
    by = np.lexsort((start, pair))
    pair, start, end = pair[by], start[by], end[by]
    head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, dtype=np.int64)
    before = np.r_[-1, end[:-1]]
    before[head] = -1
    gained = end - np.maximum(start - 1, before)  # ends rise with starts: the last end is the farthest
    covered = np.add.reduceat(gained, head) if len(head) else gained
    return pair[head] // rows if rows else pair[head], pair[head] % rows if rows else pair[head], covered


@dataclass
class WordIndex:
    """The suffixes of one coordinate sorted by their first symbols: words, each once, and the vectors that have them.

    These are the ranks that so many steps of the backward search from the word's end lead to; they are looked up at once.
    """

    words: np.ndarray
    first: np.ndarray
    order: np.ndarray

    @classmethod
    def build(cls, words: np.ndarray) -> WordIndex:
        order = np.argsort(words, kind="stable").astype(np.int32)
        in_order = words[order]
        first = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]]) if len(words) else np.zeros(0, dtype=np.int64)
        return cls(in_order[first], np.r_[first, len(words)], order)

    def hits(self, words: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, vector) of equal words, some most pairs at a time (more only if one query has them)."""
        if not len(self.words):
            return
        by = np.argsort(words)  # in order, so that neighbouring searches touch the same memory
        at = np.minimum(np.searchsorted(self.words, words[by]), len(self.words) - 1)
        same = self.words[at] == words[by]
        query, at = by[same], at[same]
        lo, n = self.first[at], self.first[at + 1] - self.first[at]
        total = np.cumsum(n)
        start = 0
        while start < len(query):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
            m = n[start:end]
            inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.repeat(query[start:end], m), self.order[np.repeat(lo[start:end], m) + inside]
            start = end


def words_of(symbols: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """The words of so many symbols from every coordinate on, each as one number."""
    base = int(2 * np.ceil(1 / CELL) + 1)
    if base**length >= 1 << 63:
        raise ValueError("a word has too many symbols for its number")
    word = np.zeros(len(symbols), dtype=np.int64)
    for j in range(symbols.shape[1]):
        word = word * base + symbols[:, j]
        if j >= length:
            word -= symbols[:, j - length] * np.int64(base**length)
        if j >= length - 1:
            yield word


def common_symbols(a: np.ndarray, b: np.ndarray, least: int = MATCH) -> np.ndarray:
    """Symbols that the maximal stretches of two unit vectors a row cover, under all rotations; at least so many in a row."""
    covered = np.zeros(len(a), dtype=np.int64)
    for k in range(ROTATIONS):
        same = strings(a, k) == strings(b, k)
        edge = np.diff(np.pad(same, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, start), end = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
        long = end - start >= least
        covered += np.bincount(row[long], weights=(end - start)[long], minlength=len(a)).astype(np.int64)
    return covered


class VectorIndex:
    """Indexes of one shard of unit vectors under all rotations."""

    def __init__(self, unit: np.ndarray) -> None:
        self.unit = unit
        self.indexes = [SymbolIndex.build(strings(unit, k)) for k in range(ROTATIONS)]

    def near(self, unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, symbols) of pairs with a match under some rotation and at least that cosine, computed in double."""
        parts = [merged(*index.maximal(strings(unit, k), MATCH), index.rows) for k, index in enumerate(self.indexes)]
        q, v, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        pair = q * max(1, len(self.unit)) + v
        pair, at = np.unique(pair, return_inverse=True)
        n = np.bincount(at, weights=n, minlength=len(pair)).astype(np.int64)
        q, v = pair // max(1, len(self.unit)), pair % max(1, len(self.unit))
        good = np.einsum("ij,ij->i", unit[q], self.unit[v]) >= cosine - 1e-12
        return q[good], v[good], n[good]
