"""A hierarchical k-means tree over unit vectors, fitted on a bounded sample; it fits into any worker."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BRANCHES = 16
MAX_LEAVES = 16_384
ROUNDS = 8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length, computed in double precision."""
    x = np.asarray(vectors, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        at = (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)]).astype(np.float32)
    return c, (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)


@dataclass
class Tree:
    """Node 0 is the root; the children of a node lie side by side. leaf is a node's leaf number, or -1."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    leaves: int

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, seed: int = 7) -> Tree:
        """Split the sample until a part holds about len(sample) / leaves of it."""
        x = np.ascontiguousarray(sample, dtype=np.float32)
        rng = np.random.default_rng(seed)
        full = max(1.0, len(x) / max(1, min(leaves, MAX_LEAVES)))
        centres, first, count = [x.mean(0)], [0], [0]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop(0)
            k = min(BRANCHES, int(np.ceil(len(rows) / full)))
            if len(rows) <= 1.5 * full or k < 2:
                continue
            c, at = _means(x[rows], k, rng)
            used = np.flatnonzero(np.bincount(at, minlength=k))
            if len(used) < 2:  # equal vectors can't be split
                continue
            first[node], count[node] = len(centres), len(used)
            for j in used:
                centres.append(c[j])
                first.append(0)
                count.append(0)
                todo.append((len(centres) - 1, rows[at == j]))
        n = np.array(count)
        leaf = np.where(n == 0, np.cumsum(n == 0) - 1, -1)
        return cls(np.array(centres, dtype=np.float32), np.array(first), n, leaf, int((n == 0).sum()))

    def _below(self, node: int) -> slice:
        return slice(int(self.first[node]), int(self.first[node] + self.count[node]))

    def _distances(self, x: np.ndarray, node: int) -> np.ndarray:
        c = self.centres[self._below(node)]
        return (x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.count[at] > 0)
            if not len(inner):
                return self.leaf[at]
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                at[rows] = self.first[node] + self._distances(x[rows], node).argmin(1)

    def best_bins(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first visits leaves of each row, best bin first; -1 where the tree has no more.

        Each row has a priority queue of nodes by distance to their centres. The nearest is taken out: a leaf is visited,
        another node puts its children into the queue. As every node taken out leads to a leaf at least, those beyond the
        visits still open are never taken and are dropped, so a queue holds no more than visits nodes and some children,
        however large the tree is. The queues of many rows advance together.
        """
        visits = min(visits, self.leaves)
        out = np.full((len(x), visits), -1, dtype=np.int32)
        room = visits + BRANCHES
        step = max(1, 4_000_000 // room)
        for start in range(0, len(x), step):
            part = x[start : start + step]
            n = len(part)
            far, node = np.full((n, room), np.inf, dtype=np.float32), np.zeros((n, room), dtype=np.int32)
            far[:, 0] = 0
            seen = np.zeros(n, dtype=np.int64)
            open_rows = np.arange(n)
            while len(open_rows):
                slot = far[open_rows].argmin(1)
                top = node[open_rows, slot]
                far[open_rows, slot] = np.inf
                is_leaf = self.count[top] == 0
                r = open_rows[is_leaf]
                out[start + r, seen[r]] = self.leaf[top[is_leaf]]
                seen[r] += 1
                inner, at = open_rows[~is_leaf], top[~is_leaf]
                for k in np.unique(at):
                    rows = inner[at == k]
                    below = self._below(k)
                    more = self._distances(part[rows], k)
                    both = np.concatenate([far[rows], more], axis=1)
                    names = np.concatenate([node[rows], np.broadcast_to(np.arange(below.start, below.stop, dtype=np.int32), more.shape)], axis=1)
                    kept = np.argpartition(both, room - 1, axis=1)[:, :room]
                    far[rows], node[rows] = np.take_along_axis(both, kept, 1), np.take_along_axis(names, kept, 1)
                open_rows = open_rows[seen[open_rows] < visits]
        return out
