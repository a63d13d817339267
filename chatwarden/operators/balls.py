"""A ball tree over centers, and the k rows nearest to each of them.

A node is a ball around some centers: their mean, and the largest distance of a
center to it. For every center the distance of its k-th row so far is known, and
for every node the largest of those. A row farther from a node's middle than its
radius and that distance together cannot be among the k nearest of any center
below, by the triangle inequality, and goes no further down. What reaches a leaf
is held against its centers by one matrix product, and rows that could still be
nearest are measured exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LEAF = 16  # centers
_DISTANCES = 4_000_000  # held at a time


class BallTree:
    """The k nearest rows of every center, over the rows given so far."""

    def __init__(self, centers: np.ndarray, k: int):
        self.centers, self.k = centers, k
        self.order = np.arange(len(centers))  # of centers, as the leaves have them
        self.nodes: list[tuple] = []  # (start, end, middle, radius, left, right)
        if len(centers):
            self._split(0, len(centers))
        self.found: list[list[tuple]] = [[] for _ in range(len(centers))]  # (distance, key), sorted
        self.reach = np.full(len(centers), np.inf)  # distance of the k-th row
        self.seen = self.measured = 0

    def _split(self, start: int, end: int) -> int:
        """The node of ``order[start:end]``, halved along the axis of its largest spread."""
        rows = self.centers[self.order[start:end]]
        middle = rows.mean(axis=0)
        radius = float(np.sqrt(((rows - middle) ** 2).sum(axis=1)).max())
        at = len(self.nodes)
        self.nodes.append((start, end, middle, radius, -1, -1))
        if end - start > LEAF:
            axis = int(np.argmax(rows.var(axis=0)))
            half = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(rows[:, axis], half)]
            left, right = self._split(start, start + half), self._split(start + half, end)
            self.nodes[at] = (start, end, middle, radius, left, right)
        return at

    def add(self, keys: pa.Array, x: np.ndarray) -> None:
        """Rows with finite values."""
        if not len(x) or not self.nodes:
            return
        self.seen += len(x) * len(self.centers)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            start, end, middle, radius, left, right = self.nodes[node]
            limit = self.reach[self.order[start:end]].max() + radius
            if np.isfinite(limit):
                away = np.sqrt(((x[rows] - middle) ** 2).sum(axis=1))
                rows = rows[away <= limit + 1e-9 * (away + limit)]
            if not len(rows):
                continue
            if left >= 0:  # the nearer half first: it lowers what the other one has to reach
                todo += [(right, rows), (left, rows)]
                continue
            step = max(1, _DISTANCES // (end - start))
            for i in range(0, len(rows), step):
                self._leaf(self.order[start:end], keys, x, rows[i : i + step])

    def _leaf(self, members: np.ndarray, keys: pa.Array, x: np.ndarray, rows: np.ndarray) -> None:
        matrix, near = self.centers[members], x[rows]
        x_norm, c_norm = np.einsum("ij,ij->i", near, near), np.einsum("ij,ij->i", matrix, matrix)
        rough = x_norm[:, None] + c_norm[None, :] - 2.0 * (near @ matrix.T)
        self.measured += rough.size
        slack = 1e-9 * (x_norm.max() + c_norm)
        nth = min(self.k, len(rows)) - 1
        limits = np.minimum(np.partition(rough, nth, axis=0)[nth], self.reach[members] ** 2) + 2 * slack
        for j in np.flatnonzero((rough <= limits).any(axis=0)).tolist():
            center = int(members[j])
            maybe = np.flatnonzero(rough[:, j] <= limits[j])
            exact = np.sqrt(((near[maybe] - matrix[j]) ** 2).sum(axis=1))
            more = zip(exact.tolist(), keys.take(pa.array(rows[maybe])).to_pylist())
            best = sorted([*self.found[center], *more])[: self.k]
            self.found[center] = best
            if len(best) == self.k:
                self.reach[center] = best[-1][0]
