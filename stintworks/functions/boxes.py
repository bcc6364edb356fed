"""Search trees of boxes on principal axes: fitting one on a sample, placing rows, best-first descent.

A tree splits the vectors of one cohort at medians of their principal axes. Rotating vectors keeps Euclidean
distances, and boxes along the principal axes are narrow where the data is correlated. A box covers the first ``AXES``
principal coordinates and the length of what is left of a vector, so a bound needs few numbers at any dimension.
Nodes are numbered as in a heap: the root is 1, the children of n are 2n and 2n + 1.
"""

from __future__ import annotations

import numpy as np

AXES = 16
# Pairs of query and node that are looked at together.
_PAIRS = 1 << 20


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Columns are orthonormal axes, that of the largest spread first."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])
    _, axes = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(sample.shape[1], -1))
    return np.ascontiguousarray(axes[:, ::-1])


def box_coordinates(points: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Principal coordinates, and the length of the rest where there is one."""
    turned = points @ axes
    if turned.shape[1] <= AXES:
        return turned
    rest = np.sqrt((turned[:, AXES:] ** 2).sum(axis=1))
    return np.concatenate([turned[:, :AXES], rest[:, None]], axis=1)


def fit_splits(spots: np.ndarray, depth: int) -> tuple[list[int], list[int], list[float]]:
    """(node, axis, value) of every split: the median of the axis of the largest variance. Rows up to it go left.

    A node of equal rows does not split.
    """
    nodes, dims, values = [], [], []
    level = [(1, np.arange(len(spots)))]
    for _ in range(depth):
        below = []
        for node, rows in level:
            here = spots[rows]
            if len(rows) < 2:
                continue
            axis = int(here.var(axis=0).argmax())
            value = float(np.median(here[:, axis]))
            if value >= here[:, axis].max():  # more than half of the rows share the greatest value
                lower = here[:, axis][here[:, axis] < value]
                if not len(lower):
                    continue
                value = float(lower.max())
            right = here[:, axis] > value
            nodes.append(node), dims.append(axis), values.append(value)
            below += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
        level = below
    return nodes, dims, values


class Splits:
    """Finds the leaf of a row."""

    def __init__(self, nodes, dims, values):
        nodes = np.asarray(nodes, np.int64)
        self.depth = int(nodes.max()).bit_length() if len(nodes) else 0
        self.axis = np.full(1 << max(self.depth, 1), -1, np.int64)
        self.value = np.zeros(len(self.axis))
        self.axis[nodes], self.value[nodes] = np.asarray(dims, np.int64), np.asarray(values, float)

    def leaf(self, spots: np.ndarray) -> np.ndarray:
        at = np.ones(len(spots), np.int64)
        rows = np.arange(len(spots))
        for _ in range(self.depth):
            inside = at < len(self.axis)
            axis = np.where(inside, self.axis[np.where(inside, at, 0)], -1)
            split = axis >= 0
            right = spots[rows, np.maximum(axis, 0)] > self.value[np.where(inside, at, 0)]
            at = np.where(split, 2 * at + right, at)
        return at


class Nodes:
    """All nodes of one tree with their boxes and numbers of rows."""

    def __init__(self, leaves: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray):
        """From the leaves: ``low`` and ``high`` are their boxes, ``rows`` how many rows each has."""
        depth = int(leaves.max()).bit_length()
        size = 1 << depth
        self.low = np.full((size, low.shape[1]), np.inf)
        self.high = np.full((size, low.shape[1]), -np.inf)
        self.rows = np.zeros(size, np.int64)
        self.is_leaf = np.zeros(size, bool)
        self.low[leaves], self.high[leaves], self.rows[leaves], self.is_leaf[leaves] = low, high, rows, True
        for node in range(size // 2 - 1, 0, -1):
            if self.is_leaf[node]:
                continue
            a, b = 2 * node, 2 * node + 1
            self.low[node] = np.minimum(self.low[a], self.low[b])
            self.high[node] = np.maximum(self.high[a], self.high[b])
            self.rows[node] = self.rows[a] + self.rows[b]

    def nearest_corner(self, spots: np.ndarray, query: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Least squared distance from each query to a row of the node beside it."""
        total = np.zeros(len(query))
        for j in range(self.low.shape[1]):
            x = spots[query, j]
            gap = np.maximum(self.low[node, j] - x, x - self.high[node, j])
            np.maximum(gap, 0, out=gap)
            total += gap * gap
        return total

    def farthest_corner(self, spots: np.ndarray, query: np.ndarray, node: np.ndarray, rest: bool) -> np.ndarray:
        """Greatest squared distance; ``rest``: the last coordinate is a length, whose directions may be opposite."""
        total = np.zeros(len(query))
        last = self.low.shape[1] - 1
        for j in range(last + 1):
            x = spots[query, j]
            if rest and j == last:
                gap = x + self.high[node, j]
            else:
                gap = np.maximum(np.abs(x - self.low[node, j]), np.abs(x - self.high[node, j]))
            total += gap * gap
        return total

    def own_leaf(self, spots: np.ndarray) -> np.ndarray:
        """The leaf that a descent to the nearer child ends in."""
        at = np.ones(len(spots), np.int64)
        rows = np.arange(len(spots))
        while True:
            open_ = ~self.is_leaf[at]
            if not open_.any():
                return at
            who = rows[open_]
            left, right = 2 * at[open_], 2 * at[open_] + 1
            to_left = np.where(self.rows[left] > 0, self.nearest_corner(spots, who, left), np.inf)
            to_right = np.where(self.rows[right] > 0, self.nearest_corner(spots, who, right), np.inf)
            at[open_] = np.where(to_left <= to_right, left, right)

    def _slices(self, count: int):
        step = max(1, _PAIRS // max(1, int(self.is_leaf.sum())))
        for start in range(0, count, step):
            yield start, min(count, start + step)

    def within(self, spots: np.ndarray, limit: np.ndarray, seen: list, most: int | None):
        """(query, leaf) of the leaves that may hold a row within the squared distance ``limit``, the nearest first.

        Leaves in ``seen`` are left out; with ``most``, only so many a query.
        """
        found_q, found_n = [], []
        for start, stop in self._slices(len(spots)):
            query, node = np.arange(start, stop), np.ones(stop - start, np.int64)
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while len(query):
                near = self.nearest_corner(spots, query, node)
                keep = (near <= limit[query]) & (self.rows[node] > 0)
                query, node, near = query[keep], node[keep], near[keep]
                leaf = self.is_leaf[node]
                got.append((query[leaf], node[leaf], near[leaf]))
                query, node = np.repeat(query[~leaf], 2), np.repeat(2 * node[~leaf], 2)
                node[1::2] += 1
            query, node, near = (np.concatenate(x) for x in zip(*got)) if got else (np.empty(0, np.int64),) * 3
            old = np.fromiter((n in seen[q] for q, n in zip(query.tolist(), node.tolist())), bool, len(query))
            query, node, near = query[~old], node[~old], near[~old]
            order = np.lexsort((node, near, query))
            query, node = query[order], node[order]
            if most is not None:
                place = np.arange(len(query)) - np.searchsorted(query, query)
                query, node = query[place < most], node[place < most]
            found_q.append(query), found_n.append(node)
        return np.concatenate(found_q), np.concatenate(found_n)

    def count_within(self, spots: np.ndarray, sure: np.ndarray, limit: np.ndarray, rest: bool, widen: float):
        """Rows that are surely nearer than ``sure`` (squared), by whole subtrees, and (query, leaf) of the leaves in
        between, up to ``limit``. ``widen`` multiplies a greatest distance where the metric's may be so much more."""
        counted = np.zeros(len(spots), np.int64)
        found_q, found_n = [], []
        for start, stop in self._slices(len(spots)):
            query, node = np.arange(start, stop), np.ones(stop - start, np.int64)
            while len(query):
                near = self.nearest_corner(spots, query, node)
                keep = (near <= limit[query]) & (self.rows[node] > 0)
                query, node = query[keep], node[keep]
                inside = widen * self.farthest_corner(spots, query, node, rest) < sure[query]
                np.add.at(counted, query[inside], self.rows[node[inside]])
                query, node = query[~inside], node[~inside]
                leaf = self.is_leaf[node]
                found_q.append(query[leaf]), found_n.append(node[leaf])
                query, node = np.repeat(query[~leaf], 2), np.repeat(2 * node[~leaf], 2)
                node[1::2] += 1
        return counted, np.concatenate(found_q), np.concatenate(found_n)
