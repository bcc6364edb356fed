"""The nearest rows, or how many rows are nearer, between one bounded block of queries and one of candidates.

Candidates lie in leaves with boxes on principal axes; queries that lie together form a group. A group looks at the nearest
leaves first and leaves out those its bounds rule out. Estimates in single precision (one matrix product where the
metric allows it) leave a few rows per query that can matter; only those get the exact score, summed feature by feature.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from stintworks.functions.boxes import AXES, Splits, box_coordinates, fit_splits, principal_axes

METRICS = ("euclidean", "manhattan", "cosine")
DECIMALS = 6
# Wider than one unit of the compared precision.
_SLACK = 2e-6
# Elements of one estimate matrix: small enough for a processor cache.
_ELEMENTS = 1 << 18
# Queries of a group, and rows of a leaf: smaller leaves of the tree are joined, greater ones split.
_GROUP_ROWS = 256
_LEAF_ROWS = 512
# Rows that may matter and are held for one group at a time.
_HITS = 1 << 21


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Exact score of each row pair: a distance, or the similarity for cosine."""
    total = np.zeros(len(a))
    squares = np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        if metric == "cosine":
            total += x * y
            squares = squares[0] + x * x, squares[1] + y * y
        else:
            gap = x - y
            total += np.abs(gap) if metric == "manhattan" else gap * gap
    if metric == "euclidean":
        return np.sqrt(total)
    if metric == "manhattan":
        return total
    product = np.sqrt(squares[0]) * np.sqrt(squares[1])
    return np.divide(total, product, out=np.zeros_like(total), where=product > 0)


def whole_order(values: np.ndarray, metric: str) -> np.ndarray:
    """Scores as whole numbers at the compared precision, smaller is nearer."""
    signed = -values if metric == "cosine" else values
    return np.floor(signed * 10**DECIMALS + 0.5).astype(np.int64)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def points_of(m: np.ndarray, metric: str) -> np.ndarray:
    """Points whose Euclidean distance bounds what the metric orders by.

    For cosine these are unit vectors; a zero vector gets an axis of its own, at the distance that
    belongs to similarity 0.
    """
    if metric != "cosine":
        return m
    return np.concatenate([_unit(m), (m == 0).all(axis=1, keepdims=True).astype(float)], axis=1)


def squared_limit(score: np.ndarray, metric: str, slack: float) -> np.ndarray:
    """The squared distance that belongs to a score, moved outward by ``slack``; no score has no limit.

    A Manhattan distance is never below the Euclidean one, so its bound holds for that.
    """
    limit = 2 - 2 * (score - slack) if metric == "cosine" else np.maximum(score + slack, 0.0) ** 2
    # Rotated coordinates carry rounding of their own.
    return np.where(np.isnan(score), np.inf, limit * (1 + 1e-9) + 1e-9) if slack > 0 else limit * (1 - 1e-9) - 1e-9


def _estimator(asked: np.ndarray, points: np.ndarray, metric: str):
    """``(estimate(rows, start, stop), error, scale)``: estimates of a group against consecutive candidates, the error of
    one, and what brings a score to their scale. Euclidean ones are squared."""
    dims = points.shape[1]
    unit = 2.0**-22 * (dims + 4)
    if metric == "cosine":
        left, right = _unit(asked).astype(np.float32), np.ascontiguousarray(_unit(points).T, np.float32)
        return lambda rows, start, stop: -(left[rows] @ right[:, start:stop]), unit, lambda score: -score
    longest = float(np.sqrt(max((asked * asked).sum(axis=1).max(), (points * points).sum(axis=1).max())))
    if metric == "manhattan":
        left, right = asked.astype(np.float32), np.ascontiguousarray(points.T, np.float32)

        def sums(rows, start, stop):
            total = np.zeros((len(rows), stop - start), np.float32)
            gap = np.empty_like(total)
            for i in range(dims):
                np.subtract(left[rows, i, None], right[i, start:stop], out=gap)
                np.abs(gap, out=gap)
                total += gap
            return total

        return sums, unit * dims * 2 * longest, lambda score: score
    squares, own = (points * points).sum(axis=1), (asked * asked).sum(axis=1).astype(np.float32)
    left, right = asked.astype(np.float32), np.ascontiguousarray(np.vstack([-2 * points.T, squares]), np.float32)

    def squared(rows, start, stop):
        part = np.concatenate([left[rows], np.ones((len(rows), 1), np.float32)], axis=1)
        total = part @ right[:, start:stop]
        total += own[rows][:, None]
        return total

    return squared, unit * (2 * longest) ** 2, lambda score: np.where(np.isinf(score), np.inf, np.maximum(score, 0) ** 2)


class _Block:
    """Candidates by leaves, queries by groups, both of one cohort."""

    def __init__(self, queries: pd.DataFrame, candidates: pd.DataFrame, metric: str, last: np.ndarray):
        """``last`` orders the queries before their places do, so that like ones share a group."""
        vectors = np.stack(candidates["vec"].to_numpy()).astype(float)
        points = points_of(vectors, metric)
        axes = principal_axes(points[:: max(1, len(points) // 8192)])
        spots = box_coordinates(points, axes)
        self.wide = points.shape[1] > AXES
        leaf = self._leaves(candidates["cell"].to_numpy(), spots)
        order = np.argsort(leaf, kind="stable")
        self.candidates, self.points, spots = candidates.iloc[order], vectors[order], spots[order]
        # The place of a row by key and season, by which ties go.
        codes, names = pd.factorize(self.candidates["key"], sort=True)
        by_key = np.lexsort((self.candidates["season"].to_numpy(), np.where(codes < 0, len(names), codes)))
        self.place = np.empty(len(by_key), np.int64)
        self.place[by_key] = np.arange(len(by_key))
        self.code = np.where(codes < 0, -2, codes)
        self.own_code = pd.Index(names).get_indexer(queries["key"])
        self.own_rows = np.where(self.own_code >= 0, np.bincount(codes[codes >= 0], minlength=len(names) + 1)[self.own_code], 0)
        starts = np.flatnonzero(np.r_[True, np.diff(leaf[order]) > 0])
        self.edges = np.r_[starts, len(order)]
        self.low, self.high = np.minimum.reduceat(spots, starts), np.maximum.reduceat(spots, starts)
        self.asked = np.stack(queries["vec"].to_numpy()).astype(float)
        self.spots = box_coordinates(points_of(self.asked, metric), axes)
        middles = (self.low + self.high) / 2
        home = np.empty(len(queries), np.int64)
        for start in range(0, len(home), 4096):
            near = (middles * middles).sum(axis=1) - 2 * self.spots[start : start + 4096] @ middles.T
            home[start : start + 4096] = near.argmin(axis=1)
        self.order = np.lexsort((home, last))
        self.estimate, self.error, self.scale = _estimator(self.asked, self.points, metric)

    @staticmethod
    def _leaves(cells: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Leaves of the tree in its order, small neighbours joined; split here where they are greater."""
        numbers, inverse, sizes = np.unique(cells, return_inverse=True, return_counts=True)
        if len(spots) > _LEAF_ROWS and sizes.max() > 2 * _LEAF_ROWS:
            depth = int(np.ceil(np.log2(len(spots) / _LEAF_ROWS)))
            chosen = spots[:: max(1, len(spots) // (32 << depth))]
            cells = Splits(*fit_splits(chosen[:, :AXES], depth)).leaf(spots)
            numbers, inverse, sizes = np.unique(cells, return_inverse=True, return_counts=True)
        depth = max(int(n).bit_length() for n in numbers)
        along = np.argsort([int(n) << (depth - int(n).bit_length()) for n in numbers], kind="stable")
        joined = np.empty(len(numbers), np.int64)
        joined[along] = (np.cumsum(sizes[along]) - 1) // _LEAF_ROWS
        return joined[inverse]

    def groups(self, most: np.ndarray):
        """Queries in groups: near each other, and few where many rows may matter."""
        start = 0
        while start < len(self.order):
            stop = min(len(self.order), start + max(1, min(_GROUP_ROWS, _HITS // int(max(1, most[self.order[start]])))))
            yield self.order[start:stop]
            start = stop

    def near_each(self, rows: np.ndarray) -> np.ndarray:
        """Least squared distance from each query of a group to each leaf."""
        total = np.zeros((len(rows), len(self.low)))
        for i in range(self.low.shape[1]):
            spot = self.spots[rows, i, None]
            gap = np.maximum(np.maximum(self.low[:, i] - spot, spot - self.high[:, i]), 0)
            total += gap * gap
        return total

    def near(self, rows: np.ndarray) -> np.ndarray:
        """Least squared distance from a group to each leaf."""
        low, high = self.spots[rows].min(axis=0), self.spots[rows].max(axis=0)
        gap = np.maximum(np.maximum(self.low - high, low - self.high), 0)
        return (gap * gap).sum(axis=1)

    def far(self, rows: np.ndarray) -> np.ndarray:
        """Greatest squared distance; the last of many coordinates is a length, whose directions may be opposite."""
        low, high = self.spots[rows].min(axis=0), self.spots[rows].max(axis=0)
        gap = np.maximum(self.high - low, high - self.low)
        if self.wide:
            gap[:, -1] = self.high[:, -1] + high[-1]
        return (gap * gap).sum(axis=1)

    def runs(self, leaves: np.ndarray, rows: int):
        """Consecutive candidates ``(start, stop)`` of the leaves, as much as one estimate matrix holds."""
        step = max(1, _ELEMENTS // rows)
        leaves = np.sort(leaves)
        for part in np.split(leaves, np.flatnonzero(np.diff(leaves) > 1) + 1) if len(leaves) else []:
            for start in range(self.edges[part[0]], self.edges[part[-1] + 1], step):
                yield start, min(start + step, self.edges[part[-1] + 1])


def nearest_in_block(metric: str, every_score: bool = False):
    """Function for a co-grouped (queries, candidates) pair: the ``k`` nearest of each query, each with a k of its own.

    A candidate with the query's own key is skipped; equal distances go by key, then season. Where a
    query brings a ``score``, no candidate beyond it is returned. Queries of similar k go together, so that
    one that wants many rows does not widen the others' selection. A query with ``ranks`` gets these and the last one only.
    """
    columns = ["target_id", "key", "season", "rank", "score", *(METRICS if every_score else ())]

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            return pd.DataFrame({c: [] for c in columns})
        wanted = np.minimum(queries["k"].to_numpy().astype(np.int64), len(candidates))
        block = _Block(queries, candidates, metric, np.ceil(np.log2(np.maximum(wanted, 1))))
        given = queries["score"].to_numpy(dtype=float)
        ranks = queries["ranks"].to_numpy()
        kept = [_nearest_of(block, rows, wanted, given, ranks, metric) for rows in block.groups(wanted)]
        rows, spots, rank, score = (np.concatenate(parts) for parts in zip(*kept))
        found = {
            "target_id": queries["target_id"].to_numpy()[rows],
            "key": block.candidates["key"].to_numpy()[spots],
            "season": block.candidates["season"].to_numpy()[spots],
            "rank": rank,
            "score": score,
        }
        if every_score:
            found |= {m: scores(block.asked[rows], block.points[spots], m) for m in METRICS}
        return pd.DataFrame(found)[columns]

    return search


def _nearest_of(block: _Block, rows: np.ndarray, wanted: np.ndarray, given: np.ndarray, ranks: np.ndarray, metric: str):
    """(query, candidate, rank, score) of one group."""
    least = wanted[rows]
    unbounded = -np.inf if metric == "cosine" else np.inf
    bound = np.where(np.isnan(given[rows]), unbounded, given[rows])  # a score that no nearest row exceeds
    each = block.near_each(rows)
    near = each.min(axis=0)
    line = np.argsort(each.mean(axis=0), kind="stable")
    sizes = np.diff(block.edges)
    who, spots, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    place, first = 0, max(4 * int(least.max()), 2 * _LEAF_ROWS)
    while place < len(line):
        reach = np.searchsorted(np.cumsum(sizes[line[place:]]), first) + 1
        leaves = line[place : place + reach]
        place, first = place + reach, first * 4
        # Each query leaves out the leaves that its own bound rules out.
        limit = squared_limit(np.where(np.isinf(bound), np.nan, bound), metric, _SLACK)
        leaves = leaves[near[leaves] <= limit.max()]
        more = [(who, spots, score)]
        edges = block.scale(bound - _SLACK if metric == "cosine" else bound + _SLACK) + block.error
        for start, stop in block.runs(leaves, len(rows)):
            first_leaf, last_leaf = np.searchsorted(block.edges, [start, stop - 1], side="right") - 1
            asking = np.flatnonzero(each[:, first_leaf : last_leaf + 1].min(axis=1) <= limit)
            if not len(asking):
                continue
            own = rows[asking]
            estimate = block.estimate(own, start, stop)
            edge = edges[asking]
            if np.isinf(edge).any() and stop - start > int((least[asking] + block.own_rows[own]).max()):
                # The k-th of the estimates that are not its own is a bound, too.
                depth = least[asking] + block.own_rows[own] - 1
                lowest = np.sort(np.partition(estimate, int(depth.max()), axis=1)[:, : int(depth.max()) + 1], axis=1)
                kth = lowest[np.arange(len(own)), depth].astype(float)
                slack = 4 * _SLACK * (1 + np.sqrt(np.abs(kth) + block.error)) + 2 * block.error
                edge = np.minimum(edge, kth + slack)
            # Flat places: much faster than looking for rows and columns at once.
            hit = np.flatnonzero(estimate <= edge[:, None])
            q, c = hit // (stop - start), hit % (stop - start)
            q, c = asking[q], c + start
            other = block.code[c] != block.own_code[rows[q]]
            q, c = q[other], c[other]
            more.append((q, c, scores(block.asked[rows[q]], block.points[c], metric)))
        who, spots, score = (np.concatenate(parts) for parts in zip(*more))
        whole = whole_order(score, metric)
        best = np.lexsort((block.place[spots], whole, who))
        who, spots, score = who[best], spots[best], score[best]
        rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
        kept = rank <= least[who]
        who, spots, score, rank = who[kept], spots[kept], score[kept], rank[kept]
        full = np.flatnonzero(rank == least[who])
        tighter = np.minimum if metric != "cosine" else np.maximum
        bound[who[full]] = tighter(bound[who[full]], score[full])
    rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
    beyond = (score < given[rows[who]] - _SLACK) if metric == "cosine" else (score > given[rows[who]] + _SLACK)
    final = np.r_[who[1:] != who[:-1], True] if len(who) else np.empty(0, bool)
    choosy = np.array([r is not None for r in ranks[rows]], bool)
    shown = ~choosy[who] | final
    begin, number = np.searchsorted(who, np.arange(len(rows))), np.bincount(who, minlength=len(rows))
    for query in np.flatnonzero(choosy):
        asked = np.asarray(ranks[rows[query]], np.int64)
        shown[begin[query] + asked[(asked >= 1) & (asked <= number[query])] - 1] = True
    kept = ~beyond & shown
    return rows[who[kept]], spots[kept], rank[kept], score[kept]


def nearer_in_block(metric: str):
    """Function for a co-grouped pair: how many candidates come before each query's named one, own rows left out."""

    def count(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            return pd.DataFrame({"target_id": [], "nearer": []})
        score = queries["score"].to_numpy(dtype=float)
        block = _Block(queries, candidates, metric, np.zeros(len(queries)))
        limit = whole_order(score, metric)
        ordered = block.candidates.iloc[np.argsort(block.place)]
        names = pd.MultiIndex.from_frame(ordered[["key", "season"]])
        named = pd.MultiIndex.from_frame(queries[["other_key", "other_season"]].set_axis(["key", "season"], axis=1))
        before = np.asarray(names.searchsorted(named))
        sizes = np.diff(block.edges)
        nearer = np.zeros(len(queries), dtype=np.int64)

        def first(q, c):
            order = whole_order(scores(block.asked[q], block.points[c], metric), metric)
            return (order < limit[q]) | ((order == limit[q]) & (block.place[c] < before[q]))

        for rows in block.groups(np.ones(len(queries))):
            near, far = block.near(rows), block.far(rows)
            sure = squared_limit(score[rows], metric, -_SLACK).min()
            if metric == "cosine" and not block.asked[rows].any(axis=1).all():
                sure = -1.0  # all rows are equally unlike a zero vector, the zero ones too
            # A Manhattan distance is at most the root of the dimensions times the Euclidean one.
            inside = (block.points.shape[1] if metric == "manhattan" else 1) * far < sure
            nearer[rows] += sizes[inside].sum()
            between = np.flatnonzero(~inside & (near <= squared_limit(score[rows], metric, _SLACK).max()))
            signs = (1, -1) if metric == "cosine" else (-1, 1)
            low = block.scale(np.maximum(score[rows] + signs[0] * _SLACK, -2 if metric == "cosine" else 0)) - block.error
            high = block.scale(score[rows] + signs[1] * _SLACK) + block.error
            for start, stop in block.runs(between, len(rows)):
                estimate = block.estimate(rows, start, stop)
                below = estimate < low[:, None]
                nearer[rows] += below.sum(axis=1)
                q, c = np.nonzero(~below & (estimate <= high[:, None]))
                hit = first(rows[q], c + start)
                nearer += np.bincount(rows[q[hit]], minlength=len(queries))
        # Own rows were counted like all others.
        by_code = np.argsort(block.code, kind="stable")
        start = np.searchsorted(block.code[by_code], block.own_code)
        q = np.repeat(np.arange(len(queries)), block.own_rows)
        c = by_code[np.repeat(start - np.cumsum(block.own_rows) + block.own_rows, block.own_rows) + np.arange(len(q))]
        nearer -= np.bincount(q[first(q, c)], minlength=len(queries))
        return pd.DataFrame({"target_id": queries["target_id"].to_numpy(), "nearer": nearer})

    return count
