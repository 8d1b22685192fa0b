"""Vantage-point trees over norm-augmented vectors, for searches by inner product within score windows.

With one more coordinate, sqrt(M - |x|^2) for the largest squared norm M, every row x has norm sqrt(M), and a query q, whose
further coordinate is 0, has |q - x|^2 = |q|^2 + M - 2 q.x: a window of scores is an annulus of distances around q. Nodes
split their rows at a median distance from a vantage point; the triangle inequality bounds the scores of each leaf, leaves
are visited nearest first, and a visit ends when no leaf left can hold a row of use. Many queries go through a tree
together, each in its own order. Bounds have some slack for rounding; scores themselves are exact integers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LOWEST = np.iinfo(np.int64).min


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with their further coordinate; ``most`` is the largest squared norm of all rows."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x**2).sum(1), 0))[:, None]], 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1), 0))


@dataclass
class Tree:
    """Vantage points; and by leaf its rows (or none) and on the way to it (vantage point, least and largest distance)."""

    points: np.ndarray
    leaves: list[np.ndarray]
    ways: list[list[tuple[int, float, float]]]
    #: By node: vantage point (or -1 for a leaf), median, and the nodes (or the leaf's number) below.
    nodes: list[tuple[int, float, int, int]] = field(default_factory=list)

    def bounds(self, q: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(largest, least) possible score of each query with each leaf's rows."""
        near, far = np.zeros((len(q), len(self.leaves))), np.full((len(q), len(self.leaves)), np.inf)
        wide = np.concatenate([q, np.zeros((len(q), 1))], 1)
        at = distances(wide, self.points) if len(self.points) else np.zeros((len(q), 0))
        for k, way in enumerate(self.ways):
            for p, low, high in way:
                np.maximum(near[:, k], np.maximum(at[:, p] - high, low - at[:, p]), out=near[:, k])
                np.minimum(far[:, k], at[:, p] + high, out=far[:, k])
        total = ((q**2).sum(1) + most)[:, None]
        slack = 1e-6 * total + 1
        return (total - near**2) / 2 + slack, (total - far**2) / 2 - slack

    def route(self, wide: np.ndarray) -> np.ndarray:
        """The leaf of each augmented row."""
        out = np.zeros(len(wide), np.int64)
        todo = [(0, np.arange(len(wide)))]
        while todo:
            k, rows = todo.pop()
            p, median, low, high = self.nodes[k]
            if p < 0:
                out[rows] = low
            elif len(rows):
                inner = distances(wide[rows], self.points[p : p + 1])[:, 0] <= median
                todo += [(low, rows[inner]), (high, rows[~inner])]
        return out


def grow(wide: np.ndarray, parts: int | None = None, most_rows: int = 1 << 62) -> Tree:
    """A tree with ``parts`` leaves (fewer where rows can't be told apart), or with leaves of ``most_rows`` rows at most.

    With ``parts`` a leaf's bounds hold for whatever is routed to it, otherwise for its own rows. A vantage point is the
    row farthest from the node's first; rows at one distance from it are cut in the middle where leaves are of given size.
    """
    points: list[np.ndarray] = []
    leaves: list[np.ndarray] = []
    ways: list[list[tuple[int, float, float]]] = []
    nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, 0, 0)]
    todo = [(0, np.arange(len(wide)), parts or 1, [])]
    while todo:
        k, rows, share, way = todo.pop()
        if not (share > 1 and len(rows) > 1 if parts else len(rows) > most_rows):
            nodes[k] = (-1, 0.0, len(leaves), 0)
            leaves.append(rows)
            ways.append(way)
            continue
        own = wide[rows]
        start = distances(own, own[:1])[:, 0]
        at = distances(own, own[int(start.argmax())][None])[:, 0]
        below = share // 2 if parts else 1
        order = np.argsort(at, kind="stable")
        cut = max(1, len(rows) * below // share) if parts else len(rows) // 2
        median = at[order[cut - 1]]
        inner = at <= median
        if inner.all():
            if parts:
                todo.append((k, rows, 1, way))
                continue
            inner = np.zeros(len(rows), bool)
            inner[order[:cut]] = True
        p = len(points)
        points.append(own[int(start.argmax())])
        spans = ((0.0, median), (median, np.inf)) if parts else tuple((at[m].min(), at[m].max()) for m in (inner, ~inner))
        nodes[k] = (p, median, len(nodes), len(nodes) + 1)
        nodes += [(-1, 0.0, 0, 0)] * 2
        for side, m, n, (low, high) in ((2, ~inner, share - below, spans[1]), (1, inner, below, spans[0])):
            todo.append((len(nodes) - 3 + side, rows[m], n, [*way, (p, low, high)]))
    return Tree(np.array(points).reshape(len(points), wide.shape[1]), leaves, ways, nodes)


@dataclass
class Asked:
    """Queries with their labels and windows: of each, scores from ``low`` to ``high`` count, and of those only from ``start`` on,
    which ``k`` rows are known to reach. ``same``: rows of the query's label are wanted, or those of others."""

    q: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray
    start: np.ndarray
    same: bool
    k: int

    def pick(self, which: np.ndarray) -> Asked:
        return Asked(self.q[which], self.label[which], self.low[which], self.high[which], self.start[which], self.same, self.k)


def candidates(asked: Asked, x: np.ndarray, label: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, window, row, score) of the rows x that count, with scores of ``least`` at least by query and window."""
    score = asked.q @ x.T.astype(asked.q.dtype)
    fits = (asked.label[:, None] == label) == asked.same
    found = []
    for w in range(asked.low.shape[1]):
        low, high = np.maximum(asked.low[:, w], least[:, w]), asked.high[:, w]
        query, row = np.nonzero(fits & (score >= low[:, None]) & (score <= high[:, None]))
        found.append((query, np.full(len(query), w), row, score[query, row].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def best(group: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Which of the entries are among the first k of their group, by falling score, then by ``first``; in that order."""
    order = np.lexsort((first, -score, group))
    sorted_group = group[order]
    starts = np.flatnonzero(np.append(True, sorted_group[1:] != sorted_group[:-1])) if len(order) else np.empty(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def search(tree: Tree, x: np.ndarray, label: np.ndarray, first: np.ndarray, most: float, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, window, row, score) of the first k rows of each query and window, ties by ``first``, where rows reach ``start``."""
    n, windows = asked.low.shape
    high, low = tree.bounds(asked.q.astype(np.float64), most)
    order = np.argsort(-high, axis=1, kind="stable")
    least = asked.start.copy()
    held = tuple(np.empty(0, np.int64) for _ in range(4))
    open_ = np.arange(n)
    for turn in range(len(tree.leaves)):
        leaf = order[open_, turn]
        reach = high[open_, leaf][:, None] >= np.maximum(least, asked.low)[open_]
        open_, leaf, reach = (v[reach.any(1)] for v in (open_, leaf, reach))
        if not len(open_):
            break
        useful = (reach & (low[open_, leaf][:, None] <= asked.high[open_])).any(1)
        found = [held]
        for k in np.unique(leaf[useful]):
            who, rows = open_[useful & (leaf == k)], tree.leaves[k]
            query, window, row, score = candidates(asked.pick(who), x[rows], label[rows], least[who])
            found.append((who[query], window, rows[row], score))
        if len(found) > 1:
            query, window, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
            kept = best(query * windows + window, score, first[row], asked.k)
            held = (query[kept], window[kept], row[kept], score[kept])
            group = held[0] * windows + held[1]
            count = np.bincount(group, minlength=n * windows)
            last = np.flatnonzero(np.append(group[1:] != group[:-1], True)) if len(group) else group
            full = count[group[last]] >= asked.k
            np.maximum.at(least.reshape(-1), group[last][full], held[3][last][full])
    return held
