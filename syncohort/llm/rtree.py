"""A page of an STR-packed R-tree, searched best-first for greatest inner products.

Rows of a page are packed by sort-tile-recursive into leaves, leaves into inner nodes.
A minimum bounding box holds, for every coordinate, the interval of its rows; with an
anchor it bounds their inner products from above and below. A queue takes the node with
the greatest bound first. Nodes outside an anchor's score windows, or strictly below the
k-th score it already has, are pruned.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

LEAF, FANOUT = 256, 8
#: No score yet, and a window that nothing falls into.
LOWEST = np.iinfo(np.int64).min
NEVER = np.iinfo(np.int64).max


def pack(rows: np.ndarray) -> np.ndarray:
    """An order of the rows in which every run of LEAF rows is a leaf.

    Tiles along the coordinate with the widest interval, each tile again along its own.
    """
    order = np.arange(len(rows))
    todo, done = [(0, len(rows))], []
    while todo:
        start, end = todo.pop()
        leaves = -(-(end - start) // LEAF)
        if leaves <= 1:
            done.append((start, end))
            continue
        part = rows[order[start:end]]
        axis = int(np.argmax(part.max(0) - part.min(0))) if part.shape[1] else 0
        if part.shape[1]:
            order[start:end] = order[start:end][np.argsort(part[:, axis], kind="stable")]
        # Slabs of whole leaves, as many as give even tiles over the coordinates left.
        slabs = min(leaves, 4)
        step = -(-leaves // slabs) * LEAF
        todo += [(a, min(a + step, end)) for a in range(start, end, step)]
    return order


def boxes(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of each run of `size` rows."""
    starts = np.arange(0, len(rows), size)
    return np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any point of each box."""
    plus, minus = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
    # Covers rounding where sums pass 2^53; far below one otherwise.
    slack = 1e-12 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
    least = plus @ low.T + minus @ high.T - slack
    return least, plus @ high.T + minus @ low.T + slack


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors held as floats."""
    norms = [np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0)) for x in (anchors, rows)]
    # No partial sum exceeds the product of the norms.
    most = norms[0] * norms[1] * (1 + 1e-9)
    if most < 2**24:
        return (anchors.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


@dataclass
class Best:
    """The first `count` (greater score, then smaller id) of every anchor and window."""

    anchor: np.ndarray
    score: np.ndarray
    id: np.ndarray

    @classmethod
    def none(cls) -> Best:
        return cls(*[np.zeros(0, np.int64) for _ in range(3)])

    def add(self, anchor: np.ndarray, score: np.ndarray, id: np.ndarray, count: int) -> Best:
        a, s, i = (
            np.concatenate(x) for x in ((self.anchor, anchor), (self.score, score), (self.id, id))
        )
        order = np.lexsort((i, -s, a))
        a, s, i = a[order], s[order], i[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        return Best(a[place < count], s[place < count], i[place < count])

    def kth(self, anchors: int, count: int) -> np.ndarray:
        """The count-th score of every anchor, LOWEST for those that have fewer."""
        out = np.full(anchors, LOWEST)
        ends = np.searchsorted(self.anchor, np.arange(anchors + 1))
        full = ends[1:] - ends[:-1] >= count
        out[full] = self.score[ends[1:][full] - 1]
        return out


@dataclass
class Visits:
    """Leaves evaluated and pruned, counted per anchor."""

    evaluated: int = 0
    pruned: int = 0


class Page:
    """Rows in packed order with their ids and labels, and the tree over them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.rows, self.ids, self.labels = rows, ids, labels
        exact = rows.astype(float)
        leaves = boxes(exact, LEAF)
        inner = boxes(exact, LEAF * FANOUT)
        self.low, self.high = (np.concatenate(x) for x in zip(leaves, inner))
        self.leaves = len(leaves[0])

    def search(
        self,
        anchors: np.ndarray,
        allowed,
        low: np.ndarray,
        high: np.ndarray,
        kth: np.ndarray,
        count: int,
        visits: Visits | None = None,
    ) -> list[Best]:
        """For window j, the first `count` rows of every anchor with score in [low, high].

        low, high and kth have a row per anchor and a column per window; rows with a
        score strictly below kth are not needed. allowed(some anchors, a slice of rows)
        masks the pairs that may be taken.
        """
        windows = low.shape[1]
        kth = kth.copy()
        best = [Best.none() for _ in range(windows)]
        least, most = bounds(anchors.astype(float), self.low, self.high)

        def wanted(node: int) -> np.ndarray:
            over, under = most[:, node, None], least[:, node, None]
            return (over >= np.maximum(low, kth)) & (under <= high)

        def push(node: int) -> None:
            open_ = wanted(node).any(1)
            if open_.any():
                heapq.heappush(queue, (-most[open_, node].max(), node))
            elif visits and node < self.leaves:
                visits.pruned += len(anchors)

        queue: list[tuple[float, int]] = []
        for node in range(self.leaves, len(self.low)):
            push(node)
        while queue:
            _, node = heapq.heappop(queue)
            if node >= self.leaves:
                first = (node - self.leaves) * FANOUT
                for child in range(first, min(first + FANOUT, self.leaves)):
                    push(child)
                continue
            some = np.flatnonzero(wanted(node).any(1))
            if visits:
                visits.evaluated += len(some)
                visits.pruned += len(anchors) - len(some)
            if not len(some):
                continue
            at = slice(node * LEAF, min((node + 1) * LEAF, len(self.rows)))
            scores = products(anchors[some], self.rows[at])
            may = allowed(some, at)
            ids = self.ids[at]
            for j in range(windows):
                floor = np.maximum(low[some, j], kth[some, j])
                hit = may & (scores >= floor[:, None]) & (scores <= high[some, j, None])
                a, c = np.nonzero(hit)
                if len(a):
                    best[j] = best[j].add(some[a], scores[a, c], ids[c], count)
                    kth[:, j] = np.maximum(kth[:, j], best[j].kth(len(anchors), count))
        return best
