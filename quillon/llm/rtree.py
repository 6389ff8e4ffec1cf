"""An R-tree over count vectors.

Points are counts of a set's members by hash group.  The overlap of two sets
is at most the sum over the groups of the smaller count, and for a box of
points at most that with the box's upper corner; boxes and points whose
bound is under the overlap needed are not followed.

Sums of minima of many queries and boxes are one matrix product, as
min(a, b) is the number of thresholds t >= 1 that both reach.
"""

from __future__ import annotations

import numpy as np

#: Up to this largest count the thresholds go through a matrix product; beyond, groups are taken one by one.
PRODUCT_COUNT = 8


def summed_minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of sums over coordinates of min(a[i], b[j])."""
    top = int(min(a.max(initial=0), b.max(initial=0)))
    if top <= PRODUCT_COUNT:
        steps = range(1, top + 1)
        left = np.concatenate([(a >= t) for t in steps] or [np.zeros((len(a), 0))], axis=1).astype(np.float32)
        right = np.concatenate([(b >= t) for t in steps] or [np.zeros((len(b), 0))], axis=1).astype(np.float32)
        return np.rint(left @ right.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for g in range(a.shape[1]):
        out += np.minimum(a[:, g, None], b[None, :, g])
    return out


class CountTree:
    """Packed tree: points in order of size, then of their largest-spread coordinates; boxes of `fan` children."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        points = np.asarray(points, np.int32)
        spread = np.argsort(-points.var(0))[:2] if len(points) else [0, 1]
        keys = [points[:, k] for k in reversed(spread)] if len(points) else []
        self.order = np.lexsort((*keys, sizes)) if len(points) else np.zeros(0, np.int64)
        self.points, self.sizes, self.fan = points[self.order], np.asarray(sizes)[self.order], fan
        self.levels = [(self.points, self.sizes, self.sizes)]  # (upper corners, smallest sizes, largest sizes), points first
        while len(self.levels[-1][0]) > fan:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), fan)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def search(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose bound allows den * intersection >= num * union; only those wanted, if that matrix is given."""
        points, sizes = np.asarray(points, np.int32), np.asarray(sizes)
        if not len(self.points) or not len(points):
            z = np.zeros(0, np.int64)
            return z, z
        if len(self.levels) == 1 and wanted is not None:  # a leaf alone
            query, at = np.nonzero(wanted[:, self.order])
            low = np.minimum(points[query], self.points[at]).sum(1, dtype=np.int64)
            a, b = sizes[query], self.sizes[at]
            keep = (den * a >= num * b) & (den * b >= num * a) & ((num + den) * low >= num * (a + b))
            return query[keep], self.order[at[keep]]
        node = np.arange(len(self.levels[-1][0]))
        open_ = np.ones((len(points), len(node)), bool)
        for k in reversed(range(len(self.levels))):
            top, low, high = (x[node] for x in self.levels[k])
            open_ &= (den * sizes[:, None] >= num * low) & (den * high >= num * sizes[:, None])
            if not k and wanted is not None:
                open_ &= wanted[:, self.order[node]]
                some = np.flatnonzero(open_.any(0))
                node, open_, top, low = node[some], open_[:, some], top[some], low[some]
            # union = n + m - overlap for a size m in low..high; the smallest m that can match decides
            m = np.maximum(low, -(-num * sizes[:, None] // den))
            open_ &= (num + den) * summed_minima(points, top) >= num * (sizes[:, None] + m)
            if k:
                alive = np.flatnonzero(open_.any(0))
                child = (node[alive][:, None] * self.fan + np.arange(self.fan)).ravel()
                inside = child < len(self.levels[k - 1][0])
                node, open_ = child[inside], np.repeat(open_[:, alive], self.fan, axis=1)[:, inside]
        query, at = np.nonzero(open_)
        return query, self.order[node[at]]
