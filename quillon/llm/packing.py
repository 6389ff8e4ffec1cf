"""Packing token sequences of bounded length.

`pattern_pack` packs a whole corpus by its length histogram: patterns of few
lengths that fill a sequence, repeat counts by non-negative least squares,
rounded down, and best fit in bulk for what is left.  Only the histogram (at
most `size` counts) and the patterns reach the driver, whatever the corpus.

`BestFit` packs a bounded block of pieces in one task: best-fit decreasing
with a segment tree over remaining capacities.
"""

from __future__ import annotations

import numpy as np


def first_piece(total: int, size: int) -> int:
    """Length of the first piece of a document of total tokens: the remainder, or a full one."""
    return total % size or min(total, size)


def piece_bounds(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than size."""
    if total <= size:
        return [(0, total)]
    head = first_piece(total, size)
    return [(0, head), *((x, size) for x in range(head, total, size))]


# --------------------------------------------------------------------------- patterns


def patterns(size: int, parts: int = 3) -> np.ndarray:
    """All multisets of at most three lengths that sum to size, as rows padded with 0."""
    rows = [np.array([[size, 0, 0]])]
    if parts >= 2:
        a = np.arange(size // 2, 0, -1)
        rows.append(np.stack([size - a, a, np.zeros_like(a)], 1))
    if parts >= 3:
        for c in range(1, size // 3 + 1):
            b = np.arange(c, (size - c) // 2 + 1)
            rows.append(np.stack([size - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(rows)


def nnls_counts(rows: np.ndarray, hist: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram.

    Least squares by projected accelerated gradient with restarts.  Residuals
    are weighted so that lengths left over cost more the longer they are.
    Sparse products are bincounts over the three entries of a row, so the
    work depends on `size` alone.
    """
    size = len(hist) - 1
    weight = np.sqrt(np.arange(size + 1) / size)
    weight[0] = 0
    target = hist * weight
    flat = rows.ravel()
    share = weight[flat].reshape(rows.shape)

    def forward(x):
        return np.bincount(flat, np.repeat(x, rows.shape[1]), size + 1) * weight

    def back(r):
        return (r[flat].reshape(rows.shape) * share).sum(1)

    v = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    step = 1 / (1.02 * top)
    x = y = np.zeros(len(rows))
    t, cost = 1.0, np.inf
    for _ in range(rounds):
        r = forward(y) - target
        now = float(r @ r)
        if now > cost:
            t, y = 1.0, x
            r = forward(y) - target
            now = float(r @ r)
        new = np.maximum(0, y - step * back(r))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - x)
        x, t, cost = new, s, now
    return x


def take_patterns(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Rounded repeat counts, largest first, never more than left has; left is lowered."""
    used = []
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        parts = [int(p) for p in rows[k] if p]
        need = {p: parts.count(p) for p in parts}
        n = min([int(round(x[k])), *(int(left[p]) // c for p, c in need.items())])
        if n > 0:
            for p, c in need.items():
                left[p] -= n * c
            used.append((tuple(parts), n))
    return used


def bulk_best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal bins and equal pieces move together.

    The work depends on the number of different lengths and fills, not on how
    many pieces there are.
    """
    size = len(left) - 1
    open_bins: list[list[list]] = [[] for _ in range(size + 1)]  # by room left: [composition, count]
    for length in range(size, 0, -1):
        n = int(left[length])
        while n > 0:
            room = next((r for r in range(length, size) if open_bins[r]), None)
            if room is None:
                each = min(size // length, n)
                bins, rest = divmod(n, each)
                if bins:
                    open_bins[size - each * length].append([(length,) * each, bins])
                if rest:
                    open_bins[size - rest * length].append([(length,) * rest, 1])
                n = 0
                continue
            parts, count = open_bins[room].pop()
            each = min(room // length, n)
            bins = min(count, n // each)
            if count > bins:
                open_bins[room].append([parts, count - bins])
            open_bins[room - each * length].append([parts + (length,) * each, bins])
            n -= bins * each
    left[:] = 0
    merged: dict[tuple[int, ...], int] = {}
    for bins in open_bins:
        for parts, count in bins:
            merged[parts] = merged.get(parts, 0) + count
    return list(merged.items())


class Plan:
    """Where the r-th piece of each length goes: sequence and offset."""

    def __init__(self, hist: np.ndarray, parts: int = 3, rounds: int = 600):
        hist = np.asarray(hist, np.int64)
        size = len(hist) - 1
        rows = patterns(size, parts)
        left = hist.copy()
        self.used = take_patterns(rows, nnls_counts(rows, hist.astype(float), rounds), left) if hist.sum() else []
        self.n_pattern = sum(n for _, n in self.used)
        self.used += bulk_best_fit(left)
        self.n_sequences = sum(n for _, n in self.used)
        slots, taken, sequence = [], np.zeros(size + 1, np.int64), 0
        for composition, n in self.used:
            offset, k = 0, 0
            while k < len(composition):
                length, many = composition[k], 1
                while k + many < len(composition) and composition[k + many] == length:
                    many += 1
                # ranks [from, from + n * many) of this length, dealt many to a sequence
                slots.append((length, int(taken[length]), sequence, offset, many))
                taken[length] += n * many
                offset += length * many
                k += many
            sequence += n
        slots.sort()
        table = np.array(slots, np.int64).reshape(-1, 5)
        self.key = (table[:, 0] << 44) | table[:, 1]
        self.length, self.start, self.sequence, self.offset, self.many = table.T

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks among their length."""
        k = np.searchsorted(self.key, (length << 44) | rank, side="right") - 1
        at = rank - self.start[k]
        return self.sequence[k] + at // self.many[k], self.offset[k] + at % self.many[k] * length


# --------------------------------------------------------------------------- best fit


class BestFit:
    """Best-fit decreasing for one block of pieces.

    A segment tree over capacities 0..size holds how many open bins have each
    room; the smallest room that is large enough is found in log(size) steps.
    """

    def __init__(self, size: int):
        self.size = size
        self.width = 1 << (size).bit_length()
        self.tree = [0] * (2 * self.width)
        self.rooms: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, change: int) -> None:
        k = self.width + room
        while k:
            self.tree[k] += change
            k >>= 1

    def _least(self, room: int) -> int | None:
        """The smallest room >= room that an open bin has."""
        k = self.width + room
        if self.tree[k]:
            return room
        while k > 1:
            if not k & 1 and self.tree[k + 1]:
                k += 1
                while k < self.width:
                    k <<= 1
                    if not self.tree[k]:
                        k += 1
                return k - self.width
            k >>= 1
        return None

    def pack(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(bin, offset) of each piece, and the number of bins."""
        where, offset, bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
        for i in np.argsort(-np.asarray(lengths), kind="stable"):
            length = int(lengths[i])
            room = self._least(length) if length < self.size else None
            if room is None:
                b, room = bins, self.size
                bins += 1
            else:
                b = self.rooms[room].pop()
                self._add(room, -1)
            where[i], offset[i] = b, self.size - room
            if room - length or length == 0:
                self.rooms[room - length].append(b)
                self._add(room - length, 1)
        return where, offset, bins
