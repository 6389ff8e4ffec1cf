"""Gradient-boosted trees grown by leaf, over binned columns, for all folds at once.

Columns are cut at quantiles into at most 255 bins.  A round grows one tree
for every fold's model together: a pass over the rows sums gradients by (model,
open leaf, column, bin), which combines in tasks before it is shuffled, and
only these sums reach the driver.  The best leaf is split first, up to a number
of leaves; as the order depends on gains alone, a pass opens all leaves that
may be next, and the tree is the one that splitting leaf by leaf gives.  A
model stops when the area under the curve of its held fold no longer rises.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.tables import cut, new_path, removed

#: Bins of a score when the area under the curve is taken: rows of one bin count as ties.
SCORE_BINS = 1 << 12


@dataclass
class Tree:
    """Nodes in arrays, the root first; feature -1 marks a leaf; rows with a bin of at most `split` go left."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        at = np.zeros(len(bins), np.int64)
        while True:
            rows = np.flatnonzero(self.feature[at] >= 0)
            if not len(rows):
                return at
            node = at[rows]
            low = bins[rows, self.feature[node]] <= self.split[node]
            at[rows] = np.where(low, self.left[node], self.right[node])

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


@dataclass
class How:
    """Settings; the defaults are those of the scoring task that this serves."""

    rounds: int = 3000
    leaves: int = 64
    depth: int = 12
    rate: float = 0.1
    l1: float = 0.1
    l2: float = 10.0
    bins: int = 255
    random_splits: bool = True
    columns_of_tree: float = 0.9
    columns_of_node: float = 0.9
    least_rows: int = 20
    least_hessian: float = 1e-3
    patience: int = 50
    seed: int = 42


@dataclass
class BoostedTrees:
    """One model a fold: its first score, its trees, and how many of them the held fold chose."""

    features: list[str]
    cuts: list[np.ndarray]
    folds: list[int]
    base: list[float]
    trees: list[list[Tree]]
    best: list[int]
    areas: list[list[float]] = field(default_factory=list)

    def score(self, k: int, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base[k])
        for tree in self.trees[k][: self.best[k]]:
            total += tree.scores(bins)
        return total

    def transform(self, df: DataFrame, key: str, fold: str | None = None) -> DataFrame:
        """(key, prob): of a row's own held-out model where `fold` is told, else the mean over the models."""
        schema = T.StructType([df.schema[key], T.StructField("prob", T.DoubleType())])
        plain = df.select(key, (F.col(fold) if fold else F.lit(0)).cast("long").alias("_f"), *(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in self.features))

        def run(batches):
            for batch in batches:
                bins = _binned(batch, 2, self.cuts)
                own = batch.column(1).to_numpy()
                each = np.array([1 / (1 + np.exp(-self.score(k, bins))) for k in range(len(self.folds))])
                chosen = each.mean(axis=0) if fold is None else np.where(own == np.array(self.folds)[:, None], each, 0).sum(axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen)], names=[key, "prob"])

        return plain.mapInArrow(run, schema)

    def importances(self, spark) -> DataFrame:
        """(fold, feature, importance, trees): the share of all gains that splits by each feature have."""
        rows = []
        for k, fold in enumerate(self.folds):
            gain = np.zeros(len(self.features))
            for tree in self.trees[k][: self.best[k]]:
                inner = tree.feature >= 0
                np.add.at(gain, tree.feature[inner], tree.gain[inner])
            total = gain.sum() or 1.0
            rows += [(int(fold), name, float(g / total), self.best[k]) for name, g in zip(self.features, gain)]
        return spark.createDataFrame(rows, "fold int, feature string, importance double, trees int")


def _binned(batch: pa.RecordBatch, first: int, cuts: list[np.ndarray]) -> np.ndarray:
    columns = [np.searchsorted(c, batch.column(first + j).to_numpy(zero_copy_only=False), side="left") for j, c in enumerate(cuts)]
    return np.stack(columns, axis=1).astype(np.int16) if columns else np.zeros((batch.num_rows, 0), np.int16)


def quantile_cuts(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 1 distinct values of each column, at its approximate quantiles; one pass for all."""
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    got = df.agg(*(F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)), shares, 10_000).alias(f"_{j}") for j, c in enumerate(features))).first()
    return [np.unique(np.array(got[j] or [], float)) for j in range(len(features))]


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def _worth(g, h, how: How):
    return _shrunk(g, how.l1) ** 2 / (h + how.l2)


def best_split(sums: np.ndarray, how: How, columns: np.ndarray, rng: np.random.Generator) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, column, bin, sums of the left part) of a leaf's best split; sums are (columns, bins, 3) of gradient, hessian and rows.

    With random splits, one bin of each column, between the first and the last
    that have rows, is tried; else all.  Ties go to the first column and bin.
    """
    total = sums[0].sum(axis=0)
    best = None
    for j in columns:
        left = np.cumsum(sums[j], axis=0)
        some = np.flatnonzero(sums[j][:, 2] > 0)
        if len(some) < 2:
            continue
        tried = np.array([rng.integers(some[0], some[-1])]) if how.random_splits else np.arange(some[0], some[-1])
        right = total - left[tried]
        here = left[tried]
        gains = _worth(here[:, 0], here[:, 1], how) + _worth(right[:, 0], right[:, 1], how) - _worth(total[0], total[1], how)
        fits = (here[:, 2] >= how.least_rows) & (right[:, 2] >= how.least_rows) & (here[:, 1] >= how.least_hessian) & (right[:, 1] >= how.least_hessian)
        gains = np.where(fits, gains, -np.inf)
        k = int(gains.argmax())
        if gains[k] > 1e-12 and (best is None or gains[k] > best[0]):
            best = (float(gains[k]), int(j), int(tried[k]), here[k])
    return best


class _Growing:
    """A tree while it grows.  Nodes are numbered by path: 1, and 2 n and 2 n + 1 below n."""

    def __init__(self, model: int, turn: int, columns: int, how: How):
        self.how, self.model, self.turn = how, model, turn
        rng = np.random.default_rng([how.seed, model, turn])
        self.columns = np.sort(rng.permutation(columns)[: max(1, round(columns * how.columns_of_tree))])
        self.splits: dict[int, tuple[float, int, int] | None] = {}
        self.sums: dict[int, np.ndarray] = {}

    def take(self, node: int, sums: np.ndarray) -> None:
        """Decides a leaf's split from its sums (columns, bins, 3)."""
        rng = np.random.default_rng([self.how.seed, self.model, self.turn, node])
        chosen = np.sort(rng.permutation(self.columns)[: max(1, round(len(self.columns) * self.how.columns_of_node))])
        self.sums.setdefault(node, sums[0].sum(axis=0))
        found = best_split(sums, self.how, chosen, rng) if node.bit_length() <= self.how.depth else None
        self.splits[node] = found and found[:3]
        if found:
            self.sums[2 * node], self.sums[2 * node + 1] = found[3], self.sums[node] - found[3]

    def chosen(self) -> tuple[set[int], list[int]]:
        """(nodes to split, best first; leaves whose sums must be known before that is certain)."""
        if 1 not in self.splits:
            return set(), [1]
        waiting, split, unknown, leaves = [], set(), [], 1

        def offer(node):
            if node not in self.splits:
                if node.bit_length() <= self.how.depth:
                    unknown.append(node)
            elif self.splits[node]:
                heapq.heappush(waiting, (-self.splits[node][0], node))

        offer(1)
        while waiting and leaves < self.how.leaves:
            _, node = heapq.heappop(waiting)
            split.add(node)
            leaves += 1
            if leaves < self.how.leaves:
                offer(2 * node)
                offer(2 * node + 1)
        return split, unknown

    def tree(self, split: set[int], open_: list[int] = ()) -> tuple[Tree, list[int]]:
        """The tree that splits the given nodes, and its nodes' path numbers."""
        order, at = [1], 0
        while at < len(order):
            if order[at] in split:
                order += [2 * order[at], 2 * order[at] + 1]
            at += 1
        place = {n: k for k, n in enumerate(order)}
        inner = [n in split for n in order]
        of = lambda f, empty: np.array([f(n) if i else empty for n, i in zip(order, inner)])
        sums = np.array([self.sums.get(n, np.zeros(3)) for n in order])
        value = -_shrunk(sums[:, 0], self.how.l1) / (sums[:, 1] + self.how.l2) * self.how.rate
        return Tree(of(lambda n: self.splits[n][1], -1), of(lambda n: self.splits[n][2], 0), of(lambda n: place[2 * n], 0), of(lambda n: place[2 * n + 1], 0), value, of(lambda n: self.splits[n][0], 0.0)), order


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fold, label, bins, scores) of a batch of the state table."""
    n = batch.num_rows
    dense = lambda k: batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return batch.column(1).to_numpy(), batch.column(2).to_numpy(), dense(3), dense(4)


def _histograms(state: DataFrame, folds: list[int], asked: dict[int, tuple[Tree, np.ndarray]], columns: int, bins: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(model, leaf, sums by column and bin) of the open leaves: asked has for each model its tree so far and, for each of its nodes, the leaf's number or -1."""
    leaf_cells = columns * bins
    width = 1 + max(int(numbers.max()) for _, numbers in asked.values())

    def run(batches):
        total = np.zeros((len(folds) * width * leaf_cells, 3)) if len(folds) * width * leaf_cells < 1 << 22 else None
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, y, x, scores = _rows(batch)
            for k, (tree, numbers) in asked.items():
                leaf = numbers[tree.leaves(x)]
                rows = np.flatnonzero((leaf >= 0) & (fold != folds[k]))
                if not len(rows):
                    continue
                p = 1 / (1 + np.exp(-scores[rows, k]))
                cell = ((k * width + leaf[rows])[:, None] * leaf_cells + np.arange(columns) * bins + x[rows]).ravel()
                cells, at = np.unique(cell, return_inverse=True)
                sums = np.stack([np.bincount(at, np.repeat(v, columns), len(cells)) for v in (p - y[rows], p * (1 - p), np.ones(len(rows)))], axis=1)
                if total is None:
                    yield out(cells, sums)
                else:
                    total[cells] += sums
        if total is not None:
            cells = np.flatnonzero(total[:, 2])
            yield out(cells, total[cells])

    def out(cells, sums):
        return pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(sums[:, k]) for k in range(3))], names=["cell", "g", "h", "n"])

    got = state.mapInArrow(run, "cell long, g double, h double, n double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    order = np.argsort(got["cell"].to_numpy())
    cells, sums = got["cell"].to_numpy()[order], np.stack([got[c].to_numpy() for c in ("g", "h", "n")], axis=1)[order]
    for k, (_, numbers) in asked.items():
        for leaf in range(int(numbers.max()) + 1):
            begin = (k * width + leaf) * leaf_cells
            lo, hi = np.searchsorted(cells, [begin, begin + leaf_cells])
            dense = np.zeros((leaf_cells, 3))
            dense[cells[lo:hi] - begin] = sums[lo:hi]
            yield k, leaf, dense.reshape(columns, bins, 3)


def _areas(state: DataFrame, folds: list[int]) -> list[float]:
    """The area under the curve of each model on its held fold, from counts by score bin."""
    own = F.col("scores")[F.array_position(F.array(*(F.lit(f) for f in folds)), F.col("fold")).cast("int") - 1]
    at = F.floor(F.lit(SCORE_BINS) / (1 + F.exp(-own))).cast("int")
    got = state.groupBy("fold", at.alias("at")).agg(F.sum("y").alias("up"), F.count("*").alias("n")).toArrow()
    fold, at, up, n = (got[c].to_numpy() for c in ("fold", "at", "up", "n"))
    out = []
    for f in folds:
        rows = np.flatnonzero(fold == f)
        rows = rows[np.argsort(at[rows])]
        good, bad = up[rows], n[rows] - up[rows]
        below = np.cumsum(bad) - bad
        whole = good.sum() * bad.sum()
        out.append(float(((below + bad / 2) * good).sum() / whole) if whole else 0.5)
    return out


def fit_folds(df: DataFrame, features: list[str], label: str, fold: str, key: str, how: How | None = None) -> BoostedTrees:
    """One model a fold, fitted on the rows of the other folds; labels 0 and 1, null features as -1.

    Whole rows stay in one table of bins and scores, which each round writes
    anew and whose predecessor goes.  Rows without a fold or label are left
    out.
    """
    how = how or How()
    spark = df.sparkSession
    plain = df.filter(F.col(fold).isNotNull() & F.col(label).isNotNull()).select(F.col(key), F.col(fold).cast("long").alias("fold"), F.col(label).cast("double").alias("y"), *(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"x{j}") for j, c in enumerate(features)))
    plain = cut(plain)
    counts = sorted(tuple(r) for r in plain.groupBy("fold").agg(F.count("*"), F.sum("y")).collect())  # one row a fold
    folds = [r[0] for r in counts]
    n, up = sum(r[1] for r in counts), sum(r[2] for r in counts)
    shares = [min(max((up - r[2]) / max(n - r[1], 1), 1e-6), 1 - 1e-6) for r in counts]
    base = [float(np.log(p / (1 - p))) for p in shares]
    names = [f"x{j}" for j in range(len(features))]
    cuts = quantile_cuts(plain, names, how.bins)
    bins = 1 + max((len(c) for c in cuts), default=0)
    model = BoostedTrees(features, cuts, folds, base, [[] for _ in folds], [0] * len(folds), [[] for _ in folds])
    schema = T.StructType([plain.schema[key], T.StructField("fold", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("bins", T.ArrayType(T.ShortType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def lists(x, kind):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))

    def first(batches):
        for batch in batches:
            x = _binned(batch, 3, cuts)
            scores = np.tile(np.array(base), (len(x), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(x, pa.int16()), lists(scores, pa.float64())], names=schema.names)

    def written(made):
        path = new_path(spark, "boosting")
        made.write.parquet(path, compression="zstd")
        return spark.read.schema(schema).parquet(path), path

    state, path = written(plain.mapInArrow(first, schema))
    active = set(range(len(folds)))
    for turn in range(how.rounds):
        growing = {k: _Growing(k, turn, len(features), how) for k in sorted(active)}
        while True:
            asked, which = {}, {}
            for k, g in growing.items():
                _, unknown = g.chosen()
                if unknown:
                    tree, order = g.tree({n for n, s in g.splits.items() if s})
                    number = {n: i for i, n in enumerate(unknown)}
                    asked[k] = tree, np.array([number.get(n, -1) for n in order])
                    which[k] = unknown
            if not asked:
                break
            for k, leaf, sums in _histograms(state, folds, asked, len(features), bins):
                growing[k].take(which[k][leaf], sums)
        new = {k: g.tree(g.chosen()[0])[0] for k, g in growing.items()}

        def step(batches, new=new):
            for batch in batches:
                _, _, x, scores = _rows(batch)
                scores = scores.copy()
                for k, tree in new.items():
                    scores[:, k] += tree.scores(x)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists(scores, pa.float64())], names=schema.names)

        before = path
        state, path = written(state.mapInArrow(step, schema))
        removed(spark, before)
        areas = _areas(state, folds)
        for k in list(active):
            model.trees[k].append(new[k])
            model.areas[k].append(areas[k])
            best = int(np.argmax(model.areas[k])) + 1
            model.best[k] = best
            if len(model.trees[k]) - best >= how.patience or len(new[k].feature) == 1:
                active.discard(k)
        if not active:
            break
    return model
