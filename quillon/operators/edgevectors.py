"""Embeddings of nodes by sampled edges: stochastic gradients on strata of blocks that never share a parameter.

Nodes are dealt to blocks by hash.  A stratum holds the edges from one block
to another; a step takes strata that have no block in common, one task each,
so every vector is written by one task only.  Negatives come from the
stratum's target block, in proportion to degree^0.75.  Vectors stay in a table
of blocks, which each step writes anew; nothing but counts reaches the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.graph import weighted
from quillon.operators.partition import _Tables

#: Nodes of a block at most, on average: what a task holds, twice.
BLOCK = 100_000
#: Draws of one gradient.
BATCH = 128
#: Vectors of a batch that leaves a block.
ROWS = 10_000

_BLOCKS = "kind string, block int, w array<double>, x array<float>"


def schedule(blocks: int, order: int) -> list[dict[tuple[int, int], int]]:
    """Steps of {(source block, target block): task}: each ordered pair once an epoch, a step's pairs without a common block.

    Second order has vectors of two kinds, so a block may be source in one
    task and target in another; first order has one kind, so a step is a round
    of a tournament, in which both directions of a pair meet.
    """
    if order == 2:
        return [{(b, (b + s) % blocks): b for b in range(blocks)} for s in range(blocks)]
    steps = [{(b, b): b for b in range(blocks)}]
    n = blocks + blocks % 2
    for s in range(n - 1):
        seats = [n - 1] + [(s + k) % (n - 1) for k in range(n - 1)]
        pairs = [(seats[k], seats[n - 1 - k]) for k in range(n // 2)]
        steps.append({ends: t for t, (a, b) in enumerate(pairs) if max(a, b) < blocks for ends in ((a, b), (b, a))})
    return [s for s in steps if s]


def _trained(width: int, negative: int, rate: float, seed: int):
    """The work of a task: the draws of its strata on the vectors of its blocks."""

    def run(edges: pa.Table, held: pa.Table) -> pa.Table:
        kinds, blocks = held["kind"].to_pylist(), held["block"].to_pylist()
        at = {key: i for i, key in enumerate(zip(kinds, blocks))}
        x = [np.array(v.values, np.float32).reshape(-1, width) for v in held["x"]]
        w = [np.array(v.values, float) for v in held["w"]]
        source, target = ("source", "target") if "target" in kinds else ("node", "node")
        strata = edges.group_by(["sb", "tb"]).aggregate([("times", "sum")]).sort_by([("sb", "ascending"), ("tb", "ascending")]) if edges.num_rows else edges
        for sb, tb in zip(strata["sb"].to_pylist(), strata["tb"].to_pylist()):
            own = edges.filter(pa.compute.and_(pa.compute.equal(edges["sb"], sb), pa.compute.equal(edges["tb"], tb))).sort_by([("ss", "ascending"), ("ts", "ascending")])
            ss, ts = own["ss"].to_numpy(), own["ts"].to_numpy()
            ends = np.cumsum(own["times"].to_numpy())
            a, b = x[at[source, sb]], x[at[target, tb]]
            share = np.cumsum(w[at[target, tb]] ** 0.75)
            rng = np.random.default_rng([seed, sb, tb])
            for begin in range(0, int(ends[-1]), BATCH):  # draws with replacement: an edge as likely as its times
                edge = np.searchsorted(ends, rng.integers(0, ends[-1], min(BATCH, int(ends[-1]) - begin)), side="right")
                s, t = ss[edge], np.column_stack([ts[edge], np.searchsorted(share, rng.random((len(edge), negative)) * share[-1], side="right").clip(0, len(share) - 1)])
                u, v = a[s], b[t]
                off = 1 / (1 + np.exp(-np.clip(np.einsum("ik,ijk->ij", u, v), -30, 30)))
                off[:, 0] -= 1
                off[:, 1:][t[:, 1:] == t[:, :1]] = 0  # a negative that is the edge's own end
                np.add.at(a, s, (-rate * np.einsum("ij,ijk->ik", off, v)).astype(np.float32))
                np.add.at(b, t.ravel(), (-rate * off[..., None] * u[:, None, :]).reshape(-1, width).astype(np.float32))
        lists = pa.array([v.ravel() for v in x], pa.list_(pa.float32()))
        return pa.table({"kind": held["kind"], "block": held["block"], "w": held["w"], "x": lists})

    return run


def _unblocked(state: DataFrame, width: int) -> DataFrame:
    """(block, slot, x): a row a vector, so that no node's row ever carries its whole block."""

    def run(batches):
        for batch in batches:
            for block, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.array(held.values, float).reshape(-1, width)
                for a in range(0, len(x), ROWS):
                    part = np.ascontiguousarray(x[a : a + ROWS])
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), width).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), pa.array(np.arange(a, a + len(part), dtype=np.int32)), lists], names=["block", "slot", "x"])

    return state.select("block", "x").mapInArrow(run, "block int, slot int, x array<double>")


def edge_embeddings(edges: DataFrame, width: int = 16, order: int = 2, draws: float = 20.0, epochs: int = 5, negative: int = 5, rate: float = 0.05, blocks: int = 4, seed: int = 0) -> DataFrame:
    """(id, x): a vector for each end of an edge, near for nodes that are linked (order 1) or have the same neighbours (order 2).

    Edges (src, dst, w) count as given: mirror those without direction first;
    for order 1 both directions are added.  Several of a pair count by summed
    weights; null ends, and weights that aren't positive, do nothing.  An epoch
    makes about `draws` draws a node, edges in proportion to weight, each with
    `negative` negatives.  `blocks` grows until none holds more than BLOCK
    nodes on average.  The rate falls by epoch to a tenth.  Repeatable by the
    seed.  A task holds two blocks and the edges between them; a single edge's
    draws are one task's, as its vectors are.
    """
    tables = _Tables()
    e = weighted(edges).filter("src is not null and dst is not null and w > 0").select("src", "dst", F.col("w").cast("double").alias("w"))
    if order == 1:
        e = e.union(e.select("dst", "src", "w"))
    e = tables.keep(e.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    ends = e.select(F.col("src").alias("id"), F.lit(0.0).alias("w")).union(e.select("dst", "w"))
    nodes = ends.groupBy("id").agg(F.sum("w").alias("w"))
    n, total = nodes.agg(F.count("*"), F.sum("w")).first()
    blocks = max(blocks, math.ceil(n / BLOCK))
    block = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(blocks)).cast("int")
    slot = (F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).cast("int")  # a block is bounded
    nodes = tables.keep(nodes.withColumn("block", block).withColumn("slot", slot))
    source, target = (nodes.select(F.col("id").alias(c), F.col("block").alias(f"{k}b"), F.col("slot").alias(f"{k}s")) for c, k in (("src", "s"), ("dst", "t")))
    steps = schedule(blocks, order)
    if order == 2:
        task, step = F.col("sb"), F.pmod(F.col("tb") - F.col("sb"), F.lit(blocks))
    else:
        places = [(*pair, s, t) for s, made in enumerate(steps) for pair, t in made.items()]
        deal = e.sparkSession.createDataFrame(places, "sb int, tb int, step int, task int")
    dealt = e.join(source, "src").join(target, "dst").select("sb", "ss", "tb", "ts", "w")
    dealt = dealt.withColumns({"task": task, "step": step}) if order == 2 else dealt.join(deal, ["sb", "tb"])
    strata = tables.keep(dealt.repartition("step", "task"))
    # uniform in a small cube, by hash, so that any run begins alike
    start = lambda kind: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("slot", "id"))), lambda r: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: ((F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), r["slot"], F.col("block"), k), F.lit(1 << 20)) / float(1 << 20) - 0.5) / width).cast("float"))))
    weights = F.transform(F.sort_array(F.collect_list(F.struct("slot", "w"))), lambda r: r["w"])
    first = [nodes.groupBy("block").agg(weights.alias("w"), start(k).alias("x")).select(F.lit(k).alias("kind"), "block", "w", "x") for k in (("source", "target") if order == 2 else ("node",))]
    state = tables.keep(first[0] if order == 1 else first[0].union(first[1]))
    for epoch in range(epochs):
        slow = rate * max(0.1, 1 - epoch / epochs)
        for s, made in enumerate(steps):
            # whole draws of each edge, the rest by hash, so that weights hold on average
            amount = F.col("w") * (draws * n / total) if total else F.lit(0.0)
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "sb", "ss", "tb", "ts"), F.lit(1 << 30)) / float(1 << 30)
            drawn = strata.filter(F.col("step") == s).withColumn("times", (F.floor(amount) + (u < amount - F.floor(amount)).cast("long")).cast("long")).filter("times > 0").select("task", "sb", "ss", "tb", "ts", "times")
            where = {}
            for (sb, tb), t in made.items():
                where |= {("source", sb): t, ("target", tb): t} if order == 2 else {("node", sb): t, ("node", tb): t}
            tasks = lambda kind: F.get(F.array(*(F.lit(where.get((kind, b), b)) for b in range(blocks))), F.col("block"))
            placed = state.withColumn("task", F.when(F.col("kind") == "target", tasks("target")).otherwise(tasks("source" if order == 2 else "node")))
            run = _trained(width, negative, slow, seed * 1_000_003 + epoch)
            after = tables.keep(drawn.groupBy("task").cogroup(placed.groupBy("task")).applyInArrow(run, _BLOCKS))
            tables.drop(state)
            state = after
    return nodes.join(_unblocked(state.filter("kind <> 'target'"), width), ["block", "slot"]).select("id", "x")
