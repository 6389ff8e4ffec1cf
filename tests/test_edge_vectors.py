"""Embeddings by sampled edges, sampled paths and propagated factors, against dense arithmetic and held-out links."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import edgevectors as L
from quillon.operators import factor as Q


def communities(n=120, parts=4, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, j) for i in range(n) for j in range(i) if rng.random() < (0.3 if i % parts == j % parts else 0.01)]


def area(vectors, linked, other):
    cos = lambda a, b: float(vectors[a] @ vectors[b] / max(np.linalg.norm(vectors[a]) * np.linalg.norm(vectors[b]), 1e-12))
    p, q = np.array([cos(*x) for x in linked]), np.array([cos(*x) for x in other])
    return ((p[:, None] > q).mean() + (p[:, None] == q).mean() / 2).item()


@pytest.mark.parametrize("order", [1, 2])
@pytest.mark.parametrize("blocks", range(1, 8))
def test_steps_have_every_pair_once_and_no_block_twice(order, blocks):
    steps = L.schedule(blocks, order)
    assert sorted(p for s in steps for p in s) == sorted((i, j) for i in range(blocks) for j in range(blocks))
    for s in steps:
        users = {}
        for (a, b), task in s.items():
            for key in (("s", a), ("t", b)) if order == 2 else (a, b):
                assert users.setdefault(key, task) == task


def test_sampled_edges_tell_held_out_links(spark):
    pairs = communities()
    held = [p for p in pairs if (p[0] * 7 + p[1]) % 5 == 0]
    kept = spark.createDataFrame([p for p in pairs if (p[0] * 7 + p[1]) % 5], "src long, dst long")
    other = [(i, j) for i in range(120) for j in range(i) if (i, j) not in set(pairs)][::9]
    run = lambda: {r["id"]: np.array(r["x"]) for r in L.edge_embeddings(kept, 8, 1, draws=40, epochs=4, blocks=2).collect()}
    got = run()
    assert len(got) == 120 and area(got, held, other) > 0.75
    again = run()
    assert all(np.array_equal(got[k], again[k]) for k in got)


def test_sampled_edges_of_odd_tables(spark):
    rows = [("a", "b", 1.0), ("a", "b", 2.0), ("b", "b", 1.0), (None, "a", 1.0), ("c", None, 1.0), ("c", "d", 0.0), ("d", "c", -1.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, w double").withColumn("x", F.lit(1))
    got = {r["id"]: r["x"] for r in L.edge_embeddings(edges, 4, 2, epochs=1, blocks=2).collect()}
    assert set(got) == {"a", "b"} and all(len(x) == 4 and np.isfinite(x).all() for x in got.values())
    assert L.edge_embeddings(edges.limit(0), 4, 2, epochs=1, blocks=2).count() == 0


def test_vectors_leave_their_blocks_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS", 2)
    state = spark.createDataFrame([("source", 0, [1.0] * 4, [float(v) for v in range(12)]), ("source", 2, [1.0], [7.0, 8.0, 9.0]), ("source", 3, [], [])], L._BLOCKS)
    got = {(r["block"], r["slot"]): r["x"] for r in L._unblocked(state, 3).collect()}
    assert got == {**{(0, k): [3.0 * k, 3.0 * k + 1, 3.0 * k + 2] for k in range(4)}, (2, 0): [7.0, 8.0, 9.0]}


def test_no_nodes_row_carries_its_whole_block(spark):
    rows = [(i, (i * 7 + 1) % 40, 1.0) for i in range(40)]
    made = L.edge_embeddings(spark.createDataFrame(rows, "src long, dst long, w double"), 4, epochs=1, blocks=2)
    assert made.count() == 40
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "slot" in plan.split("Join", 1)[1].splitlines()[0]


def test_paths_of_one_edge_are_the_edges(spark):
    both = Q._undirected(spark.createDataFrame([(1, 2, 2.0), (2, 3, 1.0), (3, 1, 4.0)], "src long, dst long, w double"))
    got = {(r["src"], r["dst"]): r["w"] for r in Q.path_samples(both, 1, 3).collect()}
    assert got == pytest.approx({(1, 2): 1.0, (2, 1): 1.0, (2, 3): 0.5, (3, 2): 0.5, (1, 3): 2.0, (3, 1): 2.0})  # w / 2 each way


def test_paths_reach_as_far_as_walks_do(spark):
    """On a path of five nodes with equal weights: what paths of two edges give on average."""
    line = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    got = {(r["src"], r["dst"]): r["w"] for r in Q.path_samples(Q._undirected(line), 2, 400).collect()}
    a = np.diag(np.ones(4), 1) + np.diag(np.ones(4), -1)
    walk = a @ np.diag(1 / a.sum(0)) @ a
    expected = (a / 4 + walk / 4)  # each length has half the weight, each direction half of that
    assert max(abs(got.get((i, j), 0) - expected[i, j]) for i in range(5) for j in range(5)) < 0.03


def test_sparsifier_and_propagation_find_communities(spark):
    pairs = communities(80)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["id"]: np.array(r["x"]) for r in Q.sparsifier_embedding(edges, 4, window=3, rounds=4, tolerance=1e-6).collect()}
    linked, other = [(i, j) for i in range(80) for j in range(i) if i % 4 == j % 4][::7], [(i, j) for i in range(80) for j in range(i) if i % 4 != j % 4][::7]
    assert len(got) == 80 and area(got, linked, other) > 0.95
    assert all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in got.values())


def iv(k, s):
    """The modified Bessel function by its integral."""
    at = np.arange(64) * 2 * np.pi / 64
    return (np.exp(s * np.cos(at)) * np.cos(k * at)).mean()


def dense_propagation(a, x, order, mu, s):
    looped = a + np.eye(len(a))
    m = (1 - mu) * np.eye(len(a)) - looped / looped.sum(1, keepdims=True)
    terms = [x, 0.5 * m @ m @ x - x]
    for _ in range(2, order):
        terms.append(m @ m @ terms[-1] - 2 * terms[-1] - terms[-2])
    kept = iv(0, s) * terms[0] + sum(2 * (-1) ** k * iv(k, s) * terms[k] for k in range(1, order))
    return looped @ (x - kept)


def test_propagation_is_the_dense_one(spark):
    pairs = communities(60)
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long")
    a = np.zeros((60, 60))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    x = np.random.default_rng(5).normal(size=(60, 3))
    table = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, x array<double>")
    got = {r["id"]: r["x"] for r in Q.propagated_factors(edges, table, 3, 4).collect()}
    assert np.abs(np.array([got[i] for i in range(60)]) - dense_propagation(a, x, 4, 0.5, 0.2)).max() < 1e-9
    p = a / a.sum(1, keepdims=True)
    column = p.sum(0) ** 0.75
    f = np.where(a > 0, np.log(np.where(a > 0, p, 1)) - np.log(column / column.sum()), 0)
    cells = {(r["src"], r["dst"]): r["w"] for r in Q.proximity_matrix(edges).collect()}
    assert max(abs(cells.get((i, j), 0) - f[i, j]) for i in range(60) for j in range(60)) < 1e-9
    u, s, _ = np.linalg.svd(f)
    left = u[:, :3] * np.sqrt(s[:3])
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    made = dense_propagation(a, left, 4, 0.5, 0.2)
    u, s, _ = np.linalg.svd(made, full_matrices=False)
    whole = u * np.sqrt(s)
    whole /= np.linalg.norm(whole, axis=1, keepdims=True)
    rows = {r["id"]: r["x"] for r in Q.propagated_embedding(edges, 3, order=4).collect()}
    mine = np.array([rows[i] for i in range(60)])
    assert np.abs(mine @ mine.T - whole @ whole.T).max() < 1e-6
