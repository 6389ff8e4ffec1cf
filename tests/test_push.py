"""Pushes of PageRank by blocks of seeds are the plain ones, and every node is a seed of the query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import graph as G
from quillon.operators import push
from quillon.plans import registry


def plain(near, seed, alpha, eps):
    r, p = {seed: 1.0}, {}
    while live := [u for u in r if r[u] >= alpha * eps * len(near[u])]:
        add = {}
        for u in live:
            p[u] = p.get(u, 0.0) + alpha * r[u]
            for v in near[u]:
                add[v] = add.get(v, 0.0) + (1 - alpha) * r[u] / len(near[u])
            r[u] = 0.0
        for v, x in add.items():
            r[v] = r.get(v, 0.0) + x
    return p


@pytest.mark.parametrize(("name", "eps"), [(lambda i: i * 3 - 7, 1e-3), (lambda i: f"n{i}", 4e-2)])
def test_pushes_in_blocks_are_the_plain_ones(spark, monkeypatch, name, eps):
    """Several slices, blocks and passes; a hub that is never pushed at the larger bound; loops, doubled edges and null ends."""
    for limit, value in (("BLOCK", 300), ("SEEDS", 17)):
        monkeypatch.setattr(push, limit, value)
    pairs = [(int(a), int(b)) for a, b in np.random.default_rng(1).integers(0, 40, (60, 2))] + [(0, k) for k in range(1, 90)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kind = "long" if isinstance(name(0), int) else "string"
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs] + [(name(3), None), (None, name(5))], f"src {kind}, dst {kind}")
    seeds = spark.createDataFrame([(name(k),) for k in range(95)] + [(None,)], f"id {kind}")
    got = {(r["seed"], r["id"]): r["p"] for r in G.personalised_pagerank(edges, seeds, 0.3, eps).collect()}
    want = {(name(s), name(u)): x for s in near for u, x in plain(near, s, 0.3, eps).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_pagerank_query_goes_beyond_one_push(spark, sf):
    rows = registry.queries()["personalised_pagerank"](spark, sf)
    linked = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("id")).distinct()
    assert rows.select("seed").distinct().count() >= 0.95 * linked.count()
    assert rows.filter("seed <> id").count() > rows.filter("seed = id").count()
