"""Personalised PageRank by pushes, a block of seeds a task over the neighbour lists that its seeds reach.

A push takes at least alpha^2 eps of a seed's mass for each neighbour of the
node, so a seed meets at most 1 / (alpha^2 eps) cells of lists, however large
the graph, and a node of more than 1 / (alpha eps) neighbours is never pushed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.partition import _Tables
from quillon.sources.tables import cut

#: Cells of lists that a block of seeds meets, on average, and seeds whose lists are shuffled at once.
BLOCK, SEEDS = 1 << 21, 1 << 17


def neighbour_lists(out: DataFrame, degree: DataFrame, most: float) -> DataFrame:
    """(id, degree, to, degrees): the neighbours of each node of at most `most`, in order, with their own numbers of edges."""
    own = degree.filter(F.col("degree") <= most)
    cells = out.join(own.select(F.col("id").alias("src"), F.col("degree").alias("_n")), "src")
    ends = cells.join(degree.select(F.col("id").alias("dst"), F.col("degree").alias("_m")), "dst")
    packed = ends.groupBy(F.col("src").alias("id"), F.col("_n").alias("degree")).agg(F.sort_array(F.collect_list(F.struct("dst", "_m"))).alias("_c"))
    return packed.select("id", "degree", F.col("_c.dst").alias("to"), F.col("_c._m").alias("degrees"))


def _pushed(ends: np.ndarray, cell: np.ndarray, row_key: np.ndarray, start: np.ndarray, degree: np.ndarray, seed_of: np.ndarray, alpha: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, seeds that ended, keys that were to be pushed without a list) over keys, places of (seed, node).

    Lists are rows that end at `ends` of cell, a key a cell; row_key has the
    key of each list, start those of the seeds, degree and seed_of say it of keys.
    """
    r, p = np.zeros(len(degree)), np.zeros(len(degree))
    r[start] = 1.0
    row_of = np.full(len(degree), -1)
    row_of[row_key] = np.arange(len(row_key))
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes, least = ends - begins, alpha * eps * degree
    going, asked = np.ones(len(start), bool), []
    live = start
    while True:
        live = live[(r[live] >= least[live]) & (degree[live] > 0) & going[seed_of[live]]]
        bare = live[row_of[live] < 0]
        if len(bare):
            asked.append(bare)
            going[seed_of[bare]] = False
            live = live[going[seed_of[live]]]
        if not len(live):
            break
        sent = (1 - alpha) * r[live] / degree[live]
        p[live] += alpha * r[live]
        r[live] = 0.0
        rows = row_of[live]
        n = sizes[rows]
        at = np.repeat(begins[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        met = cell[at]
        live = np.unique(met)
        r[live] += np.bincount(np.searchsorted(live, met), np.repeat(sent, n), len(live))
    return p, going, np.concatenate(asked) if asked else np.zeros(0, int)


def personalised_pagerank(out: DataFrame, degree: DataFrame, seeds: DataFrame, alpha: float, eps: float) -> DataFrame:
    """(seed, id, p): values above 0 of the pushes from each seed (id) over edges in both directions; see graph.personalised_pagerank.

    A block that lacks a list asks for it and does those seeds once more in the
    next pass; seeds are taken SEEDS at a time.
    """
    tables = _Tables()
    lists = tables.keep(neighbour_lists(out, degree, (1 + 1e-9) / (alpha * eps)))
    plain = tables.keep(seeds.filter("id is not null").select(F.col("id").alias("seed")).distinct())
    slices = max(1, -(-plain.count() // SEEDS))
    kind = dict(plain.dtypes)["seed"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seed", "ascending"), ("id", "ascending")]).combine_chunks()
        n, to = table.num_rows, table["to"].combine_chunks()
        names = pa.chunked_array([table["seed"].combine_chunks().cast(to.values.type), table["id"].combine_chunks().cast(to.values.type), to.flatten()]).combine_chunks().dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many = len(names.dictionary)
        first = np.concatenate([[True], code[1:n] != code[: n - 1]])
        seed = np.cumsum(first) - 1
        sizes = to.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        keys, place = np.unique(np.concatenate([seed * many + code[n : 2 * n], np.repeat(seed, sizes) * many + code[2 * n :], seed[first] * many + code[:n][first]]), return_inverse=True)
        degree = np.zeros(len(keys), np.int64)
        cells = len(code) - 2 * n
        degree[place[n : n + cells]] = table["degrees"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        degree[place[:n]] = table["degree"].to_numpy()
        seed_of = keys // many
        p, ended, asked = _pushed(np.cumsum(sizes), place[n : n + cells], place[:n], place[n + cells :], degree, seed_of, alpha, eps)
        value = names.dictionary.take
        found = np.flatnonzero((p > 0) & ended[seed_of])
        again = np.flatnonzero(~ended[seed])
        own = code[:n][first]
        parts = [(own[seed_of[found]], keys[found] % many, p[found]), (own[seed_of[asked]], keys[asked] % many, None), (own[seed[again]], code[n : 2 * n][again], None)]
        rows = [pa.table({"seed": value(pa.array(a)), "id": value(pa.array(b)), "p": pa.array(c, pa.float64()) if c is not None else pa.nulls(len(a), pa.float64())}) for a, b, c in parts]
        return pa.concat_tables(rows)

    found = []
    for k in range(slices):
        asked = plain.filter(F.pmod(F.xxhash64("seed"), F.lit(slices)) == k).select("seed", F.col("seed").alias("id"))
        while True:
            met = asked.join(lists, "id")
            blocks = max(1, -(-(asked.join(lists.select("id", F.size("to").alias("_n")), "id").agg(F.sum("_n")).first()[0] or 0) // BLOCK))
            made = tables.keep(met.groupBy(F.pmod(F.xxhash64("seed"), F.lit(blocks)).alias("_b")).applyInArrow(run, f"seed {kind}, id {kind}, p double"))
            found.append(made.filter("p is not null"))
            asked = made.filter("p is null").select("seed", "id")
            if asked.isEmpty():
                break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    kept = cut(every)
    tables.drop(*(t for t, _ in list(tables.paths.values())))
    return kept
