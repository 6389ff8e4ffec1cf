"""Named applications over edge tables and a grid of runs: the thin surface over the operators."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import evaluate, features, graph, ranking
from quillon.sources.tables import cut


def dataset_stats(edges: DataFrame, nodes: DataFrame, label: str = "y") -> DataFrame:
    """One row: nodes, edges, features, classes, labelled nodes (label not -1)."""
    marked = nodes.agg(
        F.count("*").alias("nodes"), F.max(F.size("x")).alias("features") if "x" in nodes.columns else F.lit(0).alias("features"), F.countDistinct(F.when(F.col(label) >= 0, F.col(label))).alias("classes"), F.sum((F.col(label) >= 0).cast("long")).alias("labelled")
    )
    return marked.crossJoin(edges.agg(F.count("*").alias("edges")))


def neighbourhood(edges: DataFrame, seed: int, depth: int = 2) -> DataFrame:
    """Edges among the nodes at most depth hops from a seed, for drawing."""
    near = graph.breadth_first(edges, edges.sparkSession.createDataFrame([(seed,)], "id long"), depth)
    return graph.induced(edges, near.select("id"))


def generate_embeddings(edges: DataFrame, rank: int = 16, how: str = "spectral") -> DataFrame:
    """(id, x): nodes on the singular directions of a pair matrix."""
    matrix = {"spectral": lambda e: graph.normalised(e, "sym"), "pmi": graph.positive_pmi, "walks": graph.log_walk_matrix, "katz": lambda e: graph.katz(e, 0.1, 2)}[how](edges)
    return features.truncated_svd(cut(matrix.select(F.col("src").alias("id"), F.col("dst").alias("term"), F.col("w").alias("weight"))), "id", rank)


def recommend(interactions: DataFrame, k: int = 10) -> DataFrame:
    """(user, item, score, rank): items of users who share items, without those a user has.

    An item's score is the number of other users who have it and an item of the
    user's, each counted once an item shared.  Pairs of items are counted within
    users' lists, so an item that very many users have makes no pairs of users.
    """
    pairs = interactions.select("user", "item").distinct()
    together = cut(pairs.join(pairs.toDF("user", "next"), "user").filter("item <> next").groupBy("item", "next").agg(F.count("*").alias("n")))
    scores = pairs.join(together, "item").groupBy("user", F.col("next").alias("item")).agg(F.sum("n").alias("score"))
    return ranking.top_items(scores, k=k, seen=pairs)


APPS: dict[str, Callable] = {"dataset-stats": dataset_stats, "dataset-visual": neighbourhood, "generate-emb": generate_embeddings, "recommendation": recommend}


def pipeline(app: str) -> Callable:
    if app not in APPS:
        raise KeyError(f"no application {app!r}; there are {', '.join(sorted(APPS))}")
    return APPS[app]


def experiment(run: Callable[..., float], **grid: Iterable) -> list[dict]:
    """Runs every combination of the given values; rows of settings with the metric that `run` returns."""
    names = list(grid)
    return [dict(zip(names, values)) | {"metric": run(**dict(zip(names, values)))} for values in itertools.product(*grid.values())]


def best(results: list[dict], largest: bool = True) -> dict:
    return (max if largest else min)(results, key=lambda r: r["metric"])


def evaluated(metric: str, df: DataFrame, *columns: str) -> DataFrame:
    return evaluate.evaluator(metric)(df, *columns)
