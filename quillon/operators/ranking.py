"""Knowledge-graph and recommendation operators, and vector search by blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.tables import hashed


def subsampling_weights(triples: DataFrame) -> DataFrame:
    """Triples with sqrt(1 / (c1 + c2)): counts of (h, r) and of (r, t), each from 3 up."""
    first = triples.groupBy("h", "r").agg((F.count("*") + 3).alias("_a"))
    second = triples.groupBy("r", "t").agg((F.count("*") + 3).alias("_b"))
    return triples.join(first, ["h", "r"]).join(second, ["r", "t"]).select("h", "r", "t", F.sqrt(1 / (F.col("_a") + F.col("_b"))).alias("weight"))


def true_ends(triples: DataFrame, end: str = "t") -> DataFrame:
    """(h, r, tails) or (r, t, heads): the distinct true ends of each pair, sorted."""
    keys, name = (["h", "r"], "tails") if end == "t" else (["r", "t"], "heads")
    return triples.groupBy(*keys).agg(F.sort_array(F.collect_set(end)).alias(name))


def corrupted(triples: DataFrame, entities: DataFrame, each: int, end: str = "t", seed: str = "0") -> DataFrame:
    """(h, r, t): for each triple `each` others with a hash-drawn end, true ones left out.

    Entities are (pos, id) numbered from 0; their number is the only thing
    that is counted.
    """
    n = entities.count()
    drawn = triples.select("h", "r", "t", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("_k"))
    spot = F.pmod(F.conv(F.substring(hashed(seed, *(F.col(c) for c in ("h", "r", "t", "_k"))), 1, 15), 16, 10).cast("long"), F.lit(n))
    made = drawn.withColumn("pos", spot).join(entities.select("pos", F.col("id").alias("_e")), "pos")
    new = made.select(*(F.col("_e").alias(c) if c == end else F.col(c) for c in ("h", "r", "t"))).distinct()
    return new.join(triples.select("h", "r", "t"), ["h", "r", "t"], "left_anti")


def transe(h: Column, r: Column, t: Column, gamma: float = 12.0) -> Column:
    return gamma - V.total(F.transform(V.minus(V.plus(h, r), t), F.abs))


def distmult(h: Column, r: Column, t: Column) -> Column:
    return V.total(V.times(V.times(h, r), t))


def _halves(x: Column, width: int) -> tuple[Column, Column]:
    return F.slice(x, 1, width // 2), F.slice(x, width // 2 + 1, width // 2)


def complex_score(h: Column, r: Column, t: Column, width: int) -> Column:
    """Real part of <h, r, conj(t)>; the first half of each vector is real."""
    (a, b), (c, d), (e, f) = (_halves(x, width) for x in (h, r, t))
    re = V.minus(V.times(a, c), V.times(b, d))
    im = V.plus(V.times(a, d), V.times(b, c))
    return V.total(V.plus(V.times(re, e), V.times(im, f)))


def rotate(h: Column, phase: Column, t: Column, width: int, gamma: float = 12.0) -> Column:
    """gamma less the summed moduli of h turned by the phases minus t."""
    (a, b), (e, f) = _halves(h, width), _halves(t, width)
    cos, sin = F.transform(phase, F.cos), F.transform(phase, F.sin)
    re = V.minus(V.minus(V.times(a, cos), V.times(b, sin)), e)
    im = V.minus(V.plus(V.times(a, sin), V.times(b, cos)), f)
    return gamma - V.total(F.zip_with(re, im, lambda x, y: F.sqrt(x * x + y * y)))


def top_items(scores: DataFrame, user: str = "user", item: str = "item", score: str = "score", k: int = 10, seen: DataFrame | None = None) -> DataFrame:
    """(user, item, score, rank): the k best items of each user, without those seen."""
    if seen is not None:
        scores = scores.join(seen.select(user, item), [user, item], "left_anti")
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(score), item))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Rows of each side that a task pairs, on average.
PAIR_BLOCK = 2_000


def beside(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Every row of a with every row of b, for operators that are asked for all pairs.

    Both sides are dealt to blocks by hash, as many as their counted rows
    need, and a pair of blocks is one key of an equi-join: no task pairs more
    than about PAIR_BLOCK rows of each.  A side that was counted to be one
    block goes to all tasks; the other is then not shuffled.
    """
    many = lambda df: max(1, -(-df.count() // PAIR_BLOCK))
    m, n = many(a), many(b)
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))
    left = a.withColumn("_i", F.pmod(F.xxhash64(key_a), F.lit(m))).withColumn("_j", spread(n))
    right = b.withColumn("_j", F.pmod(F.xxhash64(key_b), F.lit(n))).withColumn("_i", spread(m))
    if n == 1:
        right = F.broadcast(right)
    elif m == 1:
        left = F.broadcast(left)
    return left.join(right, ["_i", "_j"]).drop("_i", "_j")


def scored_queries(queries: DataFrame, rows: DataFrame, score, k: int, query: str = "query", row: str = "row") -> DataFrame:
    """(query, row, score, rank): the k best rows of a stated query set, searched in blocks.

    A pair of one query and one row exists in one task only, and the best k of
    a task are kept before anything is shuffled to rank.
    """
    pairs = beside(queries, rows, query, row).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), row))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select(query, row, "score", "rank")
