"""Graph operators on plain node and edge tables.

Edges are (src, dst, w): src is the row that gathers, dst the message's
source.  Features are one array column or one scalar.  Every operator is a
join and a grouped aggregate; iterative ones cut their lineage by written
tables.  Degrees are edge counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.tables import hashed, running_total
from quillon.sources.tables import cut, dealt, tasks_for

#: Iterations between two cuts of the lineage.
EVERY = 3
#: Cells of a matrix's row that one list holds, on average, where rows are packed.
PACKED = 1_024
#: Graphs of one label that a task pairs with as many others, on average.
BAG_BLOCK = 1_000


def weighted(edges: DataFrame) -> DataFrame:
    return edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))


# --------------------------------------------------------------- structure


def coalesced(edges: DataFrame) -> DataFrame:
    """One edge a pair, weights summed."""
    return weighted(edges).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def multiplicity(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, degree); 0 for nodes without edges, if the nodes are given."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return d if nodes is None else nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def mirrored(edges: DataFrame, tasks: int = 1) -> DataFrame:
    """Edges and their reverses, each pair once; see `dealt` for tasks."""
    e = edges.select("src", "dst")
    return dealt(e.union(e.select("dst", "src")), tasks, "src", "dst").distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def with_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """One loop for every node besides all edges: an existing loop keeps its weight, others get `fill`."""
    e = weighted(edges)
    own = e.filter("src = dst").groupBy("src").agg(F.max("w").alias("_w"))
    loops = nodes.select("id").join(own, F.col("id") == F.col("src"), "left").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.coalesce("_w", F.lit(fill)).alias("w"))
    return e.filter("src <> dst").select("src", "dst", "w").union(loops)


def normalised(edges: DataFrame, how: str = "row") -> DataFrame:
    """w / degree(row), or w / sqrt(degree(row) * degree(column)) (sym), or w / degree(column) (col); degrees are counts.

    Row degrees come from a window on the partitioning that later aggregates
    by row reuse; column degrees from a grouped count.
    """
    e = weighted(edges)
    if how == "row":
        return e.withColumn("w", F.col("w") / F.count("*").over(Window.partitionBy("src")))
    if how == "col":
        return e.withColumn("w", F.col("w") / F.count("*").over(Window.partitionBy("dst")))
    by = degrees(e)
    column = by.select(F.col("id").alias("dst"), F.col("degree").alias("_d"))
    row = F.count("*").over(Window.partitionBy("src"))
    made = e.withColumn("_r", row).join(column, "dst", "left")
    return made.select("src", "dst", F.coalesce(F.col("w") / F.sqrt(F.col("_r") * F.col("_d")), F.lit(0.0)).alias("w"))


def weighted_normalised(edges: DataFrame, nodes: DataFrame, power: float = -0.5, one_sided: bool = False) -> DataFrame:
    """D^p (A + I) D^p with weighted degrees; one-sided leaves the right factor out."""
    e = with_loops(edges, nodes)
    d = e.groupBy(F.col("src").alias("id")).agg(F.pow(F.sum("w"), F.lit(power)).alias("f"))
    left = e.join(d.select(F.col("id").alias("src"), F.col("f").alias("_l")), "src")
    if one_sided:
        return left.select("src", "dst", (F.col("w") * F.col("_l")).alias("w"))
    both = left.join(d.select(F.col("id").alias("dst"), F.col("f").alias("_m")), "dst")
    return both.select("src", "dst", (F.col("w") * F.col("_l") * F.col("_m")).alias("w"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def product(a: DataFrame, b: DataFrame, plus: DataFrame | None = None) -> DataFrame:
    """A times B, plus a third matrix where one is given: products of weights summed over the node between.

    Rows of B are packed into lists of about PACKED cells and meet the cells of
    A as such; only then are they dealt by row of A and unpacked, so that no
    product is shuffled, in tasks of about TASK_ROWS products, which are counted.
    """
    first, second = (weighted(m).select("src", "dst", F.col("w").cast("double").alias("w")) for m in (a, b))
    many = second.groupBy(F.col("src").alias("_m")).agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("_n") / PACKED))
    lists = second.join(many, F.col("src") == F.col("_m")).groupBy("_m", part.alias("_part")).agg(F.collect_list(F.struct("dst", F.col("w").alias("_w"))).alias("_row"))
    lists = cut(lists.select("_m", F.col("_row.dst").alias("_to"), F.col("_row._w").alias("_w"), F.size("_row").alias("_n")))
    met = first.select("src", F.col("dst").alias("_m"), "w")
    counted = met.groupBy("_m").agg(F.count("*").alias("_a")).join(lists.groupBy("_m").agg(F.sum("_n").alias("_b")), "_m").agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0
    rows = met.join(lists, "_m").select("src", "_to", "_w", "w")
    if plus is not None:
        rows = rows.union(weighted(plus).select("src", F.array("dst"), F.array(F.lit(1.0)), F.col("w").cast("double")))
    tasks = max(tasks_for(counted), int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = rows.repartition(tasks, "src").select("src", "w", F.inline(F.arrays_zip(F.col("_to").alias("dst"), F.col("_w").alias("_w"))))
    return each.groupBy("src", "dst").agg(F.sum(F.col("w") * F.col("_w")).alias("w"))


def disjoint_union(nodes: DataFrame) -> DataFrame:
    """Nodes of many graphs with one numbering: local id plus the nodes of the graphs before."""
    before = running_total(nodes.groupBy("graph_id").agg((F.max("id") + 1).alias("_n")), [F.asc("graph_id")], "_n", "_before").drop("_n")
    return nodes.join(before, "graph_id").withColumn("global_id", F.col("id") + F.col("_before")).drop("_before")


# --------------------------------------------------------------- aggregation


def gathered(edges: DataFrame, nodes: DataFrame, x: str = "x") -> DataFrame:
    """Edges with the source's features beside them."""
    return weighted(edges).join(nodes.select(F.col("id").alias("dst"), F.col(x).alias("x")), "dst")


def vector_sum(rows: DataFrame, key: list[str], x: Column, width: int, mean: bool = False) -> DataFrame:
    """Element-wise sums of arrays: one aggregate buffer of plain doubles for each position, so sums combine before the shuffle."""
    f = F.avg if mean else F.sum
    parts = rows.select(*key, x.alias("_x")).groupBy(*key).agg(*(f(F.col("_x")[k]).alias(f"_{k}") for k in range(width)))
    return parts.select(*key, F.array(*(F.col(f"_{k}") for k in range(width))).alias("x"))


def vector_max(rows: DataFrame, key: list[str], x: Column, width: int, least: bool = False) -> DataFrame:
    f = F.min if least else F.max
    parts = rows.select(*key, x.alias("_x")).groupBy(*key).agg(*(f(F.col("_x")[k]).alias(f"_{k}") for k in range(width)))
    return parts.select(*key, F.array(*(F.col(f"_{k}") for k in range(width))).alias("x"))


def spmm(edges: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, x): for each row, the weighted sum of the features at its edges' other ends; rows without edges are left out."""
    g = gathered(edges, nodes)
    return vector_sum(g, ["src"], V.scaled(F.col("x"), F.col("w")), width).withColumnRenamed("src", "id")


def spmv(edges: DataFrame, values: DataFrame, value: str = "v") -> DataFrame:
    """(id, v) of a scalar feature."""
    g = weighted(edges).join(values.select(F.col("id").alias("dst"), F.col(value).alias("_v")), "dst")
    return g.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("_v")).alias(value))


def aggregated(edges: DataFrame, nodes: DataFrame, width: int, op: str = "add", how: str = "sum") -> DataFrame:
    """Sum or mean by row of (x op e) * w, e the edge's features (array column "e"); op is add, sub or mul."""
    f = {"add": V.plus, "sub": V.minus, "mul": V.times}[op]
    g = gathered(edges, nodes)
    return vector_sum(g, ["src"], V.scaled(f(F.col("x"), F.col("e")), F.col("w")), width, how == "mean").withColumnRenamed("src", "id")


def messages(edges: DataFrame, nodes: DataFrame, op: str) -> DataFrame:
    """(src, dst, m): features of the two ends combined by add, sub, mul, div (0 where the divisor is) or dot."""
    f = {"add": V.plus, "sub": V.minus, "mul": V.times, "div": V.over, "dot": V.dot}[op]
    both = gathered(edges, nodes).join(nodes.select(F.col("id").alias("src"), F.col("x").alias("_own")), "src")
    return both.select("src", "dst", f(F.col("_own"), F.col("x")).alias("m"))


def pooled(nodes: DataFrame, graph: str, width: int, how: str = "sum") -> DataFrame:
    if how == "max":
        return vector_max(nodes, [graph], F.col("x"), width)
    return vector_sum(nodes, [graph], F.col("x"), width, how == "mean")


def edge_softmax(edges: DataFrame, value: str = "w") -> DataFrame:
    """Softmax of edge values over each row's edges, the row's largest value taken off first."""
    w = Window.partitionBy("src")
    e = F.exp(F.col(value) - F.max(value).over(w))
    return edges.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def attended(edges: DataFrame, nodes: DataFrame, width: int, left: list[float], right: list[float]) -> DataFrame:
    """Attention with given weight vectors: leaky scores of the two ends, softmax by row, weighted sum."""
    fixed = lambda v: F.array(*(F.lit(float(x)) for x in v))
    score = nodes.select("id", "x", V.dot(F.col("x"), fixed(left)).alias("l"), V.dot(F.col("x"), fixed(right)).alias("r"))
    e = edges.join(score.select(F.col("id").alias("src"), "l"), "src").join(score.select(F.col("id").alias("dst"), "r", "x"), "dst")
    s = F.col("l") + F.col("r")
    soft = edge_softmax(e.withColumn("s", F.when(s > 0, s).otherwise(s * 0.2)), "s")
    return vector_sum(soft, ["src"], V.scaled(F.col("x"), F.col("p")), width).withColumnRenamed("src", "id")


def relational(edges: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, etype, x): mean of the features by row and edge type."""
    return vector_sum(gathered(edges, nodes), ["src", "etype"], F.col("x"), width, mean=True).withColumnRenamed("src", "id")


def smoothness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, s): mean cosine distance of a node to its neighbours, over degree - 1 (at least 1)."""
    both = gathered(without_loops(edges), nodes).join(nodes.select(F.col("id").alias("src"), F.col("x").alias("_own")), "src")
    d = V.cosine(F.col("_own"), F.col("x"))
    return both.groupBy(F.col("src").alias("id")).agg((F.sum(d) / F.greatest(F.count("*") - 1, F.lit(1))).alias("s"))


# --------------------------------------------------------------- iteration


def _looped(state: DataFrame, step, rounds: int) -> DataFrame:
    for k in range(rounds):
        state = step(state)
        if (k + 1) % EVERY == 0 and k + 1 < rounds:
            state = cut(state)
    return state


def propagated(edges: DataFrame, values: DataFrame, alpha: float, rounds: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """v <- alpha * A v + (1 - alpha) * v0, clamped if bounds are given; nodes without edges gather 0."""
    start = values.select("id", F.col("v").alias("_v0"))

    def step(now):
        out = start.join(spmv(edges, now), "id", "left")
        v = alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.col("_v0")
        return out.select("id", (v if low is None else V.clamped(v, low, high)).alias("v"))

    return _looped(values.select("id", "v"), step, rounds)


def hop_features(edges: DataFrame, nodes: DataFrame, width: int, hops: int) -> DataFrame:
    """(id, hop, x): features and their repeated averages over `edges`; nodes that gather nothing have zeros."""
    zeros = F.array(*(F.lit(0.0) for _ in range(width)))
    now = nodes.select("id", "x")
    out = now.withColumn("hop", F.lit(0))
    for k in range(1, hops + 1):
        now = nodes.select("id").join(spmm(edges, now, width), "id", "left").select("id", F.coalesce("x", zeros).alias("x"))
        if k % EVERY == 0:
            now = cut(now)
        out = out.unionByName(now.withColumn("hop", F.lit(k)))
    return out


def series(edges: DataFrame, values: DataFrame, coefficients: list[float]) -> DataFrame:
    """sum of c_k A^k v: heat, Taylor and personalised PageRank filters by their coefficients."""
    now, total = values.select("id", "v"), values.select("id", (coefficients[0] * F.col("v")).alias("s"))
    for k, c in enumerate(coefficients[1:], 1):
        now = values.select("id").join(spmv(edges, now), "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v"))
        now = cut(now) if k % EVERY == 0 else now
        total = total.join(now, "id").select("id", (F.col("s") + c * F.col("v")).alias("s"))
    return total.withColumnRenamed("s", "v")


def heat_coefficients(t: float, order: int) -> list[float]:
    return [math.exp(-t) * t**k / math.factorial(k) for k in range(order + 1)]


def ppr_coefficients(alpha: float, order: int) -> list[float]:
    return [alpha * (1 - alpha) ** k for k in range(order + 1)]


def bessel(k: int, x: float, terms: int = 40) -> float:
    """Modified Bessel function of the first kind, by its series."""
    return sum((x / 2) ** (2 * m + k) / (math.factorial(m) * math.factorial(m + k)) for m in range(terms))


def chebyshev_gaussian(edges: DataFrame, values: DataFrame, order: int = 10, mu: float = 0.5, theta: float = 0.5) -> DataFrame:
    """A Gaussian band-pass filter in Chebyshev terms of M = (1 - mu) I - A with Bessel coefficients; A is row-normalised."""
    def laplace(v):
        a = spmv(edges, v).withColumnRenamed("v", "_a")
        return v.join(a, "id", "left").select("id", ((1 - mu) * F.col("v") - F.coalesce("_a", F.lit(0.0))).alias("v"))

    t0 = values.select("id", "v")
    half = laplace(laplace(t0))
    t1 = half.join(t0.withColumnRenamed("v", "_o"), "id").select("id", (0.5 * F.col("v") - F.col("_o")).alias("v"))
    total = t0.join(t1.withColumnRenamed("v", "_1"), "id").select("id", (bessel(0, theta) * F.col("v") - 2 * bessel(1, theta) * F.col("_1")).alias("s"))
    for k in range(2, order):
        up = laplace(laplace(t1)).join(t1.withColumnRenamed("v", "_1"), "id").join(t0.withColumnRenamed("v", "_0"), "id")
        t2 = cut(up.select("id", (F.col("v") - 2 * F.col("_1") - F.col("_0")).alias("v")))
        sign = 2 * bessel(k, theta) * (1 if k % 2 == 0 else -1)
        total = cut(total.join(t2, "id").select("id", (F.col("s") + sign * F.col("v")).alias("s")))
        t0, t1 = t1, t2
    return total.withColumnRenamed("s", "v")


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.5, eps: float = 1e-3, top: int | None = None, tasks: int = 1) -> DataFrame:
    """(seed, id, p): approximate PageRank by synchronous pushes.

    In each round every node whose residual is at least alpha * eps * degree
    keeps alpha of it and deals the rest to its neighbours; it ends when no
    residual is that large, so each value is within the bound of the push
    algorithm: every push takes at least alpha^2 * eps of a seed's residual,
    so it does end.  A task does the rounds of a block of seeds (see `push`).
    `top` keeps the largest values of each seed.
    """
    from quillon.operators import push

    out = cut(mirrored(edges.filter("src is not null and dst is not null"), tasks))
    found = push.personalised_pagerank(out, cut(degrees(out)), seeds, alpha, eps)
    if top:
        rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("p"), "id"))
        found = found.withColumn("_k", rank).filter(F.col("_k") <= top).drop("_k")
    return found


def breadth_first(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, id, hops): shortest distances up to depth by growing frontiers."""
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"))
    front = seen
    for k in range(1, depth + 1):
        step = front.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("_to")), "id").select("start", F.col("_to").alias("id")).distinct()
        front = cut(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def wl_labels(edges: DataFrame, nodes: DataFrame, rounds: int, label: str = "label") -> DataFrame:
    """(id, round, label): Weisfeiler-Lehman colours; md5 of the own label and the sorted neighbours', joined by "_".

    In the first round neighbours sort by their raw value, later as text.
    """
    now = nodes.select("id", F.col(label).alias("label"))
    out = now.select("id", F.lit(0).alias("round"), F.col("label").cast("string").alias("label"))
    for k in range(1, rounds + 1):
        near = edges.join(now.select(F.col("id").alias("dst"), F.col("label").alias("_l")), "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("_l")).alias("_near"))
        text = F.transform(F.coalesce("_near", F.array().cast(near.schema["_near"].dataType)), lambda x: x.cast("string"))
        now = now.join(near, "id", "left").select("id", F.md5(F.array_join(F.concat(F.array(F.col("label").cast("string")), text), "_")).alias("label"))
        now = cut(now) if k % EVERY == 0 else now
        out = out.unionByName(now.withColumn("round", F.lit(k)))
    return out


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """(id, label): each node takes its neighbours' most frequent label, ties to the smallest; a stand-in for k-way partitions."""
    now = nodes.select("id", F.col("id").alias("label"))

    def step(state):
        votes = edges.join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
        return state.join(best, "id", "left").select("id", F.coalesce(F.col("b.label"), F.col("label")).alias("label"))

    return _looped(now, step, rounds)


# --------------------------------------------------------------- walks and samples


def _choice(rows: DataFrame, key: list[str], seed: str, step: int, weight: Column | None = None) -> DataFrame:
    """One row of each key by least md5 of (seed, step, key, candidate), or by an exponential race in proportion to weight."""
    h = hashed(f"{seed}:{step}", *(F.col(c) for c in key), F.col("_to"))
    if weight is not None:
        u = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 1)
        h = -F.log(u) / weight
    return rows.groupBy(*key).agg(F.min_by("_to", F.struct(h.alias("h"), F.col("_to").alias("t"))).alias("_next"))


def random_walks(edges: DataFrame, starts: DataFrame, length: int, walks: int = 1, seed: str = "0", restart: float = 0.0, p: float | None = None, q: float | None = None, types: DataFrame | None = None, schema: list | None = None) -> DataFrame:
    """(walk, place, node): walks of up to `length` nodes from each start.

    Uniform over neighbours; `restart` goes back to the start with that chance
    (and a dead end stays); p and q weigh returning and moving away (second
    order); types (id, node_type) and a schema of types make meta-path walks.
    Without restart a walk ends at a dead end.  Choices are minima in md5
    order, combined before the shuffle.
    """
    out = cut(weighted(edges).groupBy("src", "dst").agg(F.sum("w").alias("w")).select(F.col("src").alias("node"), F.col("dst").alias("_to"), "w"))
    begun = starts.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("nth"))
    now = begun.select(F.concat_ws(":", "start", "nth").alias("walk"), "start", F.col("start").alias("node"), F.lit(None).cast("long").alias("prev"))
    if schema is not None:
        now = now.join(types.filter(F.col("node_type") == schema[0]).select(F.col("id").alias("node")), "node", "left_semi")
    now = cut(now)
    found = [now.select("walk", F.lit(0).alias("place"), "node")]
    for k in range(1, length):
        near = now.join(out, "node")
        if schema is not None:
            near = near.join(types.filter(F.col("node_type") == schema[k % (len(schema) - 1)]).select(F.col("id").alias("_to")), "_to", "left_semi")
        weight = None
        if p is not None:
            known = out.select(F.col("node").alias("_to"), F.col("_to").alias("prev"), F.lit(True).alias("_back"))
            near = near.join(known, ["_to", "prev"], "left")
            weight = F.when(F.col("prev").isNull(), F.col("w")).when(F.col("_to") == F.col("prev"), F.col("w") / p).when(F.col("_back"), F.col("w")).otherwise(F.col("w") / q)
            near = near.withColumn("_weight", weight)
            weight = F.col("_weight")
        picked = _choice(near, ["walk", "start", "node"], seed, k, weight)
        if restart:
            chance = F.conv(F.substring(hashed(f"{seed}:r{k}", F.col("walk")), 1, 8), 16, 10).cast("double") / float(1 << 32)
            moved = now.select("walk", "start", "node").join(picked.select("walk", "_next"), "walk", "left")
            now = moved.select("walk", "start", F.when(chance < restart, F.col("start")).otherwise(F.coalesce("_next", "node")).alias("node"), F.col("node").alias("prev"))
        else:
            now = picked.select("walk", "start", F.col("_next").alias("node"), F.col("node").alias("prev"))
        now = cut(now)
        found.append(now.select("walk", F.lit(k).alias("place"), "node"))
    total = found[0]
    for part in found[1:]:
        total = total.unionByName(part)
    return total


def sampled_neighbours(edges: DataFrame, seeds: DataFrame, size: int, seed: str = "0") -> DataFrame:
    """At most `size` edges of each seed, least md5 first (size -1: all)."""
    own = edges.join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    if size < 0:
        return own
    rank = F.row_number().over(Window.partitionBy("src").orderBy(hashed(seed, F.col("src"), F.col("dst")), "dst"))
    return own.withColumn("_k", rank).filter(F.col("_k") <= size).drop("_k")


def drawn_neighbours(edges: DataFrame, size: int, seed: str = "0") -> DataFrame:
    """(src, draw, dst): `size` neighbours of each node with edges, with replacement, drawn by md5 from its numbered neighbours."""
    one = edges.select("src", "dst").distinct()
    numbered = one.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("_k"))
    draws = one.groupBy("src").agg(F.count("*").alias("_n")).select("src", "_n", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("draw"))
    spot = F.pmod(F.conv(F.substring(hashed(seed, F.col("src"), F.col("draw")), 1, 15), 16, 10).cast("long"), F.col("_n"))
    return draws.withColumn("_k", spot).join(numbered, ["src", "_k"]).select("src", "draw", "dst")


def layered_sample(edges: DataFrame, seeds: DataFrame, sizes: list[int], seed: str = "0") -> DataFrame:
    """(hop, src, dst): edges sampled hop by hop from a growing frontier."""
    front, out = seeds.select("id"), None
    for k, size in enumerate(sizes):
        got = cut(sampled_neighbours(edges.select("src", "dst"), front, size, f"{seed}:{k}")).withColumn("hop", F.lit(k))
        out = got if out is None else out.unionByName(got)
        front = cut(front.union(got.select("dst")).distinct())
    return out.select("hop", "src", "dst")


def negative_edges(edges: DataFrame, nodes: DataFrame, each: int, seed: str = "0") -> DataFrame:
    """(src, dst): for each node `each` pairs that are no edges, the other end drawn by hash; a few drawn twice are fewer.

    Ends are drawn from numbered nodes, so no pair table is built.
    """
    from quillon.operators.tables import dense_positions

    numbered = cut(dense_positions(nodes.select("id").distinct(), [F.asc("id")], "_no"))
    n = numbered.count()
    draws = numbered.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("_k"))
    spot = F.pmod(F.conv(F.substring(hashed(seed, F.col("src"), F.col("_k")), 1, 15), 16, 10).cast("long"), F.lit(n))
    drawn = draws.withColumn("_no", spot).join(numbered.select("_no", F.col("id").alias("dst")), "_no").filter("src <> dst").select("src", "dst").distinct()
    return drawn.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def dropped_edges(edges: DataFrame, rate: float, seed: str = "0") -> DataFrame:
    """Edges whose md5 lies above the rate, and all loops."""
    at = F.conv(F.substring(hashed(seed, F.col("src"), F.col("dst")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return edges.filter((at >= rate) | (F.col("src") == F.col("dst")))


def _place(seed: str, *key) -> Column:
    """The place of a key's md5 in 0..1."""
    return F.conv(F.substring(hashed(seed, *key), 1, 8), 16, 10).cast("double") / float(1 << 32)


def dropped_nodes(nodes: DataFrame, rate: float, seed: str = "0") -> DataFrame:
    """Features of nodes whose md5 lies under the rate become zeros; the others are scaled by 1 / (1 - rate)."""
    gone = _place(seed, F.col("id")) < rate
    return nodes.withColumn("x", F.transform("x", lambda e: F.when(gone, 0.0).otherwise(e / (1 - rate))))


def dropped_features(nodes: DataFrame, width: int, rate: float, seed: str = "0") -> DataFrame:
    """Feature columns whose number's md5 lies under the rate become zeros, for all nodes alike."""
    return nodes.withColumn("x", F.array(*(F.when(_place(seed, F.lit(k)) < rate, 0.0).otherwise(F.col("x")[k]) for k in range(width))))


def masked_edges(edges: DataFrame, rate: float, seed: str = "0") -> DataFrame:
    """Edges with `masked`: held back as targets; both directions of a pair share their md5."""
    return edges.withColumn("masked", _place(seed, F.least("src", "dst"), F.greatest("src", "dst")) < rate)


def masked_attributes(nodes: DataFrame, width: int, rate: float, seed: str = "0") -> DataFrame:
    """Nodes with `masked`, zeros for the features of those masked, and their features as `target`."""
    zeros = F.array(*(F.lit(0.0) for _ in range(width)))
    marked = nodes.withColumn("masked", _place(seed, F.col("id")) < rate)
    return marked.withColumn("target", F.when(F.col("masked"), F.col("x"))).withColumn("x", F.when(F.col("masked"), zeros).otherwise(F.col("x")))


def random_partition(nodes: DataFrame, parts: int, seed: str = "0") -> DataFrame:
    """(id, part): nodes dealt to parts by md5."""
    spot = F.conv(F.substring(hashed(seed, F.col("id")), 1, 15), 16, 10).cast("long")
    return nodes.select("id", F.pmod(spot, F.lit(parts)).alias("part"))


def partition_subgraphs(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges with both ends in one part, with that part; parts is (id, part), of any partition."""
    a = parts.select(F.col("id").alias("src"), "part")
    b = parts.select(F.col("id").alias("dst"), F.col("part").alias("_other"))
    return edges.join(a, "src").join(b, "dst").filter(F.col("part") == F.col("_other")).drop("_other")


def layerwise(edges: DataFrame, nodes: DataFrame, width: int, layers: int, own: float = 0.5) -> DataFrame:
    """(id, x): layer after layer for all nodes, own share and neighbours' weighted sum, negative values cut.

    Each layer is one join and one aggregate over whole tables, so no node is
    computed more than once a layer, however many neighbourhoods it is in.
    """
    zeros = F.array(*(F.lit(0.0) for _ in range(width)))

    def step(now):
        g = spmm(edges, now, width).withColumnRenamed("x", "g")
        mixed = V.plus(V.scaled(F.col("x"), F.lit(own)), V.scaled(F.coalesce("g", zeros), F.lit(1 - own)))
        return now.join(g, "id", "left").select("id", F.transform(mixed, lambda e: F.greatest(e, F.lit(0.0))).alias("x"))

    return _looped(nodes.select("id", "x"), step, layers)


def compressed(edges: DataFrame, line: str = "src", other: str = "dst") -> DataFrame:
    """(line, pointer, indices): compressed rows (or columns) of an edge table: where each line begins, and its sorted other ends."""
    lines = edges.groupBy(F.col(line).alias("line")).agg(F.sort_array(F.collect_list(other)).alias("indices"))
    return running_total(lines.withColumn("_n", F.size("indices").cast("long")), [F.asc("line")], "_n", "pointer").select("line", "pointer", "indices")


def top_edges(edges: DataFrame, k: int, by: str = "src") -> DataFrame:
    """The k heaviest edges of each row (or column), weights brought to sum 1 there."""
    other = "dst" if by == "src" else "src"
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("w"), other))
    kept = edges.withColumn("_k", rank).filter(F.col("_k") <= k).drop("_k")
    return kept.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(by)))


def sparsified(edges: DataFrame, eps: float) -> DataFrame:
    """Edges of at least eps, weights brought to sum 1 by column."""
    return edges.filter(F.col("w") >= eps).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("dst")))


def top_nodes(nodes: DataFrame, graph: str, score: str, rate: float) -> DataFrame:
    """Nodes with the max(2, floor(rate * n)) highest scores of their graph."""
    n = F.count("*").over(Window.partitionBy(graph))
    rank = F.row_number().over(Window.partitionBy(graph).orderBy(F.desc(score), "id"))
    return nodes.withColumn("_n", n).withColumn("_k", rank).filter(F.col("_k") <= F.greatest(F.lit(2), F.floor(rate * F.col("_n")))).drop("_n", "_k")


def sort_pooled(nodes: DataFrame, graph: str, k: int, width: int) -> DataFrame:
    """(graph, x): the k nodes with the largest last channel, flattened, padded with zeros."""
    rank = F.row_number().over(Window.partitionBy(graph).orderBy(F.desc(F.element_at("x", -1)), "id"))
    kept = nodes.withColumn("_k", rank).filter(F.col("_k") <= k)
    flat = kept.groupBy(graph).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_k", "x"))), lambda s: s["x"])).alias("x"))
    return flat.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(k * width) - F.size("x"))))


def bag_kernel(labels: DataFrame, graph: str = "graph_id", label: str = "label") -> DataFrame:
    """(a, b, k): for pairs of graphs that share a label, the product of their label counts summed.

    The pairs are the result.  Graphs that share a label are dealt to blocks, so
    that a common label's pairs are made by many tasks, two blocks at a time.
    """
    c = cut(labels.groupBy(graph, label).agg(F.count("*").alias("n")))
    blocks = c.groupBy(label).agg(F.ceil(F.count("*") / BAG_BLOCK).cast("long").alias("_m"))
    c = c.join(blocks, label).withColumn("_b", F.pmod(F.xxhash64(graph), F.col("_m")))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))
    left = c.select(F.col(graph).alias("a"), label, "n", F.col("_b").alias("_i"), spread.alias("_j"))
    right = c.select(F.col(graph).alias("b"), label, F.col("n").alias("_n"), F.col("_b").alias("_j"), spread.alias("_i"))
    return left.join(right, [label, "_i", "_j"]).filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("n") * F.col("_n")).alias("k"))


def relation_composed(edges: DataFrame, nodes: DataFrame, relations: DataFrame, width: int, op: str = "sub") -> DataFrame:
    """Mean by row of the other end's features less (or times) the relation's."""
    f = {"sub": V.minus, "mul": V.times}[op]
    g = gathered(edges, nodes).join(relations.select("etype", F.col("x").alias("_r")), "etype")
    return vector_sum(g, ["src"], f(F.col("x"), F.col("_r")), width, mean=True).withColumnRenamed("src", "id")


# --------------------------------------------------------------- matrices of pairs


def katz(edges: DataFrame, beta: float, order: int) -> DataFrame:
    """(src, dst, w): sum of beta^k A^k for k = 1..order, by repeated sparse products."""
    a = cut(coalesced(edges))
    total = power = scaled = a.select("src", "dst", (beta * F.col("w")).alias("w"))
    for k in range(2, order + 1):
        if k == order:  # the last power is summed where it is made
            return product(power, scaled, total)
        power = cut(product(power, scaled))
        total = total.union(power)
    return total


def positive_pmi(edges: DataFrame) -> DataFrame:
    """(src, dst, w): ln(w * total / (row sum * column sum)) where that is positive."""
    e = coalesced(edges)
    row = e.groupBy("src").agg(F.sum("w").alias("_r"))
    column = e.groupBy("dst").agg(F.sum("w").alias("_c"))
    total = e.agg(F.sum("w").alias("_t"))
    made = e.join(row, "src").join(column, "dst").crossJoin(F.broadcast(total))  # one row
    return made.select("src", "dst", F.log(F.col("w") * F.col("_t") / (F.col("_r") * F.col("_c"))).alias("w")).filter("w > 0")


def log_walk_matrix(edges: DataFrame, window: int = 1, negative: float = 1.0) -> DataFrame:
    """(src, dst, w): ln(max(M, 1)) of the window-mean walk matrix M = volume / negative * mean_k(P^k) D^-1, zeros left out."""
    e = coalesced(edges)
    degree = cut(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("_d")))
    volume = degree.agg(F.sum("_d").alias("_v"))
    walk = e.join(degree.withColumnRenamed("id", "src"), "src").select("src", "dst", (F.col("w") / F.col("_d")).alias("w"))
    power, total = walk, walk
    for _ in range(1, window):
        power = cut(product(power, walk))
        total = total.union(power)
    mean = total.groupBy("src", "dst").agg((F.sum("w") / window).alias("w"))
    made = mean.join(degree.withColumnRenamed("id", "dst"), "dst").crossJoin(F.broadcast(volume))  # one row
    return made.select("src", "dst", F.log(F.col("_v") / negative * F.col("w") / F.col("_d")).alias("w")).filter("w > 0")


def betweenness(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, score): for each node, the shares of shortest paths from the sources that pass through it, summed over all ends.

    Edges count once a pair, whatever their direction and weight.  Paths are
    counted forward, level by level for all sources together, and shares are
    summed backward; in an undirected graph a node of the next level is new if
    it is in neither of the last two.  With all nodes as sources each pair
    counts from both ends.  depth cuts paths off; else the levels go on until
    none is new.  Nodes that no path passes through have 0; other nodes that no
    source reaches are left out.
    """
    e = cut(mirrored(without_loops(edges)))
    levels = [cut(sources.select(F.col("id").alias("s"), "id").distinct().withColumn("n", F.lit(1.0)))]
    while depth is None or len(levels) <= depth:
        last = levels[-1]
        reached = last.join(e, last["id"] == e["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.sum("n").alias("n"))
        for before in levels[-2:]:
            reached = reached.join(before.select("s", "id"), ["s", "id"], "left_anti")
        reached = cut(reached)
        if reached.isEmpty():
            break
        levels.append(reached)
    below = cut(levels[-1].withColumn("d", F.lit(0.0)))
    parts = [below]
    for level in reversed(levels[:-1]):
        share = below.join(e, below["id"] == e["src"]).select("s", F.col("dst").alias("id"), ((1 + F.col("d")) / F.col("n")).alias("_x"))
        passed = share.join(level.select("s", "id"), ["s", "id"], "left_semi").groupBy("s", "id").agg(F.sum("_x").alias("_x"))
        below = cut(level.join(passed, ["s", "id"], "left").select("s", "id", "n", (F.col("n") * F.coalesce("_x", F.lit(0.0))).alias("d")))
        parts.append(below)
    every = parts[0].select("s", "id", "d")
    for p in parts[1:]:
        every = every.unionByName(p.select("s", "id", "d"))
    return every.groupBy("id").agg(F.sum(F.when(F.col("s") != F.col("id"), F.col("d")).otherwise(0.0)).alias("score"))


def receptive_fields(edges: DataFrame, starts: DataFrame, size: int, depth: int = 2) -> DataFrame:
    """(start, place, id): the first `size` nodes around each start, nearer first, then higher degree, then id."""
    near = breadth_first(edges, starts, depth).join(degrees(edges), "id", "left")
    place = F.row_number().over(Window.partitionBy("start").orderBy("hops", F.desc(F.coalesce("degree", F.lit(0))), "id"))
    return near.withColumn("place", place).filter(F.col("place") <= size).select("start", "place", "id")


def absorption(edges: DataFrame, labels: DataFrame, alpha: float = 0.5, order: int = 3) -> DataFrame:
    """(id, label, p): mass that walks from each labelled node leave, by label: alpha * sum of (1 - alpha)^k P^k to `order`."""
    walk = cut(normalised(edges, "row"))
    now = labels.select(F.col("id"), "label", F.lit(1.0).alias("v"))
    total = now.select("id", "label", (alpha * F.col("v")).alias("p"))
    for k in range(1, order + 1):
        g = walk.join(now.withColumnRenamed("id", "src"), "src")
        now = cut(g.groupBy(F.col("dst").alias("id"), "label").agg(F.sum(F.col("w") * F.col("v")).alias("v")))
        total = total.union(now.select("id", "label", (alpha * (1 - alpha) ** k * F.col("v")).alias("p")))
    return total.groupBy("id", "label").agg(F.sum("p").alias("p"))
