"""Graph queries over supplier-part and part-to-part edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import graph as G
from quillon.operators import partition as P
from quillon.operators import ranking as R
from quillon.plans.registry import query, rounded
from quillon.sources import tables as S
from quillon.sources.tables import table

#: Part to the next part of the same order; sparse enough to walk.
_P = """pe AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL GROUP BY ALL)"""
_N = "n AS (SELECT p_partkey AS id, [p_size / 9.7, p_retailprice / 997.0, sqrt(p_partkey % 5)] AS x, sqrt(p_partkey % 11) / 10.0 AS v FROM part)"
_L = "nl AS (SELECT id, generate_subscripts(x, 1) AS k, unnest(x) AS x FROM n)"
_B = "b AS (SELECT l_suppkey AS src, 1000000000 + l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)"
_A = "a AS (SELECT src, dst, w / count(*) OVER (PARTITION BY src) AS w FROM pe)"
WIDTH = 3


def _edges(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    li, tasks = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), _tasks(spark, d)
    e = S.dealt(li, tasks, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).filter("dst is not null")
    return G.multiplicity(S.dealt(e, tasks, "src", "dst"))


def _tasks(spark, d, times=1):
    """Tasks for tables of at most `times` as many rows as lines, counted from the file's footer."""
    return S.tasks_for(times * table(spark, d, "lineitem").count())


def _nodes(spark, d):
    p = F.col("p_partkey")
    return table(spark, d, "part").select(p.alias("id"), F.array(F.col("p_size") / 9.7, F.col("p_retailprice") / 997, F.sqrt(p % 5)).alias("x"), (F.sqrt(p % 11) / 10).alias("v"))


def _bipartite(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000000).alias("dst")).agg(F.sum("l_quantity").alias("w"))


@query(f"WITH {_P} SELECT src, dst, w FROM pe")
def edge_multiplicity(spark, d):
    """Weights as multiplicities."""
    return rounded(_edges(spark, d))


@query(f"WITH {_P} SELECT p_partkey AS id, count(src) AS degree FROM part LEFT JOIN pe ON src = p_partkey GROUP BY 1")
def node_degrees(spark, d):
    """Edge counts, 0 for nodes without edges."""
    return G.degrees(_edges(spark, d), _nodes(spark, d))


@query(f"WITH {_P} SELECT src, dst FROM pe UNION SELECT dst, src FROM pe")
def mirrored_edges(spark, d):
    """U06."""
    return G.mirrored(_edges(spark, d), _tasks(spark, d, 2))


@query(f"WITH {_P} SELECT src, dst FROM pe WHERE src <> dst UNION SELECT dst, src FROM pe WHERE src <> dst")
def undirected_edges(spark, d):
    """S12, S20."""
    return S.undirected(_edges(spark, d), tasks=_tasks(spark, d, 2))


@query(f"""WITH {_P} SELECT src, dst, w FROM pe WHERE src <> dst UNION ALL SELECT p_partkey, p_partkey, coalesce((SELECT max(w) FROM pe WHERE src = p_partkey AND dst = p_partkey), 0.5) FROM part""")
def remaining_loops(spark, d):
    """One loop a node, existing weights kept."""
    return rounded(G.with_loops(_edges(spark, d), _nodes(spark, d), 0.5))


for _how, _expr in (("row", "w / count(*) OVER (PARTITION BY src)"), ("col", "w / count(*) OVER (PARTITION BY dst)"), ("sym", "coalesce(w / sqrt(count(*) OVER (PARTITION BY src) * (SELECT nullif(count(*), 0) FROM pe q WHERE q.src = pe.dst)), 0)")):

    def _norm(spark, d, how=_how):
        return rounded(G.normalised(_edges(spark, d), how))

    _norm.__name__ = f"normalised_{_how}"
    _norm.__doc__ = f"G06: {_how} normalisation by edge counts."
    query(f"WITH {_P} SELECT src, dst, round({_expr}, 6) AS w FROM pe")(_norm)


@query(f"""WITH {_P}, {_N}, a AS (SELECT src, dst, w FROM pe WHERE src <> dst UNION ALL SELECT id, id, coalesce((SELECT max(w) FROM pe WHERE src = id AND dst = id), 1.0) FROM n),
g AS (SELECT src, sum(w) ** -0.5 AS f FROM a GROUP BY 1) SELECT a.src, dst, round(w * g.f * h.f, 6) AS w FROM a JOIN g USING (src) JOIN g h ON h.src = a.dst""")
def weighted_normalisation(spark, d):
    """D^-1/2 (A + I) D^-1/2 with weighted degrees."""
    return rounded(G.weighted_normalised(_edges(spark, d), _nodes(spark, d)))


@query(f"WITH {_P} SELECT src, dst, w FROM pe WHERE src % 3 <> 0 AND dst % 3 <> 0")
def induced_subgraph(spark, d):
    """J13, G10."""
    return rounded(G.induced(_edges(spark, d), _nodes(spark, d).filter("id % 3 <> 0")).select("src", "dst", "w"))


@query(f"WITH {_P} SELECT s.src, pe.dst, sum(s.w * pe.w) AS w FROM pe s JOIN pe ON s.dst = pe.src GROUP BY ALL")
def two_hop_product(spark, d):
    """A times A."""
    e = S.cut(_edges(spark, d))
    return rounded(G.product(e, e))


@query(f"WITH {_P}, {_N}, {_L}, s AS (SELECT src AS id, k, sum(w * x) AS x FROM pe JOIN nl ON nl.id = pe.dst GROUP BY ALL) SELECT id, list(round(x, 6) ORDER BY k) AS x FROM s GROUP BY 1")
def sparse_product(spark, d):
    """Weighted sums of neighbours' features."""
    return rounded(G.spmm(_edges(spark, d), _nodes(spark, d), WIDTH))


@query(f"""WITH {_P}, {_N}, {_L}, h AS (SELECT src, dst, unnest([0, 1]) AS head, unnest([w, w * 0.5]) AS w FROM pe), s AS (SELECT src AS id, head, k, sum(w * x) AS x FROM h JOIN nl ON nl.id = h.dst GROUP BY ALL)
SELECT id, CAST(head AS BIGINT) AS head, list(round(x, 6) ORDER BY k) AS x FROM s GROUP BY ALL""")
def multi_head_product(spark, d):
    """G02."""
    e = _edges(spark, d).select("src", "dst", F.posexplode(F.array("w", F.col("w") * 0.5)).alias("head", "w"))
    g = G.gathered(e, _nodes(spark, d))
    return rounded(G.vector_sum(g, ["src", "head"], V.scaled(F.col("x"), F.col("w")), WIDTH).withColumnRenamed("src", "id"))


for _op, _sql in (("add", "x + 1"), ("sub", "x - 1"), ("mul", "x * 2")):
    for _how in ("sum", "avg"):

        def _family(spark, d, op=_op, how=_how):
            fill = F.lit(2.0 if op == "mul" else 1.0)
            e = _edges(spark, d).withColumn("e", F.array(*[fill] * WIDTH))
            return rounded(G.aggregated(e, _nodes(spark, d), WIDTH, op, "mean" if how == "avg" else "sum"))

        _family.__name__ = f"source_{_op}_edge_{'mean' if _how == 'avg' else 'sum'}"
        _family.__doc__ = "A15, A16: source features combined with edge features, aggregated by row."
        query(f"WITH {_P}, {_N}, {_L}, s AS (SELECT src AS id, k, {_how}(({_sql}) * w) AS x FROM pe JOIN nl ON nl.id = pe.dst GROUP BY ALL) SELECT id, list(round(x, 6) ORDER BY k) AS x FROM s GROUP BY 1")(_family)


for _op, _sql in (("add", "a.x + b.x"), ("sub", "a.x - b.x"), ("mul", "a.x * b.x"), ("div", "coalesce(a.x / nullif(b.x, 0), 0)")):

    def _messages(spark, d, op=_op):
        return rounded(G.messages(_edges(spark, d), _nodes(spark, d), op))

    _messages.__name__ = f"edge_message_{_op}"
    _messages.__doc__ = "A17: features of an edge's two ends combined."
    query(f"WITH {_P}, {_N}, {_L} SELECT src, dst, list(round({_sql}, 6) + 0.0 ORDER BY a.k) AS m FROM pe JOIN nl a ON a.id = src JOIN nl b ON b.id = dst AND a.k = b.k GROUP BY ALL")(_messages)


@query(f"WITH {_P}, {_N}, {_L} SELECT src, dst, round(sum(a.x * b.x), 6) AS m FROM pe JOIN nl a ON a.id = src JOIN nl b ON b.id = dst AND a.k = b.k GROUP BY ALL")
def edge_dot(spark, d):
    """G03."""
    return rounded(G.messages(_edges(spark, d), _nodes(spark, d), "dot"))


@query(f"WITH {_P}, {_N}, {_L}, s AS (SELECT src AS id, k, max(x) AS x FROM pe JOIN nl ON nl.id = pe.dst GROUP BY ALL) SELECT id, list(round(x, 6) ORDER BY k) AS x FROM s GROUP BY 1")
def segment_max(spark, d):
    """The true maximum."""
    g = G.gathered(_edges(spark, d), _nodes(spark, d))
    return rounded(G.vector_max(g, ["src"], F.col("x"), WIDTH).withColumnRenamed("src", "id"))


for _how in ("sum", "avg", "max"):

    def _pool(spark, d, how=_how):
        return rounded(G.pooled(_nodes(spark, d).withColumn("g", F.col("id") % 7), "g", WIDTH, "mean" if how == "avg" else how))

    _pool.__name__ = f"graph_pool_{'mean' if _how == 'avg' else _how}"
    _pool.__doc__ = "A19, A20: features pooled by graph."
    query(f"WITH {_N}, {_L}, s AS (SELECT id % 7 AS g, k, {_how}(x) AS x FROM nl GROUP BY ALL) SELECT g, list(round(x, 6) ORDER BY k) AS x FROM s GROUP BY 1")(_pool)


@query(f"WITH {_B} SELECT src, dst, round(exp(w - max(w) OVER (PARTITION BY src)) / sum(exp(w - (SELECT max(w) FROM b c WHERE c.src = b.src))) OVER (PARTITION BY src), 6) AS p FROM b")
def edge_softmax(spark, d):
    """G04."""
    return rounded(G.edge_softmax(_bipartite(spark, d)).select("src", "dst", "p"))


@query(f"""WITH {_P}, {_N}, {_L}, q AS (SELECT id, x[1] * 0.3 + x[2] * 0.2 - x[3] * 0.1 AS l, x[1] * -0.2 + x[2] * 0.1 + x[3] * 0.05 AS r FROM n),
s AS (SELECT src, dst, CASE WHEN a.l + b.r > 0 THEN a.l + b.r ELSE (a.l + b.r) * 0.2 END AS s FROM pe JOIN q a ON a.id = src JOIN q b ON b.id = dst),
p AS (SELECT src, dst, exp(s) / sum(exp(s)) OVER (PARTITION BY src) AS p FROM s), t AS (SELECT src AS id, k, sum(p * x) AS x FROM p JOIN nl ON nl.id = dst GROUP BY ALL)
SELECT id, list(round(x, 6) ORDER BY k) AS x FROM t GROUP BY 1""")
def attention(spark, d):
    """Attention with given weights."""
    return rounded(G.attended(_edges(spark, d), _nodes(spark, d), WIDTH, [0.3, 0.2, -0.1], [-0.2, 0.1, 0.05]))


@query(f"""WITH {_N}, {_L}, e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS etype FROM lineitem), s AS (SELECT src AS id, etype, k, avg(x) AS x FROM e JOIN nl ON nl.id = dst GROUP BY ALL)
SELECT id, etype, list(round(x, 6) ORDER BY k) AS x FROM s GROUP BY ALL""")
def relational_mean(spark, d):
    """By edge type."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("etype")).distinct()
    return rounded(G.relational(e, _nodes(spark, d), WIDTH))


@query(f"""WITH {_N}, {_L}, e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, l_returnflag AS etype FROM lineitem), s AS (SELECT src AS id, k, avg(x - ascii(etype) / 100.0 * k) AS x FROM e JOIN nl ON nl.id = dst GROUP BY ALL)
SELECT id, list(round(x, 6) ORDER BY k) AS x FROM s GROUP BY ALL""")
def relation_composition(spark, d):
    """G38."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("etype")).distinct()
    r = e.select("etype").distinct().select("etype", F.array(*(F.ascii("etype") / 100 * k for k in (1, 2, 3))).alias("x"))
    return rounded(G.relation_composed(e, _nodes(spark, d), r, WIDTH))


@query(f"""WITH {_P}, {_N}, c AS (SELECT src AS id, 1 - list_cosine_similarity(a.x, b.x) AS d FROM pe JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE src <> dst)
SELECT id, round(sum(d) / greatest(count(*) - 1, 1), 6) AS s FROM c GROUP BY 1""")
def smoothness_index(spark, d):
    """G26."""
    return rounded(G.smoothness(_edges(spark, d), _nodes(spark, d)))


def _step(k, expr):
    return f"v{k} AS (SELECT n.id, {expr} AS v FROM n LEFT JOIN (SELECT src, sum(w * v) AS g FROM a JOIN v{k - 1} ON v{k - 1}.id = a.dst GROUP BY 1) t ON t.src = n.id)"


@query(f"WITH {_P}, {_A}, {_N}, v0 AS (SELECT id, v FROM n), {', '.join(_step(k, '0.8 * coalesce(g, 0) + 0.2 * n.v') for k in (1, 2, 3, 4))} SELECT id, round(v, 6) AS v FROM v4")
def propagated_scores(spark, d):
    """Four rounds of v <- 0.8 A v + 0.2 v0."""
    a = G.normalised(_edges(spark, d), "row")
    return rounded(G.propagated(S.cut(a), _nodes(spark, d).select("id", "v"), 0.8, 4))


@query(f"WITH {_P}, {_A}, {_N}, v0 AS (SELECT id, v FROM n), {', '.join(_step(k, 'least(greatest(0.9 * coalesce(g, 0) + 0.1 * n.v, 0), 0.5)') for k in (1, 2))} SELECT id, round(v, 6) AS v FROM v2")
def clamped_propagation(spark, d):
    """G20, P31."""
    a = G.normalised(_edges(spark, d), "row")
    return rounded(G.propagated(a, _nodes(spark, d).select("id", "v"), 0.9, 2, 0.0, 0.5))


def _series_sql(coefficients):
    steps = ", ".join(_step(k, "coalesce(g, 0)") for k in range(1, len(coefficients)))
    total = " + ".join(f"{c!r} * v{k}.v" for k, c in enumerate(coefficients))
    joins = " ".join(f"JOIN v{k} USING (id)" for k in range(1, len(coefficients)))
    return f"WITH {_P}, {_A}, {_N}, v0 AS (SELECT id, v FROM n), {steps} SELECT v0.id, round({total}, 6) AS v FROM v0 {joins}"


@query(_series_sql(G.heat_coefficients(1.0, 3)))
def heat_diffusion(spark, d):
    """Heat kernel series."""
    return rounded(G.series(S.cut(G.normalised(_edges(spark, d), "row")), _nodes(spark, d), G.heat_coefficients(1.0, 3)))


@query(_series_sql(G.ppr_coefficients(0.15, 3)))
def pagerank_series(spark, d):
    """Personalised PageRank series."""
    return rounded(G.series(S.cut(G.normalised(_edges(spark, d), "row")), _nodes(spark, d), G.ppr_coefficients(0.15, 3)))


def _chebyshev_sql(order, mu=0.5, theta=0.5):
    """t0 = v, t1 = M^2 t0 / 2 - t0, t(k) = M^2 t(k - 1) - 2 t(k - 1) - t(k - 2), M = (1 - mu) I - A, weighted by Bessel coefficients."""
    parts = ["t0 AS (SELECT id, v FROM n)"]

    def twice(k):
        for a, b in ((f"t{k}", f"m{k}"), (f"m{k}", f"q{k}")):
            parts.append(f"{b} AS (SELECT x.id, {1 - mu!r} * x.v - coalesce(s.v, 0) AS v FROM {a} x LEFT JOIN (SELECT src, sum(w * v) AS v FROM a JOIN {a} y ON y.id = a.dst GROUP BY 1) s ON s.src = x.id)")

    twice(0)
    parts.append("t1 AS (SELECT id, 0.5 * q0.v - t0.v AS v FROM q0 JOIN t0 USING (id))")
    for k in range(2, order):
        twice(k - 1)
        parts.append(f"t{k} AS (SELECT id, q{k - 1}.v - 2 * t{k - 1}.v - t{k - 2}.v AS v FROM q{k - 1} JOIN t{k - 1} USING (id) JOIN t{k - 2} USING (id))")
    weights = [G.bessel(0, theta)] + [2 * G.bessel(k, theta) * (-1) ** k for k in range(1, order)]
    total = " + ".join(f"{w!r} * t{k}.v" for k, w in enumerate(weights))
    return f"WITH {_P}, {_A}, {_N}, {', '.join(parts)} SELECT id, round({total}, 6) AS v FROM t0 " + " ".join(f"JOIN t{k} USING (id)" for k in range(1, order))


@query(_chebyshev_sql(4))
def chebyshev_filter(spark, d):
    """A Gaussian filter in Chebyshev terms."""
    return rounded(G.chebyshev_gaussian(S.cut(G.normalised(_edges(spark, d), "row")), _nodes(spark, d), 4))


@query(f"""WITH {_P}, {_A}, {_N}, {_L}, h1 AS (SELECT n.id, nk.k, coalesce(g.x, 0) AS x FROM n CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) nk LEFT JOIN (SELECT src, k, sum(w * x) AS x FROM a JOIN nl ON nl.id = a.dst GROUP BY ALL) g ON g.src = n.id AND g.k = nk.k),
h2 AS (SELECT n.id, nk.k, coalesce(g.x, 0) AS x FROM n CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) nk LEFT JOIN (SELECT src, k, sum(w * x) AS x FROM a JOIN h1 ON h1.id = a.dst GROUP BY ALL) g ON g.src = n.id AND g.k = nk.k)
SELECT id, CAST(hop AS BIGINT) AS hop, list(round(x, 6) ORDER BY k) AS x FROM (SELECT id, 0 AS hop, k, x FROM nl UNION ALL SELECT id, 1, k, x FROM h1 UNION ALL SELECT id, 2, k, x FROM h2) GROUP BY ALL""")
def hop_features(spark, d):
    """Features and their repeated averages."""
    return rounded(G.hop_features(S.cut(G.normalised(_edges(spark, d), "row")), _nodes(spark, d), WIDTH, 2).select("id", "hop", "x"))


@query()
def personalised_pagerank(spark, d):
    """Push from every node until no residual is large, beyond the first neighbours; the 32 best of each seed."""
    return rounded(G.personalised_pagerank(_edges(spark, d), _nodes(spark, d), 0.5, 1e-4, 32, _tasks(spark, d, 2)))


@query(f"""WITH RECURSIVE {_P}, f AS (SELECT CAST(p_partkey AS BIGINT) AS start, CAST(p_partkey AS BIGINT) AS id, 0 AS hops FROM part WHERE p_partkey % 100 = 0
 UNION SELECT f.start, pe.dst, hops + 1 FROM f JOIN pe ON pe.src = f.id WHERE hops < 3)
SELECT start, id, CAST(min(hops) AS BIGINT) AS hops FROM f GROUP BY ALL""")
def breadth_first(spark, d):
    """Distances up to three hops from the stated starts (ids divisible by 100) over all edges."""
    return rounded(G.breadth_first(S.cut(_edges(spark, d).select("src", "dst")), _nodes(spark, d).filter("id % 100 = 0"), 3))


def _wl(k, prev, cast):
    return f"l{k} AS (SELECT {prev}.id, md5(array_to_string(list_concat([CAST({prev}.label AS VARCHAR)], coalesce(t.ls, [])), '_')) AS label FROM {prev} LEFT JOIN (SELECT src, list(CAST(label AS VARCHAR) ORDER BY label) AS ls FROM pe JOIN {prev} ON {prev}.id = pe.dst GROUP BY 1) t ON t.src = {prev}.id)"


@query(f"""WITH {_P}, l0 AS (SELECT p_partkey AS id, p_size AS label FROM part), {_wl(1, 'l0', True)}, {_wl(2, 'l1', False)}
SELECT id, CAST(0 AS BIGINT) AS round, CAST(label AS VARCHAR) AS label FROM l0 UNION ALL SELECT id, 1, label FROM l1 UNION ALL SELECT id, 2, label FROM l2""")
def wl_relabel(spark, d):
    """Two rounds of Weisfeiler-Lehman colours."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("label"))
    return rounded(G.wl_labels(S.cut(_edges(spark, d).select("src", "dst")), nodes, 2).select("id", "round", "label"))


@query(f"""WITH {_P}, l0 AS (SELECT p_partkey AS id, p_partkey AS label FROM part),
v1 AS (SELECT src AS id, label, count(*) AS n FROM pe JOIN l0 ON l0.id = dst GROUP BY ALL), l1 AS (SELECT l0.id, coalesce(t.label, l0.label) AS label FROM l0 LEFT JOIN (SELECT id, label FROM v1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1) t USING (id)),
v2 AS (SELECT src AS id, label, count(*) AS n FROM pe JOIN l1 ON l1.id = dst GROUP BY ALL), l2 AS (SELECT l1.id, coalesce(t.label, l1.label) AS label FROM l1 LEFT JOIN (SELECT id, label FROM v2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1) t USING (id))
SELECT id, label FROM l2""")
def label_propagation(spark, d):
    """Partitions by label propagation, two rounds."""
    return G.label_propagation(S.cut(_edges(spark, d)), _nodes(spark, d), 2)


def _walk_sql(name, walks=1, restart=None, p=None, q=None, schema=None, length=4):
    """The walks in SQL: every step takes the neighbour of least md5, or wins an exponential race by weight."""
    h = lambda k: f"md5('{name}:{k}|' || v.walk || '|' || v.start || '|' || v.node || '|' || e.dst)"
    weight = f"CASE WHEN v.prev IS NULL THEN e.w WHEN e.dst = v.prev THEN e.w / {p} WHEN r.src IS NOT NULL THEN e.w ELSE e.w / {q} END"
    race = lambda k: f"-ln((CAST('0x' || substr({h(k)}, 1, 12) AS BIGINT) + 1) / 281474976710657.0) / ({weight})"
    typed = lambda k, c: "" if schema is None else f" AND {c} % 2 = {schema[k % (len(schema) - 1)]}"
    parts = [f"w0 AS (SELECT p_partkey || ':' || nth AS walk, p_partkey AS start, p_partkey AS node, CAST(NULL AS BIGINT) AS prev FROM part, range({walks}) t(nth) WHERE true{typed(0, 'p_partkey')})"]
    for k in range(1, length):
        back = "" if p is None else " LEFT JOIN pe r ON r.src = e.dst AND r.dst = v.prev"
        parts.append(f"c{k} AS (SELECT v.walk, v.start, v.node, arg_min(e.dst, {h(k) if p is None else race(k)}) AS nxt FROM w{k - 1} v JOIN pe e ON e.src = v.node{typed(k, 'e.dst')}{back} GROUP BY ALL)")
        if restart is None:
            parts.append(f"w{k} AS (SELECT walk, start, nxt AS node, node AS prev FROM c{k})")
        else:
            chance = f"CAST('0x' || substr(md5('{name}:r{k}|' || v.walk), 1, 8) AS BIGINT) / 4294967296.0"
            parts.append(f"w{k} AS (SELECT v.walk, v.start, CASE WHEN {chance} < {restart} THEN v.start ELSE coalesce(nxt, v.node) END AS node, v.node AS prev FROM w{k - 1} v LEFT JOIN c{k} USING (walk))")
    return f"WITH {_P}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT walk, CAST({k} AS BIGINT) AS place, CAST(node AS BIGINT) AS node FROM w{k}" for k in range(length))


def _walks(name, doc, **options):
    def f(spark, d):
        starts = _nodes(spark, d)
        more = dict(options)
        if "schema" in more:
            more["types"] = _nodes(spark, d).select("id", (F.col("id") % 2).alias("node_type"))
        return rounded(G.random_walks(_edges(spark, d), starts, 4, seed=name, **more))

    f.__name__, f.__doc__ = name, doc
    query(_walk_sql(name, **options))(f)


_walks("uniform_walks", "G11: repeatable random walks.", walks=2)
_walks("restart_walks", "G12: with restart; a dead end stays.", restart=0.3)
_walks("biased_walks", "G13: second order, p and q.", p=0.5, q=2.0)
_walks("metapath_walks", "G14: node types by a closed schema.", schema=[0, 1, 0])


@query(f"""WITH {_P} SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('n|' || src || '|' || dst), dst) AS k FROM pe) WHERE k <= 4""")
def neighbour_sample(spark, d):
    """At most four neighbours of each node, without replacement."""
    return G.sampled_neighbours(S.dealt(_edges(spark, d).select("src", "dst"), _tasks(spark, d), "src"), _nodes(spark, d), 4, "n")


@query(f"""WITH {_P}, o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS n FROM pe),
r AS (SELECT DISTINCT src, n, unnest(range(1, 5)) AS draw FROM o), c AS (SELECT src, draw, CAST('0x' || substr(md5('nr|' || src || '|' || draw), 1, 15) AS BIGINT) % n AS k FROM r)
SELECT c.src, CAST(draw AS BIGINT) AS draw, dst FROM c JOIN o USING (src, k)""")
def neighbour_draws(spark, d):
    """Four neighbours of each node, with replacement."""
    return rounded(G.drawn_neighbours(_edges(spark, d).select("src", "dst"), 4, "nr"))


@query(f"""WITH {_P}, h0 AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5('y:0|' || src || '|' || dst), dst) AS k FROM pe WHERE src % 100 = 0) WHERE k <= 3),
f AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 100 = 0 UNION SELECT dst FROM h0),
h1 AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5('y:1|' || src || '|' || dst), dst) AS k FROM pe WHERE src IN (SELECT id FROM f)) WHERE k <= 2)
SELECT CAST(0 AS BIGINT) AS hop, src, dst FROM h0 UNION ALL SELECT 1, src, dst FROM h1""")
def layered_sample(spark, d):
    """Two layers of sampled neighbours."""
    return rounded(G.layered_sample(S.cut(_edges(spark, d)), _nodes(spark, d).filter("id % 100 = 0"), [3, 2], "y"))


@query(f"""WITH {_P}, n AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS no, count(*) OVER () AS n FROM part), k AS (SELECT id AS src, n, unnest([1, 2, 3]) AS k FROM n),
s AS (SELECT src, CAST('0x' || substr(md5('0|' || src || '|' || k), 1, 15) AS BIGINT) % n AS no FROM k) SELECT DISTINCT s.src, n.id AS dst FROM s JOIN n USING (no) WHERE s.src <> n.id AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.src = s.src AND pe.dst = n.id)""")
def negative_edges(spark, d):
    """Hash-drawn pairs that are no edges."""
    return G.negative_edges(_edges(spark, d), _nodes(spark, d), 3)


@query(f"""WITH {_P} SELECT src, dst FROM pe WHERE CAST('0x' || substr(md5('d|' || src || '|' || dst), 1, 8) AS BIGINT) / 4294967296.0 >= 0.4 OR src = dst""")
def dropped_edges(spark, d):
    """DropEdge."""
    return G.dropped_edges(_edges(spark, d), 0.4, "d").select("src", "dst")


_AT = "CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"""WITH {_N} SELECT id, list_transform(x, lambda e: CASE WHEN {_AT.format(seed='dn', key='id')} < 0.3 THEN 0.0 ELSE round(e / 0.7, 6) END) AS x FROM n""")
def dropped_nodes(spark, d):
    """DropNode: whole rows of features become zeros, the others are scaled up."""
    return rounded(G.dropped_nodes(_nodes(spark, d), 0.3, "dn").select("id", "x"))


@query(f"""WITH {_N} SELECT id, list_transform(range(1, 4), lambda k: CASE WHEN {_AT.format(seed='df', key="k - 1")} < 0.4 THEN 0.0 ELSE round(x[k], 6) END) AS x FROM n""")
def dropped_features(spark, d):
    """DropFeature: whole columns of features become zeros."""
    return rounded(G.dropped_features(_nodes(spark, d), WIDTH, 0.4, "df").select("id", "x"))


@query(f"""WITH {_P}, m AS (SELECT src, dst, {_AT.format(seed='me', key="least(src, dst) || '|' || greatest(src, dst)")} < 0.15 AS masked FROM pe) SELECT src, dst, masked FROM m""")
def masked_edges(spark, d):
    """Edges held back as targets, both directions of a pair alike."""
    return G.masked_edges(_edges(spark, d), 0.15, "me").select("src", "dst", "masked")


@query(f"""WITH {_N}, m AS (SELECT id, x, {_AT.format(seed='ma', key='id')} < 0.2 AS masked FROM n) SELECT id, masked, CASE WHEN masked THEN [0.0, 0.0, 0.0] ELSE list_transform(x, lambda e: round(e, 6)) END AS x, CASE WHEN masked THEN list_transform(x, lambda e: round(e, 6)) END AS target FROM m""")
def masked_attributes(spark, d):
    """Attributes of some nodes hidden, kept beside as targets."""
    return rounded(G.masked_attributes(_nodes(spark, d), WIDTH, 0.2, "ma").select("id", "masked", "x", "target"))


@query(f"""WITH {_P}, p AS (SELECT p_partkey AS id, CAST('0x' || substr(md5('cp|' || p_partkey), 1, 15) AS BIGINT) % 5 AS part FROM part) SELECT a.part, src, dst FROM pe JOIN p a ON a.id = src JOIN p b ON b.id = dst AND a.part = b.part""")
def partition_subgraphs(spark, d):
    """A random partition of the nodes and the subgraph that each part induces."""
    return rounded(G.partition_subgraphs(_edges(spark, d), G.random_partition(_nodes(spark, d), 5, "cp")).select("part", "src", "dst"))


@query()
def balanced_partition(spark, d):
    """Eight parts of nearly equal size of the part graph."""
    return P.balanced_partition(_edges(spark, d), _nodes(spark, d), 8)


@query("SELECT CAST(k AS BIGINT) AS part, true AS within, true AS fewer_cut FROM range(8) t(k)")
def partition_balance(spark, d):
    """Sizes of the eight parts within 5 % of equal, and a smaller share of weight cut than parts at random cut."""
    e, n = S.cut(_edges(spark, d)), _nodes(spark, d)
    parts = S.cut(P.balanced_partition(e, n, 8))
    total = F.sum("n").over(Window.partitionBy())  # 8 rows
    within = F.col("n").between(F.floor(0.95 * total / 8), F.ceil(1.05 * total / 8))
    shares = P.cut_share(e, parts).crossJoin(P.cut_share(e, G.random_partition(n, 8, "cp")).withColumnRenamed("share", "other"))  # one row each
    sizes = parts.groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"))
    return sizes.select("part", within.alias("within")).crossJoin(F.broadcast(shares.select((F.col("share") < F.col("other")).alias("fewer_cut"))))


@query(f"""WITH {_P}, {_A}, {_N}, {_L}, s AS (SELECT src AS id, k, sum(w * x) AS g FROM a JOIN nl ON nl.id = dst GROUP BY ALL), h1 AS (SELECT nl.id, nl.k, greatest(0.5 * x + 0.5 * coalesce(g, 0), 0) AS x FROM nl LEFT JOIN s USING (id, k)),
s2 AS (SELECT src AS id, k, sum(w * x) AS g FROM a JOIN h1 ON h1.id = dst GROUP BY ALL) SELECT h1.id, list(round(greatest(0.5 * x + 0.5 * coalesce(g, 0), 0), 6) ORDER BY k) AS x FROM h1 LEFT JOIN s2 USING (id, k) GROUP BY 1""")
def layerwise_inference(spark, d):
    """One layer at a time for all nodes over all neighbours, not per mini-batch."""
    return rounded(G.layerwise(S.cut(G.normalised(_edges(spark, d), "row")), _nodes(spark, d).select("id", "x"), WIDTH, 2))


@query(f"""WITH {_B}, {_N}, {_L}, k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 5), s AS (SELECT src AS id, nl.k AS j, sum(w * x) / sum(w) AS x FROM k JOIN nl ON nl.id = k.dst - 1000000000 GROUP BY ALL)
SELECT id, list(round(x, 6) ORDER BY j) AS x FROM s GROUP BY 1""")
def weighted_readout(spark, d):
    """Features of the heaviest entries of each row, weighted by them."""
    top = G.top_edges(_bipartite(spark, d), 5).withColumn("dst", F.col("dst") - 1000000000)
    return rounded(G.spmm(top, _nodes(spark, d), WIDTH))


@query(f"""WITH {_P}, e AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS place FROM pe), c AS (SELECT dst, src, row_number() OVER (ORDER BY dst, src) - 1 AS place FROM pe)
SELECT 'csr' AS layout, CAST(src AS BIGINT) AS line, CAST(min(place) AS BIGINT) AS pointer, list(CAST(dst AS BIGINT) ORDER BY dst) AS indices FROM e GROUP BY 2 UNION ALL
SELECT 'csc', dst, CAST(min(place) AS BIGINT), list(CAST(src AS BIGINT) ORDER BY src) FROM c GROUP BY 2""")
def compressed_layouts(spark, d):
    """Coordinates to compressed rows and columns: a pointer and the sorted indices of each line."""
    e = S.cut(_edges(spark, d).select("src", "dst"))
    by = lambda name, df: df.select(F.lit(name).alias("layout"), "line", "pointer", "indices")
    return by("csr", G.compressed(e, "src", "dst")).unionByName(by("csc", G.compressed(e, "dst", "src")))


@query(f"""WITH {_B}, k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 5) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM k""")
def heaviest_edges(spark, d):
    """K04."""
    return rounded(G.top_edges(_bipartite(spark, d), 5))


@query(f"""WITH {_B} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY dst), 6) AS w FROM b WHERE w >= 60""")
def sparsified_edges(spark, d):
    """K05."""
    return rounded(G.sparsified(_bipartite(spark, d), 60))


@query("""SELECT p_partkey AS id, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= greatest(2, floor(0.3 * count(*) OVER (PARTITION BY p_brand)))""")
def top_node_pool(spark, d):
    """K06."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    return G.top_nodes(p, "p_brand", "p_size", 0.3).select("id", "p_brand")


@query(f"""WITH {_N}, k AS (SELECT id % 9 AS g, id, x, row_number() OVER (PARTITION BY id % 9 ORDER BY x[3] DESC, id) AS k FROM n), f AS (SELECT g, flatten(list(x ORDER BY k)) AS x FROM k WHERE k <= 4 GROUP BY 1)
SELECT g, list_transform(list_concat(x, list_transform(range(12 - len(x)), lambda i: 0.0)), lambda v: round(v, 6)) AS x FROM f""")
def sort_pool(spark, d):
    """K07."""
    return rounded(G.sort_pooled(_nodes(spark, d).withColumn("g", F.col("id") % 9), "g", 4, WIDTH))


@query("""WITH c AS (SELECT p_brand AS g, p_size AS l, count(*) AS n FROM part GROUP BY ALL) SELECT a.g AS a, b.g AS b, CAST(sum(a.n * b.n) AS BIGINT) AS k FROM c a JOIN c b ON a.l = b.l AND a.g <= b.g GROUP BY ALL""")
def bag_kernel(spark, d):
    """Products of label counts of graphs that share labels."""
    return G.bag_kernel(table(spark, d, "part").select(F.col("p_brand").alias("graph_id"), F.col("p_size").alias("label")))


@query("""WITH n AS (SELECT c_nationkey AS graph_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS id FROM customer), s AS (SELECT graph_id, max(id) + 1 AS m FROM n GROUP BY 1),
b AS (SELECT graph_id, coalesce(sum(m) OVER (ORDER BY graph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM s) SELECT CAST(graph_id AS BIGINT) AS graph_id, CAST(id AS BIGINT) AS id, CAST(id + f AS BIGINT) AS global_id FROM n JOIN b USING (graph_id)""")
def disjoint_union(spark, d):
    """G27."""
    from pyspark.sql import Window

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("graph_id"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("id"))
    return rounded(G.disjoint_union(c))


@query("""WITH e AS (SELECT l_linenumber AS graph_id, l_orderkey AS src, l_partkey + 100000000 AS dst FROM lineitem) SELECT CAST(graph_id AS BIGINT) AS graph_id, src - min(least(src, dst)) OVER (PARTITION BY graph_id) AS src, dst - min(least(src, dst)) OVER (PARTITION BY graph_id) AS dst FROM e""")
def local_node_ids(spark, d):
    """S15."""
    e = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("graph_id"), F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 100000000).alias("dst"))
    return rounded(S.local_ids(e))


@query("""WITH e AS (SELECT l_suppkey AS x, l_partkey AS y, CAST(l_quantity AS BIGINT) % 4 AS t FROM lineitem) SELECT x AS src, y AS dst, CAST(sum(t) AS BIGINT) AS n FROM e WHERE t > 0 GROUP BY ALL UNION ALL SELECT y, x, CAST(sum(t) AS BIGINT) FROM e WHERE t > 0 GROUP BY ALL""")
def repeated_edges(spark, d):
    """An edge as often as its weight says, both ways."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y"), (F.col("l_quantity").cast("int") % 4).alias("times"))
    marked = S.repeated_edges(e.withColumn("y", F.col("y") + 1000000000))
    n = marked.groupBy("src", "dst").agg(F.count("*").alias("n"))
    low = lambda c: F.when(F.col(c) >= 1000000000, F.col(c) - 1000000000).otherwise(F.col(c))
    return n.select(low("src").alias("src"), low("dst").alias("dst"), "n")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst, l_returnflag AS rel FROM lineitem), m AS (SELECT src AS id, CASE rel WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS o, 0 AS t FROM e UNION ALL SELECT dst, CASE rel WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, CASE rel WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END FROM e)
SELECT id, CAST(max_by(t, o) AS BIGINT) AS node_type FROM (SELECT id, o, max(t) AS t FROM m GROUP BY ALL) GROUP BY 1""")
def heterogeneous_types(spark, d):
    """Node types by the ends taken in relations, later relations first."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"), F.col("l_returnflag").alias("rel"))
    e = S.dealt(rows, _tasks(spark, d), "src", "dst", "rel").distinct()
    return rounded(S.node_types(e, {"A": (0, 1), "N": (0, 2), "R": (0, 3)}))


@query("""SELECT count(DISTINCT l_suppkey) AS nodes, count(*) AS edges, count(DISTINCT l_returnflag) AS classes, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS labelled FROM lineitem""")
def graph_statistics(spark, d):
    """A29, X01."""
    return table(spark, d, "lineitem").agg(F.countDistinct("l_suppkey").alias("nodes"), F.count("*").alias("edges"), F.countDistinct("l_returnflag").alias("classes"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("labelled"))


@query(f"""WITH e AS (SELECT l_orderkey AS src, list_value(l_quantity, l_discount) AS f FROM lineitem), s AS (SELECT src, sum(f[1]) AS a, sum(f[2]) AS b, count(*) AS n FROM e GROUP BY 1)
SELECT o_orderkey AS id, round(coalesce(a, 0) / greatest(coalesce(n, 0), 1), 6) AS a, round(coalesce(b, 0) / greatest(coalesce(n, 0), 1), 6) AS b FROM orders LEFT JOIN s ON src = o_orderkey""")
def edge_to_node_features(spark, d):
    """Mean edge features by row, 0 without edges."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"))
    return rounded(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(s, "id", "left").select("id", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")))


@query(f"""WITH {_N}, {_L}, c AS (SELECT id % 4 AS cls, k, sum(x) AS x FROM nl GROUP BY ALL), u AS (SELECT id % 6 AS clu, k, sum(x) AS x FROM nl GROUP BY ALL), d AS (SELECT clu, cls, sqrt(sum((c.x - u.x) ** 2)) AS d FROM c JOIN u USING (k) GROUP BY ALL)
SELECT clu, min_by(cls, d) AS cls FROM d GROUP BY 1""")
def cluster_alignment(spark, d):
    """Clusters to the class whose summed features are nearest."""
    n = _nodes(spark, d)
    c = G.vector_sum(n.withColumn("cls", F.col("id") % 4), ["cls"], F.col("x"), WIDTH)
    u = G.vector_sum(n.withColumn("clu", F.col("id") % 6), ["clu"], F.col("x"), WIDTH).withColumnRenamed("x", "y")
    return R.beside(u, c, "clu", "cls").groupBy("clu").agg(F.min_by("cls", V.euclidean(F.col("x"), F.col("y"))).alias("cls"))


@query(f"""WITH {_P}, {_N}, {_L}, s AS (SELECT src AS id, k, sum(w * x) AS g FROM pe JOIN nl ON nl.id = pe.dst GROUP BY ALL)
SELECT nl.id, list(round(1.1 * x + coalesce(g, 0), 6) ORDER BY nl.k) AS x FROM nl LEFT JOIN s ON s.id = nl.id AND s.k = nl.k GROUP BY 1""")
def isomorphism_layer(spark, d):
    """(1 + eps) x + A x."""
    n = _nodes(spark, d)
    g = G.spmm(_edges(spark, d), n, WIDTH).withColumnRenamed("x", "g")
    zeros = F.array(*[F.lit(0.0)] * WIDTH)
    return rounded(n.join(g, "id", "left").select("id", V.plus(V.scaled(F.col("x"), F.lit(1.1)), F.coalesce("g", zeros)).alias("x")))


@query(f"""WITH c AS (SELECT label, vec_id, list_max(embedding) AS conf, vec_id % 3 AS clu FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY conf DESC, vec_id) AS k FROM c WHERE clu = label % 3)
SELECT vec_id, CAST(label AS BIGINT) AS label FROM r WHERE k <= 5""")
def self_training_expansion(spark, d):
    """The most confident rows of each class whose cluster agrees."""
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").select("label", "vec_id", F.array_max("embedding").alias("conf")).filter("vec_id % 3 = label % 3")
    k = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("conf"), "vec_id"))
    return rounded(e.withColumn("k", k).filter("k <= 5").select("vec_id", "label"))
