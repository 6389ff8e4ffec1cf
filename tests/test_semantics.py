"""Hand-computed cases of the odd rules, round trips of sources and properties of random operators."""

import re
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions import vectors as V
from quillon.operators import evaluate as E
from quillon.operators import features as M
from quillon.operators import graph as G
from quillon.operators import tables as O
from quillon.plans import registry
from quillon.sources import tables as S
from quillon.streaming import windows as W


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# ------------------------------------------------------------- columns


def test_cleaning(spark):
    assert one(spark, X.clean_text(F.lit("The (Quick), brown-fox \t is\n BASE jumping!"))) == "quick brownfox jumping"
    assert one(spark, X.clean_text(F.lit(None).cast("string"))) == "" == one(spark, X.clean_text(F.lit(" . ! ")))


def test_names(spark):
    others = F.array(F.lit("Smith John"), F.lit("A B C"))
    assert one(spark, X.name_matches(F.lit(" john smith "), others)) == 1
    assert one(spark, X.name_matches(F.lit("b a c"), others)) == 0
    assert one(spark, X.matching_pairs(F.lit("aab"), F.lit("aba"))) == 5
    assert one(spark, X.common_characters(F.lit("aab"), F.lit("abb"))) == 2
    assert one(spark, X.set_distance(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0


def test_distances_of_a_vector_with_itself(spark):
    v = F.array(*(F.lit(x) for x in (0.5, 1.5, 2.0)))
    for name, f in V.DISTANCES.items():
        assert abs(one(spark, f(v, v))) < 1e-7, name


def test_rotation_and_bessel():
    assert abs(G.bessel(0, 0.5) - 1.0634833707413236) < 1e-12 and abs(G.bessel(1, 0.5) - 0.25789430539089633) < 1e-12


# ------------------------------------------------------------- tables


def test_budget_boundary(spark):
    rows = [("a", 1, 4), ("a", 2, 6), ("b", 1, 4), ("b", 2, 6), ("b", 3, 1)]
    df = spark.createDataFrame(rows, "g string, pos int, n int")
    got = {tuple(r)[:2] for r in O.within_budget(df, ["g"], ["pos"], "n", 10).collect()}
    assert got == {("a", 1), ("a", 2), ("b", 1)}  # a total equal to the budget stays; a running sum equal to it goes


def test_fusion_rules(spark):
    rows = [("m1", "a", "x", 1.0), ("m1", "a", "y", 3.0), ("m2", "a", "z", 5.0), ("m3", "a", "w", 5.0), ("m3", "a", "x", 0.0), ("m3", "a", "y", 2.0), ("m2", "b", "x", 1.0), ("m1", "c", "x", 7.0)]
    df = spark.createDataFrame(rows, "model string, author_id string, id string, score double")
    got = {(r["author_id"], r["id"]): r["score"] for r in O.fuse(df, {"m1": 0.5, "m2": 0.3, "m3": 0.2}, ["m1", "m2"]).collect()}
    # w is in m3 alone, b is not in m1; constant groups count 0
    assert set(got) == {("a", "x"), ("a", "y"), ("a", "z"), ("c", "x")}
    assert abs(got["a", "y"] - (0.5 + 0.2 * 0.4)) < 1e-12 and got["a", "x"] == 0 and got["a", "z"] == 0 and got["c", "x"] == 0


def test_null_keys_form_no_group(spark):
    df = spark.createDataFrame([(None, 1.0), ("k", 2.0), ("k", 4.0), ("s", 1.0)], "k string, v double")
    stats = {r["k"]: r for r in O.group_stats(df, "k", numeric=["v"]).collect()}
    assert set(stats) == {"k", "s"} and stats["s"]["v_std"] is None and abs(stats["k"]["v_std"] - math.sqrt(2)) < 1e-12
    assert [r["k_v_mean"] for r in O.transformed(df, ["k"], ["v"], ["mean"]).filter("k is null").collect()] == [None]
    assert O.with_group_stats(df, "k", numeric=["v"]).filter("k is null").first()["k_n_rows"] is None


def test_top_values_take_the_first_of_a_tie(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4), ("g", "c", 5)], "g string, v string, pos int")
    assert O.top_lists(df, "g", "v", "pos", 2).first()["top"] == ["b", "a"]


def test_history_has_one_window_fewer(spark):
    df = spark.createDataFrame([("s", k, float(k)) for k in range(10)], "s string, t int, v double")
    got = sorted(tuple(r) for r in O.history_windows(df, ["s"], "t", "v", 3, 2).collect())
    assert [g[1] for g in got] == [0, 1, 2, 3, 4] and got[0][2] == [0.0, 1.0, 2.0] and got[0][3] == 4.0


def test_splits_and_folds(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    shares = {r["split"]: r["count"] / 2000 for r in O.hash_split(df, ["k"], {"a": 0.7, "b": 0.2, "c": 0.1}).groupBy("split").count().collect()}
    assert abs(shares["a"] - 0.7) < 0.05 and abs(shares["c"] - 0.1) < 0.03 and abs(sum(shares.values()) - 1) < 1e-9
    rows = spark.range(3000).select((F.col("id") % 300).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    folds = O.group_folds(rows, "g", "y", 5)
    assert folds.count() == 300 and folds.select("g").distinct().count() == 300
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 6


def test_dense_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = {r["x"]: r["n"] for r in O.dense_positions(df, [F.desc("x")], "n").collect()}
    assert got == {x: 999 - x for x in range(1000)}


def test_downcast_keeps_values(spark):
    df = spark.createDataFrame([(1, 300, 10**12), (-128, 5, 2)], "a long, b long, c long")
    assert [t for _, t in O.downcast(df, ["a", "b", "c"]).dtypes] == ["tinyint", "smallint", "bigint"]


def test_score_maps(spark):
    df = spark.createDataFrame([("a", "2", 0.5, 1), ("a", "1", 0.1, 1), ("a", "1", 0.3, 2)], "author_id string, id string, score double, at int")
    assert json.loads(O.score_maps(df, order="at").first()["scores"]) == {"1": 0.3, "2": 0.5}


# ------------------------------------------------------------- graphs


@pytest.fixture(scope="module")
def ring(spark):
    """A ring of eight with chords, a loop, a dead end and an isolated node."""
    e = [(k, (k + 1) % 8, 1.0) for k in range(8)] + [(0, 4, 2.0), (3, 3, 1.0), (2, 8, 1.0)]
    return S.cut(spark.createDataFrame(e, "src long, dst long, w double")), S.cut(spark.createDataFrame([(k, [float(k), 1.0], k / 10) for k in range(10)], "id long, x array<double>, v double"))


def dense(edges, n=10):
    a = np.zeros((n, n))
    for r in edges.collect():
        a[r["src"], r["dst"]] += r["w"]
    return a


def test_products_are_unpacked_in_counted_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = {(0, k) for k in range(40)} | {(k, 0) for k in range(40)} | {tuple(p) for p in rng.integers(0, 40, (200, 2)).tolist()}  # 0 is a hub
    edges = spark.createDataFrame([(a, b, float(1 + (a + b) % 3)) for a, b in sorted(pairs)], "src long, dst long, w double")
    m = np.zeros((40, 40))
    for a, b in pairs:
        m[a, b] = 1 + (a + b) % 3
    full = lambda df: {(r["src"], r["dst"]): r["w"] for r in df.collect()}
    wanted = lambda x: {(a, b): x[a, b] for a, b in zip(*(k.tolist() for k in np.nonzero(x)))}
    for packed, rows in ((1_024, 1 << 20), (7, 50)):
        monkeypatch.setattr(G, "PACKED", packed)
        monkeypatch.setattr(S, "TASK_ROWS", rows)
        made = G.product(edges, edges)
        assert full(made) == wanted(m @ m)
        products = int(((m > 0).astype(int) @ (m > 0).astype(int)).sum())
        assert made._jdf.queryExecution().toString().count("hashpartitioning(src") >= 1
        assert made.rdd.getNumPartitions() >= products / rows
        got = full(G.katz(edges, 0.1, 3))
        assert got.keys() == wanted(m + m @ m + m @ m @ m).keys() and all(np.isclose(v, (0.1 * m + 0.01 * m @ m + 0.001 * m @ m @ m)[k]) for k, v in got.items())
    assert G.product(edges.limit(0), edges).count() == 0


def test_products_and_norms(spark, ring):
    edges, nodes = ring
    a, x = dense(edges), np.array([[k, 1.0] for k in range(10)])
    got = {r["id"]: r["x"] for r in G.spmm(edges, nodes, 2).collect()}
    assert all(np.allclose(got.get(k, [0, 0]), (a @ x)[k]) for k in range(10))
    assert np.allclose(dense(G.product(edges, edges)), a @ a)
    row = dense(G.normalised(edges.withColumn("w", F.lit(1.0)), "row")).sum(1)
    assert np.allclose(row[:8], 1)
    soft = G.edge_softmax(edges).groupBy("src").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-12 for r in soft)


def test_pagerank_bound(spark, ring):
    edges, nodes = ring
    eps, alpha = 1e-4, 0.3
    got = {(r["seed"], r["id"]): r["p"] for r in G.personalised_pagerank(edges, nodes.filter("id < 2"), alpha, eps).collect()}
    a = (dense(G.mirrored(edges).withColumn("w", F.lit(1.0))) > 0).astype(float)
    deg = a.sum(1)
    p = a / np.maximum(deg, 1)[:, None]
    for s in (0, 1):
        exact = alpha * np.linalg.inv(np.eye(10) - (1 - alpha) * p.T)[:, s]
        for k in range(9):
            assert -1e-9 <= exact[k] - got.get((s, k), 0) <= eps * max(deg[k], 1) * 20
        assert sum(v for (q, _), v in got.items() if q == s) <= 1 + 1e-9


def test_walks_follow_edges(spark, ring):
    edges, nodes = ring
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}
    for options in ({}, {"restart": 0.4}, {"p": 0.5, "q": 2.0}):
        rows = G.random_walks(edges, nodes.filter("id < 8"), 5, 2, **options).collect()
        walks = {}
        for r in rows:
            walks.setdefault(r["walk"], {})[r["place"]] = r["node"]
        assert len(walks) == 16
        for name, w in walks.items():
            start = int(name.split(":")[0])
            assert w[0] == start
            for k in range(1, len(w)):
                step = (w[k - 1], w[k])
                assert step in pairs or options.get("restart") and (w[k] == start or w[k] == w[k - 1])
    again = G.random_walks(edges, nodes.filter("id < 8"), 5, 2).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, G.random_walks(edges, nodes.filter("id < 8"), 5, 2).collect()))


def test_samples_and_negatives(spark, ring):
    edges, nodes = ring
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}
    got = G.sampled_neighbours(edges.select("src", "dst"), nodes, 1).collect()
    assert {tuple(r) for r in got} <= pairs and len(got) == 8
    assert not {tuple(r) for r in G.negative_edges(edges, nodes, 3).collect()} & pairs


def test_wl_is_blind_to_names(spark, ring):
    edges, nodes = ring
    flip = lambda c: (F.lit(9) - F.col(c)).alias(c)
    degree = G.degrees(edges, nodes).withColumnRenamed("degree", "label")
    moved = G.wl_labels(edges.select(flip("src"), flip("dst")), degree.select(flip("id"), "label"), 2)
    own = sorted((r["round"], r["label"]) for r in G.wl_labels(edges, degree, 2).collect())
    assert own == sorted((r["round"], r["label"]) for r in moved.collect())


def test_bfs(spark, ring):
    edges, nodes = ring
    got = {r["id"]: r["hops"] for r in G.breadth_first(edges, nodes.filter("id = 0"), 3).collect()}
    assert got == {0: 0, 1: 1, 4: 1, 2: 2, 5: 2, 3: 3, 8: 3, 6: 3}


def test_betweenness(spark):
    """Against all shortest paths of a small graph, two parts and a node alone in it."""
    rng = np.random.default_rng(4)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 14, (22, 2)).tolist() if p[0] != p[1]} | {(20, 21), (21, 22)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def paths(s):
        found, ends = {s: [[s]]}, [s]
        while ends:
            new = {}
            for v in ends:
                for w in near.get(v, ()):
                    if w not in found:
                        new.setdefault(w, []).extend([*p, w] for p in found[v])
            found |= new
            ends = list(new)
        return found

    nodes = sorted(near)
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t, ps in paths(s).items():
            for p in ps:
                for v in p[1:-1]:
                    want[v] += 1 / len(ps)
    edges = spark.createDataFrame([(a, b) for a, b in pairs] + [(5, 5)], "src long, dst long")
    got = {r["id"]: r["score"] for r in G.betweenness(edges, spark.createDataFrame([(n,) for n in nodes], "id long")).collect()}
    assert set(got) == set(nodes) and all(abs(got[n] - want[n]) < 1e-9 for n in nodes)


# ------------------------------------------------------------- models and evaluation


def test_auc_of_ties(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert E.roc_auc(df, "s", "y").first()["auc"] == 0.875
    assert E.roc_auc(df.filter("y = 1"), "s", "y").first()["auc"] is None
    with pytest.raises(KeyError):
        E.evaluator("nothing")


def test_svd_finds_the_subspace(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 40)) + 0.01 * rng.normal(size=(60, 40))
    rows = [(i, f"t{j}", float(m[i, j])) for i in range(60) for j in range(40)]
    got = M.truncated_svd(spark.createDataFrame(rows, "k long, term string, weight double"), "k", 3).toPandas().sort_values("k")
    x = np.stack(got["x"].to_numpy())
    s = np.linalg.svd(m)[1][:3]
    assert np.allclose(np.sort(np.linalg.norm(x, axis=0))[::-1], s, rtol=1e-6)


def test_registry_is_complete():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 150


# ------------------------------------------------------------- sources, sinks, streams


def test_dictionaries(spark, tmp_path):
    papers = {"p1": {"id": "p1", "title": "T", "abstract": None, "keywords": ["a"], "authors": [{"name": "N", "org": ""}], "venue": None, "year": 2001}, "p2": {"id": "p2", "title": "!", "authors": []}}
    (tmp_path / "papers.json").write_text(json.dumps(papers))
    got = {r["id"]: r for r in S.read_papers(spark, str(tmp_path / "papers.json")).collect()}
    assert got["p1"]["authors"][0]["name"] == "N" and got["p2"]["year"] is None and got["p2"]["keywords"] is None
    authors = {"a": {"name": "A", "normal_data": ["p1", "p2"], "outliers": ["p3"]}, "b": {"name": "B", "papers": ["p1"]}, "c": {"name": "C", "normal_data": [], "outliers": []}}
    (tmp_path / "authors.json").write_text(json.dumps(authors))
    rows = sorted(tuple(r) for r in S.read_authors(spark, str(tmp_path / "authors.json")).collect())
    assert rows == [("a", "A", "p1", 0, 1), ("a", "A", "p2", 1, 1), ("a", "A", "p3", 2, 0), ("b", "B", "p1", 0, -1)]


def test_line_files(spark, tmp_path):
    (tmp_path / "kg").write_text("3\n1 2 9\n4 5 8\n")
    assert sorted(tuple(r) for r in S.read_triples(spark, str(tmp_path / "kg"), "train").collect()) == [(1, 9, 2, "train"), (4, 8, 5, "train")]
    (tmp_path / "mx").write_text("a 1 2\nb 3 4 0\n")
    assert sorted(tuple(r) for r in S.read_multiplex(spark, str(tmp_path / "mx"), "s").collect()) == [("a", 1, 2, 1, "s"), ("b", 3, 4, 0, "s")]
    (tmp_path / "rec").write_text("1 5 6 5\n2\n\n")
    assert sorted(tuple(r) for r in S.read_interactions(spark, str(tmp_path / "rec")).collect()) == [(1, 5, "train"), (1, 6, "train")]
    (tmp_path / "A").write_text("1, 2\n2, 1\n3, 3\n3, 4\n")
    (tmp_path / "I").write_text("1\n1\n2\n2\n")
    (tmp_path / "L").write_text("7\n-1\n")
    nodes, edges = S.read_collection(spark, str(tmp_path / "A"), str(tmp_path / "I"), str(tmp_path / "L"))
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 0, 1), (1, 1, 0), (2, 0, 1)]
    assert sorted(tuple(r) for r in nodes.select("graph_id", "id", "graph_label").collect()) == [(1, 0, 7), (1, 1, 7), (2, 0, -1), (2, 1, -1)]
    (tmp_path / "edges.tsv").write_text("# c\n1\t2\n2\t3\n")
    assert S.read_edge_list(spark, str(tmp_path / "edges.tsv")).count() == 2


def test_readings_keep_week_days(spark, tmp_path):
    for day in ("2024_01_05", "2024_01_06"):
        (tmp_path / f"d07_{day}.csv").write_text("01/05/2024 00:00:00,1,60.5\n01/05/2024 00:05:00,1,\n")
    got = S.read_readings(spark, str(tmp_path), "timestamp timestamp, station int, avg_speed double").collect()
    assert len(got) == 1 and str(got[0]["day"]) == "2024-01-05"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\nc"), (1, " "), (3, "d")], "k int, t string")
    S.write_corpus(df, "t", str(tmp_path / "corpus"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "corpus")).collect()) == ["b c", "d"]
    S.write_sample(df, ["k"], 2, str(tmp_path / "sample"))
    assert spark.read.csv(str(tmp_path / "sample"), header=True, multiLine=True).count() == 2
    S.write_family(df, str(tmp_path / "family"), "k")
    assert spark.read.parquet(str(tmp_path / "family")).count() == 3
    for step in (1, 2):
        S.append_metrics(spark, str(tmp_path / "metrics"), step, {"auc": 0.5})
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = W.tumbling(W.stream_of(spark, str(tmp_path / "in"), events), ["event_type"], "value", late="60 days")
    q = stream.writeStream.format("memory").queryName("windows_of_events").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r["window_start"], r["event_type"], r["n"], round(r["total"], 6))
    assert sorted(map(key, spark.table("windows_of_events").collect())) == sorted(map(key, W.tumbling(events, ["event_type"], "value", late="60 days").collect()))


def test_facade(spark, ring):
    from quillon.plans import facade as A

    edges, nodes = ring
    row = A.pipeline("dataset-stats")(edges, nodes.withColumn("y", F.when(F.col("id") < 4, F.col("id") % 2).otherwise(-1))).first()
    assert (row["nodes"], row["edges"], row["features"], row["classes"], row["labelled"]) == (10, 11, 2, 2, 4)
    assert A.pipeline("dataset-visual")(edges, 0, 1).count() == 2
    assert A.pipeline("generate-emb")(edges, 2, "pmi").count() > 0
    users = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12)], "user long, item long")
    assert {(r["user"], r["item"]) for r in A.pipeline("recommendation")(users).collect()} == {(1, 12), (2, 11)}
    assert A.best(A.experiment(lambda a, b: a * b, a=[1, 3], b=[2, 5])) == {"a": 3, "b": 5, "metric": 15}
    with pytest.raises(KeyError):
        A.pipeline("other")


# ------------------------------------------------------------- queries on odd vectors


def vectors_folder(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, 0, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, label int, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_undefined_distances_reads_the_first_sixteen(spark, tmp_path):
    late, early = [0.5] * 20 + [-0.5] + [0.5] * 43, [0.5] * 15 + [-0.5] + [0.5] * 48
    got = registry.queries()["undefined_distances"](spark, vectors_folder(spark, tmp_path, [late, early])).collect()
    assert [(r["vec_id"], r["js"], r["zero"]) for r in got] == [(1, None, None)]


def test_shrunk_features_keep_the_sign_of_zero(spark, tmp_path):
    v = [-1e-7, 1e-7, 0.0, -0.25] + [0.0] * 60
    x = registry.queries()["shrunk_features"](spark, vectors_folder(spark, tmp_path, [v])).first()["x"]
    assert [math.copysign(1, y) for y in x[:3]] == [-1, 1, 1] and x[:3] == [0, 0, 0] and x[3] == -0.124756


@pytest.mark.parametrize("name", ["mirrored_edges", "undirected_edges", "neighbour_sample", "heterogeneous_types"])
def test_tasks_grow_with_the_counted_rows(spark, sf, monkeypatch, name):
    from quillon.plans import registry
    from quillon.sources import tables

    run = registry.queries()[name]
    want = sorted(map(tuple, run(spark, sf).collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 500, raising=False)  # some 6 000 lines: 12 tasks or more, where shuffles have 8
    made = run(spark, sf)
    assert sorted(map(tuple, made.collect())) == want
    counts = [int(n) for n in re.findall(r"hashpartitioning\([^)]*?, (\d+)\)", made._jdf.queryExecution().executedPlan().toString())]
    assert max(counts) >= 12


def test_node_types_take_no_sort(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 3, "a"), (4, 4, "b"), (None, 1, "a")], "src long, dst long, rel string")
    made = S.node_types(edges, {"a": (-2, 5), "b": (7, 0)})
    assert {r["id"]: r["node_type"] for r in made.collect()} == {1: 5, 2: 7, 3: 0, 4: 7, None: -2}
    assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()
