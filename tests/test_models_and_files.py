"""Fitted models by figures on data whose answer is known; files by what comes back."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import features as M
from quillon.operators import graph as G
from quillon.operators import ranking as R
from quillon.operators import similar as N
from quillon.operators import spectra, textmodels, trees
from quillon.operators import tables as O
from quillon.plans import registry
from quillon.sources import dictionaries as D
from quillon.sources import tables as S

QUERIES = registry.queries()


def blobs(spark, k=3, each=30, width=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, width)) * 6
    rows = [(c * each + i, [float(x) for x in centres[c] + rng.normal(size=width)], c) for c in range(k) for i in range(each)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int")


# ---------------------------------------------------------------- models


def test_clusters_find_blobs(spark):
    df = blobs(spark)
    found = df.join(M.clusters(df, "id", "v", 3), "id")
    mapped = M.mapped_clusters(found, "cluster", "label")
    assert mapped.filter("mapped = label").count() == df.count()
    assert abs(M.mutual_information(found, "cluster", "label").first()["nmi"] - 1) < 1e-9


@pytest.mark.parametrize("seed", range(6))
def test_best_mapping(seed):
    gain = np.random.default_rng(seed).integers(0, 30, (5, 5)).astype(float)
    best = max(sum(gain[k, p[k]] for k in range(5)) for p in itertools.permutations(range(5)))
    to = M.best_mapping(gain)
    assert sorted(to) == list(range(5)) and gain[range(5), to].sum() == best


def test_spectral_clusters_part_cliques(spark):
    edges = [(a + 10 * c, b + 10 * c) for c in range(3) for a in range(10) for b in range(a)] + [(0, 10), (10, 20)]
    got = {r["id"]: r["cluster"] for r in M.spectral_clusters(spark.createDataFrame(edges, "src long, dst long"), 3).collect()}
    assert len(got) == 30 and all(len({got[i] for i in range(c, c + 10)}) == 1 for c in (0, 10, 20)) and len(set(got.values())) == 3


def test_svm_grid_and_top_labels(spark):
    df = blobs(spark, 2).withColumn("y", F.col("label"))
    grid = M.svm_grid(df, "v", "y", [1.0, 10.0], 3, key="id").collect()
    assert len(grid) == 6 and all(r["accuracy"] > 0.95 for r in grid)
    df = blobs(spark, 3).withColumn("labels", F.when(F.col("label") == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array("label")).cast("array<int>"))
    got = M.top_labels(df, "id", "v", "labels", F.col("id") % 3 != 0, 3).collect()
    assert len(got) == 30 and all(len(r["predicted"]) == len(r["truth"]) for r in got)
    assert np.mean([set(r["predicted"]) == set(r["truth"]) for r in got]) > 0.9


def test_boosted_folds_stop_early(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, float(x), float(rng.normal()), int(x + 0.3 * rng.normal() > 0)) for i, x in enumerate(rng.normal(size=300))]
    probs, weights = M.boosted_folds(spark.createDataFrame(rows, "id int, fold int, a double, b double, y int"), ["a", "b"], "y", "fold", "id", trees.How(rounds=40, leaves=8, depth=3, least_rows=5, patience=5))
    p = {r["id"]: r["prob"] for r in probs.collect()}
    y = {r[0]: r[4] for r in rows}
    assert len(p) == 300 and np.mean([(p[i] > 0.5) == y[i] for i in p]) > 0.8
    weights = weights.collect()
    assert all(abs(sum(r["importance"] for r in weights if r["fold"] == k) - 1) < 1e-9 for k in range(3))
    assert all(r["trees"] < 40 for r in weights) and all(r["importance"] > 0.5 for r in weights if r["feature"] == "a")


def test_principal_components(spark):
    df = blobs(spark)
    got = {r["id"]: r["x"] for r in M.principal_components(df, "id", "v", 2).collect()}
    x = np.array([r["v"] for r in df.orderBy("id").collect()])
    want = np.linalg.svd(x - x.mean(0))[2][:2] @ x.T
    for k in range(2):
        own = np.array([got[i][k] for i in range(len(x))])
        assert min(np.abs(own - want[k]).max(), np.abs(own + want[k]).max()) < 1e-6


def test_word_vectors_bring_neighbours_together(spark):
    rng = random.Random(4)
    a, b = [f"a{k}" for k in range(5)], [f"b{k}" for k in range(5)]
    lines = [([rng.choice(words) for _ in range(12)],) for words in (a, b) for _ in range(300)]
    v = {r["word"]: np.array(r["x"]) for r in M.word2vec(spark.createDataFrame(lines, "t array<string>"), "t", 8, 4, 1, iterations=5).collect()}
    cos = lambda x, y: v[x] @ v[y] / np.linalg.norm(v[x]) / np.linalg.norm(v[y])
    near = np.mean([cos(x, y) for w in (a, b) for x, y in itertools.combinations(w, 2)])
    assert set(v) == {*a, *b} and near > np.mean([cos(x, y) for x in a for y in b]) + 0.3


def test_group_embeddings(spark):
    df = spark.createDataFrame([("g", 2, "beta beta"), ("g", 1, "alpha beta"), ("h", 1, "gamma"), (None, 1, "x"), ("i", 1, "")], "k string, n int, t string")
    docs = M.group_documents(df, "k", "n", "t")
    assert {r["k"]: r["t"] for r in docs.collect()} == {"g": "alpha beta beta beta", "h": "gamma", "i": ""}
    counts = {r["k"]: r["x"] for r in M.group_embeddings(docs, "k", "t", 2, "counts").collect()}
    assert counts == {"g": [3.0, 1.0], "h": [0.0, 0.0], "i": [0.0, 0.0]}
    tfidf = {r["k"]: r["x"] for r in M.group_embeddings(docs, "k", "t", 3, "tfidf").collect()}
    assert abs(np.linalg.norm(tfidf["g"]) - 1) < 1e-9 and tfidf["h"] == [0.0, 0.0, 1.0]
    svd = {r["k"]: r["x"] for r in M.group_embeddings(docs, "k", "t", 2, "svd").collect()}
    assert abs(np.dot(svd["g"], svd["h"])) < 1e-6 and abs(np.linalg.norm(svd["g"]) - 1) < 1e-6


def test_saved_models(spark, tmp_path):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=2, inputCol="f", outputCol="o").fit(blobs(spark).select(array_to_vector("v").alias("f")))
    M.save_model(model, str(tmp_path / "m"))
    assert M.load_model(str(tmp_path / "m")).pc == model.pc


def test_chebyshev_filter(spark):
    rng = np.random.default_rng(7)
    a = (rng.random((9, 9)) < 0.4).astype(float)
    a[:, 0] = 1
    a /= a.sum(1, keepdims=True)
    v = rng.normal(size=9)
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(9) for j in range(9) if a[i, j]], "src long, dst long, w double")
    got = {r["id"]: r["v"] for r in G.chebyshev_gaussian(edges, spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double"), 5, 0.4, 0.7).collect()}
    m = 0.6 * np.eye(9) - a
    t = [v, 0.5 * m @ m @ v - v]
    for _ in range(3):
        t.append(m @ m @ t[-1] - 2 * t[-1] - t[-2])
    want = G.bessel(0, 0.7) * t[0] + sum(2 * G.bessel(k, 0.7) * (-1) ** k * t[k] for k in range(1, 5))
    assert np.abs(np.array([got[i] for i in range(9)]) - want).max() < 1e-9


def test_model_queries(spark, sf):
    grid = QUERIES["svm_grid"](spark, sf).collect()
    assert len(grid) == 6 and all(0 <= r["accuracy"] <= 1 for r in grid)
    weights = QUERIES["tree_importance"](spark, sf).collect()
    assert abs(sum(r["importance"] for r in weights) - 1) < 1e-9
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    held = QUERIES["one_vs_rest"](spark, sf).collect()
    assert 0 < len(held) < n / 3
    assert all(len(r["truth"]) == len(r["predicted"]) for r in QUERIES["top_labels"](spark, sf).collect())


# ---------------------------------------------------------------- tables and graphs


def test_running_totals_and_pairs(spark):
    rows = [(k, k % 5 + 1) for k in range(200)]
    got = {r["k"]: r["before"] for r in O.running_total(spark.createDataFrame(rows, "k int, n int").repartition(7), [F.asc("k")], "n", "before").collect()}
    total = 0
    for k, n in rows:
        assert got[k] == total
        total += n
    assert O.running_total(spark.createDataFrame([], "k int, n int"), [F.asc("k")], "n", "before").count() == 0
    a, b = spark.range(50).toDF("a"), spark.range(30).toDF("b")
    R.PAIR_BLOCK, before = 7, R.PAIR_BLOCK
    try:
        assert sorted(map(tuple, R.beside(a, b, "a", "b").collect())) == [(x, y) for x in range(50) for y in range(30)]
    finally:
        R.PAIR_BLOCK = before


@pytest.mark.parametrize("ratio", [0.5, 1.0, 3.0, 50.0])
def test_under_sampling(spark, ratio):
    df = spark.createDataFrame([(k, int(k % 11 > 0)) for k in range(300)], "k long, y int")
    got = O.under_sampled(df, "y", "k", ratio, "s").collect()
    few = [r for r in got if r["y"] == 0]
    assert len(few) == 28 and len({r["k"] for r in got}) == len(got) == 28 + min(272, int(28 * ratio))


def test_pagerank_ends_by_its_bound(spark):
    """A long path with a tiny bound takes more than fifty rounds; every residual ends under it."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "src long, dst long")
    got = G.personalised_pagerank(edges, spark.createDataFrame([(0,)], "id long"), 0.15, 1e-4).collect()
    a = np.zeros((13, 13))
    for k in range(12):
        a[k, k + 1] = a[k + 1, k] = 1
    p = np.linalg.solve(np.eye(13) - 0.85 * (a / a.sum(1, keepdims=True)).T, 0.15 * np.eye(13)[0])
    assert len(got) == 13 and max(abs(r["p"] - p[r["id"]]) for r in got) < 1e-3


def test_singular_directions_by_rows_are_those_by_joins(spark, monkeypatch):
    """A small vocabulary takes one pass over whole rows; longer rows, or a larger vocabulary, take joins, with the same directions."""
    rng = random.Random(9)
    cells = {(r, f"t{rng.randint(0, 14)}"): rng.random() for r in range(60) for _ in range(6)}
    m = np.zeros((60, 15))
    for (r, t), w in cells.items():
        m[r, int(t[1:])] = w
    df = spark.createDataFrame([(r, t, w) for (r, t), w in cells.items()], "r long, t string, w double")
    _, want, right = np.linalg.svd(m)
    calls, row_products = [], spectra._row_products
    monkeypatch.setattr(spectra, "_row_products", lambda rows, n: calls.append(n) or row_products(rows, n))
    for most in (1_024, 2):
        monkeypatch.setattr(spectra, "ROW_CELLS", most)
        values, vectors = spectra.singular_directions(df, "r", "t", "w", 3)
        got = np.zeros((15, 3))
        for row in vectors.collect():
            got[int(row["t"][1:])] = row["x"]
        assert np.allclose(values, want[:3]) and np.allclose(np.abs(np.einsum("kj,jk->k", right[:3], got)), 1)
    assert calls == [15]


# ---------------------------------------------------------------- files


def test_score_files(spark, tmp_path):
    scores = spark.createDataFrame([("b", "x", 0.5, 1), ("b", "x", 0.25, 2), ("a", 'q"1', 1.0, 1), ("a", "y", 0.125, 1), (None, "z", 1.0, 1)], "author_id string, id string, score double, at int")
    want = {"a": {'q"1': 1.0, "y": 0.125}, "b": {"x": 0.25}}
    S.write_scores(scores, str(tmp_path / "lines"), order="at")
    S.write_score_object(scores, str(tmp_path / "object"), order="at")
    text = "\n".join(f.read_text() for f in sorted((tmp_path / "object").glob("part-*")))
    assert json.loads(text) == want and text == json.dumps(want, indent=4) + "\n"
    for path, whole in (("lines", False), ("object", True)):
        got = {}
        for r in S.read_scores(spark, str(tmp_path / path), whole).collect():
            got.setdefault(r["author_id"], {})[r["id"]] = r["score"]
        assert got == want
    best = {r["author_id"]: r["scores"] for r in S.nested_scores(scores).collect()}
    assert best["b"] == {"x": 0.5}


def test_scores_are_dealt_to_counted_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "SCORE_ROWS", 20)
    scores = spark.range(600).select((F.col("id") % 60).cast("string").alias("author_id"), F.col("id").cast("string").alias("id"), (F.col("id") / 8).alias("score"))
    made = S.nested_scores(scores)
    assert made.rdd.getNumPartitions() == 30 and sum(len(r["scores"]) for r in made.collect()) == 600


def test_dictionary_ranges_are_small_and_shared_by_tasks():
    """A task's arrays of several numbers a byte are those of one range, of which it reads many in turn."""
    assert D.RANGE <= 2 << 20 <= 16 * D.RANGE <= D.TASK_BYTES
    data = np.frombuffer(b'{"a": "x\\"{", "b": [1]}', np.uint8)
    assert D._depths(data, D._strings(data, 0)).dtype == np.int32 and D._depths(data, D._strings(data, 0))[-1] == 0


def test_objects_grow_in_number_not_in_size(spark, monkeypatch):
    from quillon.plans import files

    monkeypatch.setattr(files, "OBJECT", 10)
    rows = spark.range(300).select("id", F.struct(F.col("id").cast("string").alias("id")).alias("v"))
    path = files._objects(rows, "id", F.col("v"), 8)
    sizes = [r["n"] for r in spark.read.text(path, wholetext=True).select((F.size(F.split("value", '"id":')) - 1).alias("n")).collect()]
    assert sum(sizes) == 300 and len(sizes) > 25 and max(sizes) <= 40
    assert sorted(int(r["id"]) for r in S.read_papers(spark, path, 64).select("id").collect()) == list(range(300))


def test_score_object_in_ranges(spark, tmp_path):
    """One object is read in ranges of bytes: no row holds it whole."""
    rows = [(f"a{k}", f"i{n}", n / 8) for k in range(20) for n in range(30)]
    S.write_score_object(spark.createDataFrame(rows, "author_id string, id string, score double"), str(tmp_path / "object"))
    got = S.read_scores(spark, str(tmp_path / "object"), True, size=256)
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted"\nline, with \\ marks', ["x", 'y"'], {"k": 1.5}), (2, None, None, None), (3, "", [], {})]
    df = spark.createDataFrame(rows, "id long, t string, l array<string>, m map<string,double>")
    S.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path / "csv"), df.schema).collect())) == rows


def test_inductive_graph(spark, tmp_path):
    np.savez(tmp_path / "adj_full.npz", data=np.array([1.0, 2.0, 3.0]), indices=np.array([1, 2, 0]), indptr=np.array([0, 2, 2, 3]), shape=np.array([3, 3]), format=b"csr")
    np.savez(tmp_path / "adj_train.npz", data=np.array([1.0]), indices=np.array([1]), indptr=np.array([0, 1, 1, 1]), shape=np.array([3, 3]), format=b"csr")
    np.save(tmp_path / "feats.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    (tmp_path / "class_map.json").write_text(json.dumps({"0": 4, "1": 2, "2": 0}))
    (tmp_path / "role.json").write_text(json.dumps({"tr": [0], "va": [1], "te": [2]}))
    g = S.read_inductive(spark, str(tmp_path))
    assert sorted(map(tuple, g["edges_full"].collect())) == [(0, 1, 1.0), (0, 2, 2.0), (2, 0, 3.0)] and g["edges_train"].count() == 1
    assert sorted((r["id"], r["x"]) for r in g["features"].collect()) == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    assert sorted((r["id"], r["y"]) for r in g["labels"].collect()) == [(0, [4]), (1, [2]), (2, [0])]
    assert sorted(tuple(r[c] for c in ("id", "train", "val", "test")) for r in g["roles"].collect()) == [(0, True, False, False), (1, False, True, False), (2, False, False, True)]


def test_covering_split(spark):
    labels = spark.createDataFrame([(k, k % 9 if k < 40 else -1) for k in range(60)], "id long, y int")
    got = S.covering_split(labels, {"train": 0.6, "val": 0.2, "test": 0.2}).collect()
    assert len(got) == 40 and {r["y"] for r in got if r["split"] == "train"} == set(range(9))
    with pytest.raises(ValueError):
        S.covering_split(labels, {"train": 0.0, "test": 1.0}, tries=2)



# ---------------------------------------------------------------- trees


def grown_leaf_by_leaf(x, y, score, model, turn, how):
    """One tree by the plain method: split the leaf with the best gain, again and again; (scores to add, leaves)."""
    p = 1 / (1 + np.exp(-score))
    g, h = p - y, p * (1 - p)
    bins = 1 + int(x.max())
    rng = np.random.default_rng([how.seed, model, turn])
    columns = np.sort(rng.permutation(x.shape[1])[: max(1, round(x.shape[1] * how.columns_of_tree))])

    def split(node, rows):
        if node.bit_length() > how.depth:
            return None
        own = np.random.default_rng([how.seed, model, turn, node])
        chosen = np.sort(own.permutation(columns)[: max(1, round(len(columns) * how.columns_of_node))])
        sums = np.stack([np.stack([np.bincount(x[rows, j], v[rows], bins) for v in (g, h, np.ones(len(g)))], axis=1) for j in range(x.shape[1])])
        return trees.best_split(sums, how, chosen, own)

    leaves = {1: np.arange(len(y))}
    best = {1: split(1, leaves[1])}
    while len(leaves) < how.leaves:
        able = [(-best[n][0], n) for n in leaves if best[n]]
        if not able:
            break
        n = min(able)[1]
        rows = leaves.pop(n)
        low = x[rows, best[n][1]] <= best[n][2]
        for child, part in ((2 * n, rows[low]), (2 * n + 1, rows[~low])):
            leaves[child], best[child] = part, split(child, part)
    add = np.zeros(len(y))
    for rows in leaves.values():
        top = g[rows].sum()
        add[rows] = -np.sign(top) * max(abs(top) - how.l1, 0) / (h[rows].sum() + how.l2) * how.rate
    return add, len(leaves)


@pytest.mark.parametrize("random_splits", [True, False])
def test_trees_are_those_grown_leaf_by_leaf(spark, random_splits):
    rng = np.random.default_rng(7)
    n = 500
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.1)).astype(int)
    rows = [(i, i % 2, int(y[i]), *(None if j == 3 and i % 9 == 0 else float(x[i, j]) for j in range(4))) for i in range(n)]
    x[::9, 3] = -1
    df = spark.createDataFrame(rows, "id int, fold int, y int, a double, b double, c double, d double").repartition(3)
    how = trees.How(rounds=3, leaves=6, depth=4, least_rows=5, bins=16, random_splits=random_splits, patience=9)
    model = trees.fit_folds(df, list("abcd"), "y", "fold", "id", how)
    got = {r["id"]: r["prob"] for r in model.transform(df, "id", "fold").collect()}
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(model.cuts)], axis=1)
    for k in range(2):
        fit, held = np.arange(n) % 2 != k, np.arange(n) % 2 == k
        score = np.full(fit.sum(), model.base[k])
        for t, tree in enumerate(model.trees[k]):
            add, leaves = grown_leaf_by_leaf(binned[fit], y[fit], score, k, t, how)
            assert leaves == (tree.feature < 0).sum()
            assert np.allclose(tree.scores(binned[fit]), add, atol=1e-9)
            score = score + add
        want = 1 / (1 + np.exp(-model.score(k, binned[held])))
        assert np.allclose([got[i] for i in np.flatnonzero(held)], want)
        area = [r for r in model.areas[k]]
        assert model.best[k] == int(np.argmax(area)) + 1
    assert abs(model.importances(spark).filter("fold = 0").agg(F.sum("importance")).first()[0] - 1) < 1e-9


# ---------------------------------------------------------------- eigenpairs and text models


def symmetric(seed, n=120, m=500):
    rng = np.random.default_rng(seed)
    a = np.zeros((n, n))
    for i, j in rng.integers(0, n, (m, 2)):
        a[i, j] = a[j, i] = rng.normal()
    return a


@pytest.mark.parametrize("largest", ["algebraic", "magnitude"])
def test_eigenpairs(spark, largest):
    a = symmetric(3)
    used = np.flatnonzero(np.abs(a).sum(axis=0))
    values = np.linalg.eigvalsh(a[np.ix_(used, used)])
    want = values[np.argsort(-values if largest == "algebraic" else -np.abs(values))][:4]
    m = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src long, dst long, w double")
    found = spectra.eigenpairs(m, 4, largest=largest, block=8, basis=48)
    assert np.abs(found.values - want).max() < 1e-9
    rows = spectra.residuals(m, found).collect()
    assert all(r["residual"] < 1e-6 and abs(r["length"] - 1) < 1e-9 for r in rows) and len(rows) == 4


def test_eigenpairs_of_small_and_empty_matrices(spark):
    two = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "c", 0.0)], "src string, dst string, w double")
    found = spectra.eigenpairs(two, 9)
    assert np.allclose(found.values[[0, -1]], [1, -1]) and len(found.values) <= 3
    assert len(spectra.eigenpairs(two.limit(0), 2).values) == 0
    cliques = [(a + 5 * c, b + 5 * c) for c in range(2) for a in range(5) for b in range(5) if a != b]
    e = spark.createDataFrame([(a, b, 0.25) for a, b in cliques], "src long, dst long, w double")
    x = {r["id"]: np.array(r["x"]) for r in spectra.spectral_embedding(e, 2).collect()}
    assert all(abs(x[a] @ x[b] - (a // 5 == b // 5)) < 1e-6 for a in x for b in x)
    p = spectra.positional_vectors(e, 20, 12).collect()
    assert all(len(r["x"]) == 12 and abs(np.linalg.norm(r["x"]) - 1) < 1e-6 for r in p)


def test_text_model_transfers(spark, tmp_path):
    """Fitted on a part, saved, loaded and applied to all, against dense matrices, up to signs."""
    import math
    import re
    from collections import Counter

    texts = ["the cat sat on the mat", "dogs and cats sat", "a blue mat for the dog", "birds fly over the blue sea", "the sea is blue", "cats chase birds", "", None, "unknown things"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    fit = [1, 2, 4, 5, 7]
    grams = lambda t: (lambda w: w + [" ".join(w[i : i + 2]) for i in range(len(w) - 1)])(re.findall("[0-9A-Za-z_]{2,}", (t or "").lower()))
    frequency = Counter(g for i in fit for g in set(grams(texts[i])))
    known = sorted(frequency)
    for idf in (True, False):
        weight = np.array([math.log((1 + len(fit)) / (1 + frequency[g])) + 1 if idf else 1.0 for g in known])
        dense = np.array([[Counter(grams(t))[g] for g in known] for t in texts]) * weight
        if idf:
            dense = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
        want = dense @ np.linalg.svd(dense[fit])[2][:3].T
        textmodels.fit_text_model(df.filter(F.col("k").isin(fit)), "k", "t", 3, max_df=1.0, idf=idf).save(f"{tmp_path}/{idf}")
        model = textmodels.load_text_model(spark, f"{tmp_path}/{idf}")
        x = np.array([r["x"] for r in model.transform(df, "k", "t").orderBy("k").collect()])
        assert np.allclose(np.abs(x), np.abs(want), atol=1e-7) and np.allclose(model.values, np.linalg.svd(dense[fit])[1][:3])


# ---------------------------------------------------------------- lines and windows


def test_lines_of_many_files(spark, tmp_path):
    """Numbers follow files by name and places in them, however Spark deals the splits."""
    want = []
    for name, n in (("a", 2), ("b", 400), ("c", 0), ("d", 37)):
        lines = [f"{name} line {k}" for k in range(n)]
        want += lines
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("500b", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sorted((r["line"], r["value"]) for r in S.numbered_lines(spark.read.text(str(tmp_path))).collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == list(enumerate(want))


def test_pair_windows(spark):
    rng = random.Random(6)
    walks = [(w, p, rng.choice("abc")) for w in range(4) for p in rng.sample(range(30), 12)]
    got = sorted(tuple(r) for r in O.pair_windows(spark.createDataFrame(walks, "w int, p int, n string"), "w", "p", "n", 3).collect())
    assert got == sorted((w, n, m) for w, p, n in walks for v, q, m in walks if v == w and p != q and abs(p - q) <= 3)


# ---------------------------------------------------------------- similar vectors and alias tables


@pytest.mark.parametrize("least", [False, True])
def test_index_is_exact_and_skips(spark, least):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6)) * 4
    x = np.concatenate([c + 0.2 * rng.normal(size=(60, 6)) for c in centres] + [np.zeros((2, 6)), centres[:1], centres[:1]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(3)
    index = N.VectorIndex(df, "id", "x", lists=24)
    asked = df.filter("id % 9 = 0")
    found, compared = index.search(asked, "id", "x", 4, least)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    full = np.flatnonzero(np.linalg.norm(x, axis=1) > 0)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["row"], r["score"]))
    for q in range(0, len(x), 9):
        others = full[full != q]
        s = unit[others] @ unit[q]
        order = np.lexsort((others, np.round(s if least else -s, 12)))[:4]
        if np.linalg.norm(x[q]) == 0:
            assert q not in got
        else:
            assert np.allclose([b for _, b in got[q]], s[order]) and len({a for a, _ in got[q]}) == 4
    share = np.mean([r["compared"] for r in compared.collect()]) / len(full)
    assert share < 0.5


def test_index_of_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, x array<double>")
    found, _ = N.VectorIndex(df, "id", "x").search(df, "id", "x", 5)
    assert sorted((r["query"], r["row"], r["rank"]) for r in found.collect()) == [(1, 2, 1), (2, 1, 1)]
    empty = df.limit(0)
    assert N.VectorIndex(empty, "id", "x").search(df, "id", "x", 5)[0].count() == 0


@pytest.mark.parametrize("items", [1 << 15, 7])
def test_alias_tables_and_draws(spark, monkeypatch, items):
    monkeypatch.setattr(N, "ALIAS_ITEMS", items)
    rng = random.Random(3)
    rows = [("a", i, float(rng.randint(0, 9))) for i in range(40)] + [("b", 1, 2.5), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, i long, w double")
    tables = N.alias_tables(df, "g", "i", "w")
    shares = {(r["group"], r["item"]): r["share"] for r in N.alias_shares(tables).collect()}
    total = sum(w for g, _, w in rows if g == "a")
    assert set(shares) == {(g, i) for g, i, w in rows if w > 0 and g}
    assert all(abs(shares["a", i] - w / total) < 1e-12 for g, i, w in rows if g == "a" and w > 0) and shares["b", 1] == 1
    wanted = spark.createDataFrame([("a", 20_000), ("b", 3), ("c", 5), ("b", 0)], "g string, n int")
    drawn = N.alias_draws(tables, wanted, "g", "n", "t").groupBy("group", "item").count().collect()
    counts = {(r["group"], r["item"]): r["count"] for r in drawn}
    assert counts.pop(("b", 1)) == 3 and sum(counts.values()) == 20_000
    assert all(abs(counts.get(k, 0) / 20_000 - s) < 5 * (s / 20_000) ** 0.5 for k, s in shares.items() if k[0] == "a")


def test_alias_draws_are_made_by_many_tasks(spark, monkeypatch):
    """One group's draws are dealt before they are made, and are those of the group and number alone, in however many stretches."""
    df = spark.createDataFrame([("a", i, 1.0 + i % 3) for i in range(30)], "g string, i long, w double")
    wanted = spark.createDataFrame([("a", 1_000)], "g string, n int")
    found = []
    for draws in (1 << 12, 10):
        monkeypatch.setattr(N, "DRAWS", draws)
        made = N.alias_draws(N.alias_tables(df, "g", "i", "w"), wanted, "g", "n", "t")
        found.append(sorted(tuple(r) for r in made.collect()))
    assert found[0] == found[1] and [r[1] for r in found[0]] == list(range(1, 1_001))
    plain = N.drawn_by(N.alias_tables(df, "g", "i", "w"), spark.range(1, 1_001).select(F.lit("a").alias("group"), F.col("id").cast("int").alias("draw")), "t")
    assert sorted(tuple(r) for r in plain.collect()) == found[0]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_alias_shares_of_whole_weights_are_exact(spark, monkeypatch):
    """Shares that end in a 5 at the seventh place round as w / sum(w) does, also over several tables of a group."""
    weights = {i: 33.0 + 2 * i for i in range(100)}
    weights[100] = 16_000 - sum(weights.values())
    df = spark.createDataFrame([("a", i, w) for i, w in weights.items()], "g string, i long, w double")
    for items in (1 << 15, 40):
        monkeypatch.setattr(N, "ALIAS_ITEMS", items)
        shares = {r["item"]: r["share"] for r in N.alias_shares(N.alias_tables(df, "g", "i", "w")).collect()}
        assert shares == {i: w / 16_000 for i, w in weights.items()}


# ---------------------------------------------------------------- dictionaries


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_dictionaries_in_ranges(spark, tmp_path, size):
    """The same entries whatever the ranges: quotes, escapes and brackets in strings, nested values, white space, many files."""
    rng = random.Random(5)
    odd = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "\n", "\\\\\"", "x" * 20, "", "😀"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 6)))
    want = {}
    for name, n, how in (("a", 12, {"indent": 1}), ("b", 5, {"separators": (",", ":")}), ("c", 0, {}), ("d", 1, {"ensure_ascii": False})):
        own = {f"{name}{k}{text()}": {"t": text(), "l": [text() for _ in range(rng.randint(0, 3))], "n": {"x": k}} for k in range(n)}
        (tmp_path / f"{name}.json").write_text(json.dumps(own, **how), encoding="utf-8")
        want |= own
    (tmp_path / "empty.json").write_text("")
    got = D.read_dictionary(spark, str(tmp_path), "struct<t:string,l:array<string>,n:struct<x:int>>", size).collect()
    assert len(got) == len(want) and {r["key"]: r["value"].asDict(recursive=True) for r in got} == want


@pytest.mark.parametrize("name", [lambda i: i * 3 - 7, lambda i: f"{'é' if i % 3 else 'z'}{i}"])
def test_tiles_multiply_as_the_dense_matrix_does(spark, monkeypatch, name):
    from quillon.operators import spectra

    for limit, value in (("HELD", 40), ("CELLS", 25), ("STEP", 7)):  # several blocks of columns and of rows; rows longer than a step
        monkeypatch.setattr(spectra, limit, value)
    rng = np.random.default_rng(5)
    a = np.where(rng.random((30, 30)) < 0.15, rng.normal(size=(30, 30)), 0)
    a[4], a[:, 9] = 1.5, -0.5
    a[11] = 0
    kind = "long" if isinstance(name(0), int) else "string"
    m = spark.createDataFrame([(name(int(i)), name(int(j)), float(a[i, j])) for i, j in zip(*np.nonzero(a))], f"src {kind}, dst {kind}, w double")
    ids = spark.createDataFrame([(name(i),) for i in range(30)], f"id {kind}")
    x = rng.normal(size=(30, 4))
    vectors = spark.createDataFrame([(name(i), x[i].tolist()) for i in range(30)], f"id {kind}, x array<double>")
    got = {r["id"]: r["x"] for r in spectra.tiled(m, ids, 4)(vectors, 4).collect()}
    assert set(got) == {name(i) for i in range(30) if i != 11}
    assert all(np.allclose(got[name(i)], (a @ x)[i], rtol=0, atol=1e-12) for i in range(30) if i != 11)
    plan = spectra.tiled(m, ids, 4)(vectors, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no row a cell and vector


# ---------------------------------------------------------------- alias tables, round 4


def test_alias_tables_are_the_same_however_rows_arrive(spark, monkeypatch):
    monkeypatch.setattr(N, "ALIAS_ITEMS", 20)
    rows = [("a", i, float(1 + i * 7 % 13)) for i in range(60)] + [("b", i, float(1 + i)) for i in range(5)]
    made = []
    for order in (rows, rows[::-1]):
        tables = N.alias_tables(spark.createDataFrame(order, "g string, i long, w double").coalesce(1), "g", "i", "w")
        made.append([sorted(map(tuple, t.collect())) for t in tables])
    assert made[0] == made[1]
    plan = N.alias_shares(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2  # both sides of a place come from one making of each table


def test_alias_shares_round_and_filter_as_the_sql(spark, tmp_path):
    import duckdb

    rows = [(1, 10, 41.0), (1, 11, 599.0), (2, 10, -3.0), (2, 10, 5.0), (2, 11, 2.0), (2, 12, -1.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = duckdb.sql(registry.oracle_sql()["alias_shares"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in registry.queries()["alias_shares"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (1, 10, 0.064062) in got
