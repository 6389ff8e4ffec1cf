"""Text and vector feature models: fits as aggregates, transforms as expressions; Spark ML where it has the model."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators.graph import vector_max, vector_sum

#: Words of two letters or more, ASCII classes spelled out so that every engine agrees.
WORD = r"[0-9A-Za-z_]{2,}"
#: Terms that may be broadcast, once counted.
FEW_TERMS = 1 << 17
#: Words that a task of a skip-gram model learns from; Spark ML takes one task for all where it isn't told.
FIT_WORDS = 1 << 18


def terms(df: DataFrame, key: str, text: str, grams: int = 2) -> DataFrame:
    """(key, term): lower-cased words and word pairs (up to `grams` words), as often as they stand."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    lists = [words]
    for n in range(2, grams + 1):
        at = F.when(F.size("_w") >= n, F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))
        lists.append(_grams(at, n))
    return df.select(key, words.alias("_w")).select(key, F.explode(F.concat(F.col("_w"), *lists[1:])).alias("term"))


def _grams(at, n: int):
    return F.transform(at, lambda i: F.array_join(F.slice("_w", i + 1, n), " "))


def tf_idf(df: DataFrame, key: str, text: str, grams: int = 2, max_df: float = 0.95, min_df: int = 1) -> DataFrame:
    """(key, term, weight): counts times ln((1 + n) / (1 + df)) + 1, rows of length 1; terms in over max_df of the rows go.

    Terms are broadcast if they are counted to be at most FEW_TERMS; the cells never are.
    """
    from quillon.sources.tables import cut

    counts = cut(terms(df, key, text, grams).groupBy(key, "term").agg(F.count("*").alias("tf")))
    n = df.agg(F.count("*").alias("_n"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("_df")).crossJoin(F.broadcast(n))  # one row
    kept = frequency.filter((F.col("_df") >= min_df) & (F.col("_df") <= max_df * F.col("_n"))).select("term", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("_idf"))
    kept = cut(kept)
    raw = counts.join(F.broadcast(kept) if kept.count() <= FEW_TERMS else kept.hint("merge"), "term").filter(F.col(key).isNotNull()).select(key, "term", (F.col("tf") * F.col("_idf")).alias("_x"))
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(key)))  # a join with a row a key could be taken for a small one
    return raw.select(key, "term", (F.col("_x") / length).alias("weight"))


def truncated_svd(weights: DataFrame, key: str, rank: int, **how) -> DataFrame:
    """(key, x): rows of a long (key, term, weight) table, each cell once, on their leading `rank` right singular directions.

    See spectra.singular_directions; `how` goes to its solver.
    """
    from quillon.operators import spectra
    from quillon.sources.tables import cut

    values, right = spectra.singular_directions(weights, key, "term", "weight", rank, **how)
    return vector_sum(weights.join(cut(right), "term"), [key], V.scaled(F.col("x"), F.col("weight")), len(values))


def standard_scaled(df: DataFrame, columns: list[str], fit_on=None) -> DataFrame:
    """(x - mean) / population deviation, the statistics from the rows that `fit_on` marks; constant columns give 0."""
    fit = df if fit_on is None else df.filter(fit_on)
    stats = fit.agg(*(f(c).alias(f"{c}{n}") for c in columns for f, n in ((F.avg, "_mu"), (F.stddev_pop, "_sd"))))
    made = df.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        made = made.withColumn(c, F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_mu"), F.col(f"{c}_sd")), F.lit(0.0)))
    return made.select(*df.columns)


def centroid_features(df: DataFrame, group: str, key: str, vec: str, width: int) -> DataFrame:
    """(group, key, centroid, one column a distance): each vector against its group's mean.

    The centroid is one grouped sum that combines before the shuffle, joined
    back by group; no window sorts the vectors.
    """
    own = df.filter(F.col(group).isNotNull()).select(group, key, F.col(vec).cast("array<double>").alias("v"))
    centre = vector_sum(own, [group], F.col("v"), width, mean=True).withColumnRenamed("x", "centroid")
    return own.join(centre, group).select(group, key, "centroid", *(f(F.col("v"), F.col("centroid")).alias(n) for n, f in V.DISTANCES.items()))


def group_difference(df: DataFrame, group: str, key: str, vec: str, width: int, stat: str = "mean") -> DataFrame:
    """(group, key, stat, diff): each vector less its group's mean, max or min."""
    own = df.filter(F.col(group).isNotNull()).select(group, key, F.col(vec).cast("array<double>").alias("v"))
    centre = vector_sum(own, [group], F.col("v"), width, mean=True) if stat == "mean" else vector_max(own, [group], F.col("v"), width, least=stat == "min")
    return own.join(centre, group).select(group, key, F.col("x").alias("stat"), V.minus(F.col("v"), F.col("x")).alias("diff"))


def mean_word_vectors(df: DataFrame, key: str, text: str, vectors: DataFrame, width: int) -> DataFrame:
    """(key, x): mean of the known words' vectors (word, x), zeros where none is known."""
    words = df.select(key, F.explode(F.split(text, " ")).alias("word")).join(vectors, "word")
    zeros = F.array(*(F.lit(0.0) for _ in range(width)))
    return df.select(key).join(vector_sum(words, [key], F.col("x"), width, mean=True), key, "left").select(key, F.coalesce("x", zeros).alias("x"))


def word2vec(df: DataFrame, tokens: str, width: int = 64, window: int = 10, min_count: int = 3, seed: int = 2024, iterations: int = 1) -> DataFrame:
    """(word, x) by Spark ML's skip-gram model, fitted by a task for each FIT_WORDS words, which are counted."""
    tasks = -(-(df.agg(F.sum(F.greatest(F.size(tokens), F.lit(0)))).first()[0] or 1) // FIT_WORDS)
    model = Word2Vec(vectorSize=width, windowSize=window, minCount=min_count, seed=seed, maxIter=iterations, numPartitions=tasks, inputCol=tokens, outputCol="_out").fit(df)
    return model.getVectors().select("word", vector_to_array("vector").alias("x"))


def principal_components(df: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    from pyspark.ml.feature import PCA

    prepared = df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return PCA(k=k, inputCol="_v", outputCol="_o").fit(prepared).transform(prepared).select(key, vector_to_array("_o").alias("x"))


def boosted_folds(df: DataFrame, features: list[str], label: str, fold: str, key: str, how=None) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold probabilities (key, prob) of gradient-boosted trees, and importances (fold, feature, importance, trees); see trees.fit_folds."""
    from quillon.operators import trees

    model = trees.fit_folds(df, features, label, fold, key, how)
    return model.transform(df.filter(F.col(fold).isNotNull() & F.col(label).isNotNull()), key, fold), model.importances(df.sparkSession)


def clusters(df: DataFrame, key: str, vec: str, k: int, seed: int = 1) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    prepared = df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(prepared).transform(prepared).select(key, F.col("prediction").alias("cluster"))


def spectral_clusters(edges: DataFrame, k: int, seed: int = 1, **how) -> DataFrame:
    """(id, cluster): k-means of the rows, of length 1, of the leading eigenvectors of the normalised adjacency with loops."""
    from quillon.operators import graph as G
    from quillon.operators import spectra
    from quillon.sources.tables import cut

    both = G.mirrored(G.without_loops(edges)).withColumn("w", F.lit(1.0))
    nodes = both.select(F.col("src").alias("id")).distinct()
    rows = cut(spectra.eigenpairs(cut(G.weighted_normalised(both, nodes)), k, **how).vectors)
    return clusters(rows.select("id", V.unit(F.col("x")).alias("x")), "id", "x", k, seed)


def best_mapping(gain: np.ndarray) -> np.ndarray:
    """The column of each row of a square matrix, each taken once, with the largest sum (the Hungarian method, by shortest paths)."""
    n = len(gain)
    cost = float(gain.max(initial=0)) - np.asarray(gain, float)
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        row_of[0], at = row, 0
        least, came, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            done[at] = True
            slack = np.concatenate([[np.inf], cost[row_of[at] - 1] - u[row_of[at]] - v[1:]])
            better = ~done & (slack < least)
            least[better], came[better] = slack[better], at
            open_ = np.where(done, np.inf, least)
            open_[0] = np.inf
            to = int(open_.argmin())
            step = open_[to]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            at = to
            if not row_of[at]:
                break
        while at:
            row_of[at] = row_of[came[at]]
            at = came[at]
    out = np.zeros(n, int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def mapped_clusters(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """df with `mapped`: each cluster's label under the one-to-one mapping with the most agreement.

    Only the contingency counts (clusters times labels) reach the driver.
    """
    cells = df.groupBy(cluster, label).agg(F.count("*").alias("n")).collect()
    rows, columns = sorted({r[0] for r in cells}), sorted({r[1] for r in cells})
    n = max(len(rows), len(columns))
    gain = np.zeros((n, n))
    for r in cells:
        gain[rows.index(r[0]), columns.index(r[1])] = r["n"]
    to = best_mapping(gain)
    pairs = [(r, columns[to[k]] if to[k] < len(columns) else None) for k, r in enumerate(rows)]
    schema = f"{cluster} {df.schema[cluster].dataType.simpleString()}, mapped {df.schema[label].dataType.simpleString()}"
    return df.join(F.broadcast(df.sparkSession.createDataFrame(pairs, schema)), cluster)  # a row a cluster


def svm_grid(df: DataFrame, vec: str, label: str, costs: list[float], folds: int = 10, seed: str = "0", key: str = "id") -> DataFrame:
    """(cost, fold, accuracy): a linear SVM for each cost and fold, rows dealt to folds by md5; labels 0 and 1."""
    from pyspark.ml.classification import LinearSVC

    from quillon.operators.tables import hashed
    from quillon.sources.tables import cut

    place = F.conv(F.substring(hashed(seed, F.col(key)), 1, 8), 16, 10).cast("long")
    plain = cut(df.select(F.col(label).cast("double").alias("label"), F.col(vec).cast("array<double>").alias("_x"), F.pmod(place, F.lit(folds)).alias("fold")))
    prepared = plain.select("label", "fold", array_to_vector("_x").alias("features"))
    out = []
    for cost in costs:
        for k in range(folds):
            model = LinearSVC(regParam=1 / cost, maxIter=20).fit(prepared.filter(F.col("fold") != k))
            right = model.transform(prepared.filter(F.col("fold") == k)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
            out.append((float(cost), k, right))
    return df.sparkSession.createDataFrame(out, "cost double, fold int, accuracy double")


def top_labels(df: DataFrame, key: str, vec: str, labels: str, fit_on, classes: int) -> DataFrame:
    """(key, truth, predicted) of the rows that `fit_on` leaves out: one logistic model a class, and as many labels as a row truly has.

    labels is an array of class numbers from 0.
    """
    from pyspark.ml.classification import LogisticRegression

    prepared = df.select(key, F.col(labels).alias("truth"), array_to_vector(F.col(vec).cast("array<double>")).alias("features"), fit_on.alias("_fit"))
    rest = prepared.filter(~F.col("_fit"))
    for k in range(classes):
        own = prepared.filter("_fit").withColumn("label", F.array_contains("truth", k).cast("double"))
        model = LogisticRegression(maxIter=10, regParam=0.01, rawPredictionCol="_r", probabilityCol=f"_{k}", predictionCol="_p").fit(own)
        rest = model.transform(rest).drop("_r", "_p").withColumn(f"_{k}", F.get(vector_to_array(f"_{k}"), F.lit(1)))
    ranked = F.sort_array(F.array(*(F.struct((-F.col(f"_{k}")).alias("s"), F.lit(k).alias("c")) for k in range(classes))))
    return rest.select(key, "truth", F.slice(F.transform(ranked, lambda x: x["c"]), F.lit(1), F.size("truth")).alias("predicted"))


def group_documents(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, text): an entity's texts in order, joined by a space."""
    from quillon.operators.tables import concatenated

    return concatenated(df, group, text, order)


def group_embeddings(documents: DataFrame, group: str, text: str, size: int, how: str) -> DataFrame:
    """(group, x) of an entity's documents: its weights of the `size` most frequent terms (tfidf, counts), these on singular directions (svd), or its mean word vector (words)."""
    from quillon.sources.tables import cut

    if how == "words":
        tokens = documents.select(group, F.split(F.lower(text), " ").alias("_t"))
        return mean_word_vectors(documents.select(group, F.lower(text).alias(text)), group, text, cut(word2vec(tokens, "_t", size)), size)
    counts = cut(terms(documents, group, text, 1).groupBy(group, "term").agg(F.count("*").cast("double").alias("tf")))
    if how == "svd":
        weights = cut(tf_idf(documents, group, text, 1, max_df=1.0))
        return truncated_svd(weights, group, size)
    top = counts.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(size)
    chosen = cut(top.select("term", (F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1).alias("at")))  # `size` rows
    weights = counts if how == "counts" else tf_idf(documents, group, text, 1, max_df=1.0).withColumnRenamed("weight", "tf")
    cells = weights.join(F.broadcast(chosen), "term").groupBy(group).agg(*(F.coalesce(F.sum(F.when(F.col("at") == k, F.col("tf"))), F.lit(0.0)).alias(f"_{k}") for k in range(size)))
    zeros = F.array(*(F.lit(0.0) for _ in range(size)))
    return documents.select(group).distinct().join(cells.select(group, F.array(*(f"_{k}" for k in range(size))).alias("x")), group, "left").select(group, F.coalesce("x", zeros).alias("x"))


def save_model(model, path: str) -> None:
    """A Spark ML model or pipeline under a path that all executors see."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """A model that save_model wrote, of the class its metadata names."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, SparkSession.active())


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information of two labellings: 2 I / (Ha + Hb), from their contingency counts."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, columns = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))
    joined = cells.join(rows, a).join(columns, b).crossJoin(F.broadcast(total))  # one row
    information = joined.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("i"))
    entropy = lambda d, c, n: d.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(n))
    made = information.crossJoin(entropy(rows, "na", "ha")).crossJoin(entropy(columns, "nb", "hb"))
    return made.select(F.coalesce(F.try_divide(2 * F.col("i"), F.col("ha") + F.col("hb")), F.lit(1.0)).alias("nmi"))


def scored(df: DataFrame, score, schema: str) -> DataFrame:
    """Batch scoring by any model: `score` maps Arrow record batches to record batches."""
    return df.mapInArrow(score, schema)
