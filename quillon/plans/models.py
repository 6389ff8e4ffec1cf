"""Queries that fit models; checked by properties and held-out figures instead of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import edgevectors as L
from quillon.operators import factor
from quillon.operators import features as M
from quillon.operators import graph as G
from quillon.operators import spectra
from quillon.operators import tables as O
from quillon.operators import textmodels as T
from quillon.operators.trees import How
from quillon.plans.graphs import _edges, _nodes
from quillon.plans.registry import query, rounded
from quillon.sources.tables import cut, new_path, table


def _part_texts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))


@query()
def tfidf_svd(spark, d):
    """TF-IDF rows on their first eight singular directions."""
    p = _part_texts(spark, d)
    return T.fit_text_model(p, "p_partkey", "t", 8).transform(p, "p_partkey", "t")


@query()
def count_svd(spark, d):
    """Counts of words and word pairs in at least two rows on their first eight singular directions."""
    p = _part_texts(spark, d)
    return T.fit_text_model(p, "p_partkey", "t", 8, min_df=2, idf=False).transform(p, "p_partkey", "t")


@query()
def text_model_transfer(spark, d):
    """A model fitted on four fifths of the rows, saved, loaded, and applied to the rest."""
    p = _part_texts(spark, d)
    held = F.col("p_partkey") % 5 == 0
    path = new_path(spark, "text-model")
    T.fit_text_model(p.filter(~held), "p_partkey", "t", 8).save(path)
    return T.load_text_model(spark, path).transform(p.filter(held), "p_partkey", "t")


@query("""SELECT CAST(k AS BIGINT) AS place, true AS unit, true AS singular, true AS falling FROM range(8) t(k)""")
def singular_residuals(spark, d):
    """The fitted directions are unit vectors that the matrix and its transpose scale by squared singular values."""
    p = _part_texts(spark, d)
    weights = cut(M.tf_idf(p, "p_partkey", "t"))
    values, right = spectra.singular_directions(weights, "p_partkey", "term", "weight", 8)
    cells = lambda a, b: weights.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("weight").alias("w"))
    vectors = cut(right.withColumnRenamed("term", "id"))
    few = vectors.count() * 8 <= spectra.BROADCAST_NUMBERS
    image = spectra.times(cells("term", "p_partkey"), spectra.times(cells("p_partkey", "term"), vectors, 8, few), 8).withColumnRenamed("x", "y")
    both = vectors.join(image, "id")
    squares = [float(v) ** 2 for v in values]
    one = both.agg(*(F.sqrt(F.sum(F.pow(F.col("y")[k] - squares[k] * F.col("x")[k], 2))).alias(f"r{k}") for k in range(8)), *(F.sum(F.pow(F.col("x")[k], 2)).alias(f"l{k}") for k in range(8)))
    falling = [k == 0 or squares[k] <= squares[k - 1] for k in range(8)]
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).cast("bigint").alias("place"), (F.abs(F.col(f"l{k}") - 1) < 1e-9).alias("unit"), (F.col(f"r{k}") < 1e-6 * squares[0]).alias("singular"), F.lit(falling[k]).alias("falling")) for k in range(8)))))


_G = """WITH g AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1), w AS (SELECT conv_id, unnest(regexp_extract_all(lower(t), '[0-9A-Za-z_]{2,}')) AS term FROM g),
c AS (SELECT conv_id, term, count(*) AS tf FROM w GROUP BY ALL), k AS (SELECT term, row_number() OVER (ORDER BY sum(tf) DESC, term) AS place FROM c GROUP BY 1 QUALIFY place <= 6)"""


def _groups(spark, d):
    return cut(M.group_documents(table(spark, d, "conversations"), "conv_id", "turn", "text"))


def _cells(weights):
    return f"""SELECT g.conv_id, list(CAST(round(coalesce(f.x, 0), 6) AS DOUBLE) ORDER BY k.place) AS x FROM g CROSS JOIN k LEFT JOIN ({weights}) f ON f.conv_id = g.conv_id AND f.term = k.term GROUP BY 1"""


@query(f"{_G} {_cells('SELECT conv_id, term, tf AS x FROM c')}")
def group_counts(spark, d):
    """An entity's counts of the most frequent terms."""
    return rounded(M.group_embeddings(_groups(spark, d), "conv_id", "text", 6, "counts"))


@query(f"""{_G}, f AS (SELECT term, ln((1 + (SELECT count(*) FROM g)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1), r AS (SELECT conv_id, term, tf * idf AS x FROM c JOIN f USING (term)),
v AS (SELECT conv_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY conv_id)) AS x FROM r) {_cells('SELECT * FROM v')}""")
def group_tfidf(spark, d):
    """An entity's TF-IDF weights of the most frequent terms."""
    return rounded(M.group_embeddings(_groups(spark, d), "conv_id", "text", 6, "tfidf"))


@query()
def group_svd(spark, d):
    """An entity's TF-IDF row on its first singular directions."""
    return M.group_embeddings(_groups(spark, d), "conv_id", "text", 6, "svd")


@query()
def group_words(spark, d):
    """An entity's mean word vector."""
    return M.group_embeddings(_groups(spark, d), "conv_id", "text", 6, "words")


@query()
def word_vectors(spark, d):
    """Skip-gram vectors of cleaned conversation words."""
    c = table(spark, d, "conversations").select(F.split(X.clean_text(F.col("text")), " ").alias("t"))
    return M.word2vec(c, "t", 8, 5, 3)


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), v AS (SELECT p_partkey, k, avg(CAST('0x' || substr(md5(w), 1 + 2 * k, 2) AS BIGINT) / 255.0) AS x FROM w, range(3) t(k) GROUP BY ALL)
SELECT p_partkey, list(round(x, 6) ORDER BY k) AS x FROM v GROUP BY 1""")
def mean_word_vectors(spark, d):
    """Mean vectors of known words, zeros without any."""
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("t"))
    words = p.select(F.explode(F.split("t", " ")).alias("word")).distinct()
    at = lambda k: F.conv(F.substring(F.md5("word"), 1 + 2 * k, 2), 16, 10).cast("double") / 255
    return rounded(M.mean_word_vectors(p, "p_partkey", "t", words.select("word", F.array(at(0), at(1), at(2)).alias("x")), 3))


@query()
def principal_components(spark, d):
    """One fit for all rows."""
    return M.principal_components(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


def _boosted(spark, d):
    o = table(spark, d, "orders")
    folds = O.group_folds(o.select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y")), "o_custkey", "y", 3)
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    rows = o.join(folds, "o_custkey").join(lines, "o_orderkey", "left").select("o_orderkey", "fold", (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice", "n", "q")
    return M.boosted_folds(cut(rows), ["o_totalprice", "n", "q"], "y", "fold", "o_orderkey", How(rounds=6, leaves=8, depth=4, patience=3))


@query()
def boosted_trees(spark, d):
    """Out-of-fold probabilities of trees grown by leaf, whole groups in folds, boosting stopped by the held fold's area under the curve."""
    return _boosted(spark, d)[0]


@query()
def tree_importance(spark, d):
    """Mean importance of each feature over the folds, largest first."""
    return _boosted(spark, d)[1].groupBy("feature").agg(F.avg("importance").alias("importance"), F.max("trees").alias("trees")).orderBy(F.desc("importance"), "feature")


@query()
def vector_clusters(spark, d):
    """K-means."""
    return M.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 10)


def _symmetric(spark, d):
    """The part graph without directions and loops, by the roots of both degrees."""
    return cut(G.normalised(G.mirrored(G.without_loops(_edges(spark, d))), "sym"))


@query()
def spectral_clusters(spark, d):
    """Spectral clustering of the part graph."""
    return M.spectral_clusters(_edges(spark, d), 4, block=32, basis=512, tolerance=1e-6)


@query()
def cluster_agreement(spark, d):
    """K-means clusters mapped one to one on labels, accuracy of each label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    c = M.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    return rounded(M.mapped_clusters(cut(e.join(c, "vec_id")), "cluster", "label").groupBy("label").agg(F.avg((F.col("mapped") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n")))


@query()
def svm_grid(spark, d):
    """Linear SVMs over a grid of costs and folds."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("y"))
    return M.svm_grid(e, "embedding", "y", [0.1, 10.0], 3, "svm", "vec_id")


@query()
def top_labels(spark, d):
    """One model a class; held-out rows get as many labels as they have."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.array_distinct(F.array(F.col("label") % 4, F.col("label") % 3)).cast("array<int>").alias("labels"))
    return M.top_labels(e, "vec_id", "embedding", "labels", F.crc32(F.col("vec_id").cast("string").cast("binary")) % 5 != 0, 4)


@query("SELECT doc_id, round(length(regexp_replace(coalesce(text, ''), '[^aeiou]', '', 'g')) / greatest(length(coalesce(text, '')), 1), 6) AS score FROM documents")
def batch_scores(spark, d):
    """Any scorer over Arrow batches; here a fixed one, the share of vowels."""

    def score(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).to_pylist()
            share = [sum(c in "aeiou" for c in t or "") / max(1, len(t or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(share, pa.float64())], names=["doc_id", "score"])

    return rounded(M.scored(table(spark, d, "documents").select("doc_id", "text"), score, "doc_id long, score double"))


@query()
def one_vs_rest(spark, d):
    """A linear model for each class, fitted on four fifths of the vectors (by hash); predictions for the rest."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    held = F.crc32(F.col("vec_id").cast("string").cast("binary")) % 5 == 0
    model = OneVsRest(classifier=LogisticRegression(maxIter=10, regParam=0.1)).fit(e.filter(~held))
    return model.transform(e.filter(held)).select("vec_id", F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("predicted"))


@query()
def walk_embeddings(spark, d):
    """Walks as sentences, skip-gram vectors of nodes."""
    walks = G.random_walks(_edges(spark, d), _nodes(spark, d), 6, seed="e")
    lines = walks.groupBy("walk").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "node"))), lambda s: s["node"].cast("string")).alias("t"))
    return M.word2vec(cut(lines), "t", 8, 3, 1)


@query()
def spectral_embedding(spark, d):
    """Eigenvectors of the normalised adjacency by absolute value, scaled by the roots of the values, rows of length 1."""
    return spectra.spectral_embedding(_symmetric(spark, d), 8, block=32, basis=512, tolerance=1e-6)


@query()
def edge_sampling_vectors(spark, d):
    """Vectors of parts by sampled edges and negatives, on strata of blocks."""
    return L.edge_embeddings(_edges(spark, d), 8, epochs=2)


@query()
def sparsifier_vectors(spark, d):
    """The sparsifier of sampled paths, factorised."""
    return factor.sparsifier_embedding(_edges(spark, d), 4, window=3, rounds=2, block=32, basis=512, tolerance=1e-4)


@query("""WITH pe AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL GROUP BY ALL),
s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM pe), c AS (SELECT dst, pow(sum(p), 0.75) AS c FROM s GROUP BY 1) SELECT src, s.dst, round(ln(p) - ln(c / (SELECT sum(c) FROM c)), 6) + 0.0 AS w FROM s JOIN c ON c.dst = s.dst""")
def proximity_cells(spark, d):
    """Logs of edge shares less those of their ends."""
    return rounded(factor.proximity_matrix(_edges(spark, d)))


@query()
def propagated_vectors(spark, d):
    """The factorised proximity matrix, propagated and rescaled."""
    return factor.propagated_embedding(_edges(spark, d), 4, order=4, block=32, basis=512, tolerance=1e-4)


@query()
def positional_vectors(spark, d):
    """Eigenvectors of the largest values of the normalised adjacency, rows of length 1, filled with zeros."""
    return spectra.positional_vectors(_symmetric(spark, d), 6, 8, block=32, basis=512, tolerance=1e-6)


@query("SELECT CAST(k AS BIGINT) AS place, true AS unit, true AS eigen, CASE WHEN k = 0 THEN 1.0 END AS known FROM range(4) t(k)")
def eigen_residuals(spark, d):
    """Eigenpairs of the part graph, whose largest value is 1, by what the matrix makes of the vectors."""
    a = _symmetric(spark, d)
    found = spectra.eigenpairs(a, 4, block=32, basis=512, tolerance=1e-8)
    kept = spectra.Spectrum(found.values, cut(found.vectors), found.residuals, found.steps)
    r = spectra.residuals(a, kept)
    return rounded(r.select("place", (F.abs(F.col("length") - 1) < 1e-9).alias("unit"), (F.col("residual") < 1e-6).alias("eigen"), F.when(F.col("place") == 0, F.round("value", 6)).alias("known")))
