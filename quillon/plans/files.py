"""Readers, sinks and applications: what is written to the shared folder and read back, and runs by name."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import custom as C
from quillon.operators import evaluate as E
from quillon.operators import features as M
from quillon.operators import tables as O
from quillon.plans import facade as A
from quillon.plans.registry import query, rounded
from quillon.plans.similarity import _AUC, _SCORED, _scored
from quillon.sources import tables as S
from quillon.sources.tables import new_path, table


@query("""SELECT conv_id, list(text ORDER BY turn, text) AS texts, max(turn) = min(turn) AS single FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1""")
def csv_round_trip(spark, d):
    """Nested columns through CSV."""
    c = table(spark, d, "conversations").filter("conv_id is not null").groupBy("conv_id")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    df, to = c.agg(texts.alias("texts"), (F.max("turn") == F.min("turn")).alias("single")), new_path(spark, "csv")
    S.write_csv(df, to)
    return S.read_csv(spark, to, df.schema)


@query("SELECT o_custkey AS author_id, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders GROUP BY 1")
def family_files(spark, d):
    """A feature family as a stage's file."""
    to = new_path(spark, "family")
    S.write_family(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("author_id")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), to)
    return rounded(spark.read.parquet(to))


@query("SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS scaled FROM customer")
def model_files(spark, d):
    """A fitted model, saved and loaded."""
    from pyspark.ml.feature import MinMaxScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    c = table(spark, d, "customer").select("c_custkey", array_to_vector(F.array(F.col("c_acctbal").cast("double"))).alias("v"))
    to = new_path(spark, "model")
    M.save_model(MinMaxScaler(inputCol="v", outputCol="s").fit(c), to)
    return rounded(M.load_model(to).transform(c).select("c_custkey", F.get(vector_to_array("s"), F.lit(0)).alias("scaled")))


_SCORES = "SELECT CAST(l_suppkey AS VARCHAR) AS author_id, CAST(l_partkey AS VARCHAR) AS id, max(l_discount) AS score FROM lineitem GROUP BY ALL"


def _scores(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("author_id"), F.col("l_partkey").alias("id"), F.col("l_discount").cast("double").alias("score"))


@query(_SCORES)
def score_lines(spark, d):
    """One object a line; of several scores of a key one wins."""
    to = new_path(spark, "scores")
    S.write_scores(_scores(spark, d), to)
    return S.read_scores(spark, to)


@query(_SCORES)
def score_object(spark, d):
    """The whole as one indented object."""
    to = new_path(spark, "object")
    S.write_score_object(_scores(spark, d), to)
    return S.read_scores(spark, to, wholetext=True)


@query("SELECT n_nationkey AS src, CAST(n_regionkey AS BIGINT) AS dst, CAST(1 + n_nationkey % 3 AS DOUBLE) AS w FROM nation")
def adjacency_file(spark, d):
    """A compressed-row matrix in a .npz file (one small file made here)."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows
    lines = np.array([r[0] for r in rows])
    pointers = np.concatenate([[0], np.cumsum(np.bincount(lines, minlength=lines.max() + 1))])
    out, to = io.BytesIO(), new_path(spark, "adjacency") + ".npz"
    np.savez(out, data=1.0 + lines % 3, indices=np.array([r[1] for r in rows]), indptr=pointers)
    S.write_bytes(spark, to, out.getvalue())
    return S.read_adjacency(spark, to)


@query("""WITH n AS (SELECT c_nationkey AS g, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS node FROM customer), f AS (SELECT g, min(node) AS first FROM n GROUP BY 1)
SELECT CAST(a.g + 1 AS BIGINT) AS graph_id, a.node - first AS src, b.node - first AS dst FROM n a JOIN n b ON a.g = b.g AND b.node = a.node + 1 JOIN f ON f.g = a.g""")
def collection_files(spark, d):
    """Graphs in line files of several parts, the customers of a nation in a row."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    n = O.dense_positions(c, [F.asc("c_nationkey"), F.asc("c_custkey")], "k")
    base = new_path(spark, "collection")
    n.repartitionByRange(4, "k").sortWithinPartitions("k").select((F.col("c_nationkey") + 1).cast("string").alias("value")).write.text(f"{base}/indicator")
    ahead = n.join(n.select(F.col("c_nationkey").alias("g"), (F.col("k") - 1).alias("k")), "k").filter("c_nationkey = g")
    ahead.select(F.concat_ws(", ", F.col("k") + 1, F.col("k") + 2).alias("value")).write.text(f"{base}/edges")
    return rounded(S.read_collection(spark, f"{base}/edges", f"{base}/indicator")[1])


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, o_orderkey FROM orders)
SELECT l_partkey AS id, list(line ORDER BY line) AS labels FROM (SELECT DISTINCT l_partkey, line FROM lineitem JOIN o ON l_orderkey = o_orderkey) GROUP BY 1""")
def community_files(spark, d):
    """Communities in line files of several parts, the parts of an order on a line."""
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(" ", F.collect_set(F.col("l_partkey").cast("string"))).alias("value"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(parts, "l_orderkey", "left")
    to = new_path(spark, "communities")
    o.repartitionByRange(5, "l_orderkey").sortWithinPartitions("l_orderkey").select(F.coalesce("value", F.lit("")).alias("value")).write.text(to)
    return S.community_labels(S.numbered_lines(spark.read.text(to)))


#: Entries of a JSON object that one task holds as a text, on average.
OBJECT = 1 << 11


def _objects(rows, key, value, least):
    """JSON objects {key: value} of about OBJECT entries each, but at least so many objects, each in a file and a task of its own."""
    count, bucket = max(least, -(-rows.count() // OBJECT)), "bucket"
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(count))).repartition(count, bucket)
    entries = F.concat_ws(", ", F.collect_list(F.concat(F.lit('"'), F.col(key).cast("string"), F.lit('": '), F.to_json(value))))
    to = new_path(rows.sparkSession, "dictionary")
    rows.groupBy(bucket).agg(F.concat(F.lit("{"), entries, F.lit("}")).alias("value")).write.partitionBy(bucket).text(to)
    return f"{to}/*/*.txt"


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text AS abstract, lang AS venue, CAST(n_chars AS BIGINT) AS year, source AS name, 1::BIGINT AS people FROM documents")
def paper_dictionary(spark, d):
    """Papers of JSON dictionaries, whole texts inside, read in byte ranges."""
    people = F.array(F.struct(F.col("source").alias("name"), F.lit("").alias("org")))
    value = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("abstract"), people.alias("authors"), F.col("lang").alias("venue"), F.col("n_chars").cast("int").alias("year"))
    path = _objects(table(spark, d, "documents"), "doc_id", value, 8)
    return S.read_papers(spark, path, 1 << 18).select("id", "abstract", "venue", F.col("year").cast("bigint").alias("year"), F.col("authors")[0]["name"].alias("name"), F.size("authors").cast("bigint").alias("people"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders),
r AS (SELECT o_custkey, o_orderkey, label, row_number() OVER (PARTITION BY o_custkey ORDER BY label DESC, o_orderkey) - 1 AS pos FROM o)
SELECT CAST(o_custkey AS VARCHAR) AS author_id, c_name AS author_name, CAST(o_orderkey AS VARCHAR) AS id, pos, CAST(label AS BIGINT) AS label FROM r JOIN customer ON c_custkey = o_custkey""")
def author_dictionary(spark, d):
    """Author dictionaries with lists of right and wrong items, read in byte ranges and unpivoted."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(*(F.transform(F.array_sort(F.collect_list(F.when(mark, F.col("o_orderkey")))), lambda k: k.cast("string")).alias(name) for name, mark in (("normal_data", F.col("o_orderstatus") == "F"), ("outliers", F.col("o_orderstatus") != "F"))))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    path = _objects(c, "c_custkey", F.struct(F.col("c_name").alias("name"), "normal_data", "outliers"), 25)
    return rounded(S.read_authors(spark, path, 1 << 16))


@query("SELECT DISTINCT l_suppkey AS h, CAST(ascii(l_returnflag) AS BIGINT) AS r, l_partkey AS t, 'train' AS split FROM lineitem")
def triples_file(spark, d):
    """S16."""
    t = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.ascii("l_returnflag").alias("r")).distinct()
    to = new_path(spark, "triples")
    t.select(F.concat_ws(" ", "l_suppkey", "l_partkey", "r").alias("value")).write.text(to)
    return S.read_triples(spark, to, "train")


@query("SELECT DISTINCT l_returnflag AS etype, l_suppkey AS u, l_partkey AS v, CAST(l_linenumber % 2 AS BIGINT) AS label, 'test' AS split FROM lineitem")
def multiplex_file(spark, d):
    """S17."""
    e = table(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_partkey", (F.col("l_linenumber") % 2).alias("label")).distinct()
    to = new_path(spark, "multiplex")
    e.select(F.concat_ws(" ", *e.columns).alias("value")).write.text(to)
    return rounded(S.read_multiplex(spark, to, "test"))


@query("SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL")
def edge_list_file(spark, d):
    """Tab-separated edges with weights."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").cast("double").alias("w"))
    to = new_path(spark, "edges")
    e.write.csv(to, sep="\t")
    return rounded(S.read_edge_list(spark, to, names=("src", "dst", "w"), kinds=("long", "long", "double")))


@query("SELECT user_id AS station, count(*) AS n, round(avg(value), 6) AS speed FROM events WHERE isodow(ts) < 6 AND value IS NOT NULL GROUP BY 1")
def readings_files(spark, d):
    """Rows of dated files, week days only."""
    e = table(spark, d, "events").select(F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("timestamp"), F.col("user_id").alias("station"), F.col("value").alias("avg_speed"), F.date_format("ts", "yyyy_MM_dd").alias("file"))
    to = new_path(spark, "readings")
    e.write.partitionBy("file").csv(to)
    got = S.read_readings(spark, f"{to}/*", "timestamp timestamp, station long, avg_speed double")
    return rounded(got.groupBy("station").agg(F.count("*").alias("n"), F.avg("avg_speed").alias("speed")))


_VIEW = "SELECT o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 10 GROUP BY o_orderstatus"


@query(_VIEW)
def sql_over_views(spark, d):
    """SQL over the registered tables."""
    S.register_views(spark, d)
    return spark.sql(_VIEW)


@query("SELECT CAST(n_regionkey AS BIGINT) AS step, CASE k WHEN 0 THEN 'nations' ELSE 'largest' END AS metric, CAST(CASE k WHEN 0 THEN count(*) ELSE max(n_nationkey) END AS DOUBLE) AS value FROM nation, range(2) t(k) GROUP BY n_regionkey, k")
def metric_log(spark, d):
    """Metrics appended step by step."""
    to = new_path(spark, "metrics")
    for r in table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("n_nationkey").alias("m")).collect():  # 5 rows
        S.append_metrics(spark, to, int(r[0]), {"nations": r["n"], "largest": r["m"]})
    return rounded(spark.read.parquet(to))


@query(f"""WITH {_SCORED}, {_AUC.format(g='g,', w='PARTITION BY g')} SELECT g, round(sum((bp + p / 2) * n) / nullif(sum(p) * sum(n), 0), 6) AS auc FROM r GROUP BY 1""")
def evaluator_by_name(spark, d):
    """An evaluator by its name."""
    return rounded(E.evaluator("auc")(_scored(spark, d), "score", "y", ["g"]))


@query("""WITH m AS (SELECT CAST(t * 10 AS BIGINT) AS threshold, f.flag, round(avg(CAST((l_quantity > t * 10) = (l_returnflag = f.flag) AS INT)), 6) AS metric FROM lineitem, range(1, 4) r(t), (SELECT unnest(['A', 'R']) AS flag) f GROUP BY ALL)
SELECT threshold, flag, metric, metric = (SELECT max(metric) FROM m) AS best FROM m""")
def experiment_grid(spark, d):
    """Every setting of a grid, and the best."""
    li = table(spark, d, "lineitem")

    def run(threshold, flag):
        return round(li.agg(F.avg(((F.col("l_quantity") > threshold) == (F.col("l_returnflag") == flag)).cast("double"))).first()[0], 6)

    results = A.experiment(run, threshold=[10, 20, 30], flag=["A", "R"])
    top = A.best(results)["metric"]
    return spark.createDataFrame([(r["threshold"], r["flag"], r["metric"], r["metric"] == top) for r in results], "threshold long, flag string, metric double, best boolean")


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n, CAST(length(regexp_replace(coalesce(text, ''), '[^aeiou]', '', 'g')) AS BIGINT) AS vowels FROM documents")
def arrow_function(spark, d):
    """Any function over Arrow batches, one row to several columns."""

    def f(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            text = pc.fill_null(b.column(1), "")
            vowels = pc.utf8_length(pc.replace_substring_regex(text, "[^aeiou]", ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.utf8_length(text).cast(pa.int64()), vowels.cast(pa.int64())], names=["doc_id", "n", "vowels"])

    return M.scored(table(spark, d, "documents").select("doc_id", "text"), f, "doc_id long, n long, vowels long")


@query("""WITH m AS (SELECT c_nationkey AS nation, count(c_acctbal) AS n, avg(c_acctbal) AS a, avg(c_acctbal * c_acctbal) AS b, avg(c_acctbal * c_acctbal * c_acctbal) AS c FROM (SELECT c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer) GROUP BY 1)
SELECT CAST(nation AS BIGINT) AS nation, n, CASE WHEN n > 0 THEN round(coalesce((c - 3 * a * b + 2 * a * a * a) / nullif(pow(greatest(b - a * a, 0), 1.5), 0), 0), 6) + 0.0 END AS skew FROM m""")
def merged_states(spark, d):
    """An aggregate of one's own, states made batch by batch before the shuffle."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").cast("double").alias("x"))
    return rounded(C.merged_groups(c, ["nation"], C.moments("nation", "x"), "nation long, n long, s1 double, s2 double, s3 double, s4 double", {"n": F.sum("n"), "skew": C.skewness()}))


@query()
def decayed_activity(spark, d):
    """A table function over each user's events in order; totals that halve every day."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.expr("CAST(CAST(ts - TIMESTAMP_NTZ'1970-01-01' AS INTERVAL SECOND) AS DECIMAL(18, 6))").cast("double").alias("at"), F.col("event_id").alias("id"), F.col("value").cast("double").alias("value"))
    kinds = dict(e.dtypes)
    got = C.streamed_groups(e, ["key"], ["at", "id"], C.Decayed, f"key {kinds['key']}, at double, id {kinds['id']}, total double")
    return rounded(got.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "total"))
