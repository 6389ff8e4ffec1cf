"""Fusion, group statistics, windows, sampling and scalar queries over the order and event tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions import vectors as V
from quillon.operators import ranking as R
from quillon.operators import tables as O
from quillon.operators import tiles as B
from quillon.plans.registry import query, r6, rounded
from quillon.sources.tables import cut, table

WEIGHTS = {"m1": 0.16, "m2": 0.16, "m3": 0.16, "m4": 0.16, "m5": 0.16, "m6": 0.2}

_MODELS = """
scores AS (
  SELECT 'm1' AS model, o_custkey AS author_id, o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 11 <> 0
  UNION ALL SELECT 'm2', o_custkey, o_orderkey, CAST(o_orderkey % 97 AS DOUBLE) FROM orders WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT 'm3', o_custkey, o_orderkey, o_totalprice * 2 + o_orderkey % 13 FROM orders
  UNION ALL SELECT 'm4', o_custkey, o_orderkey, CAST(o_orderkey % 31 AS DOUBLE) FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT 'm5', o_custkey, o_orderkey, -o_totalprice FROM orders
  UNION ALL SELECT 'm6', o_custkey, o_orderkey, CAST(o_orderkey % 17 AS DOUBLE) FROM orders),
normal AS (
  SELECT model, author_id, id, CASE WHEN max(score) OVER w <> min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END AS score
  FROM scores WINDOW w AS (PARTITION BY model, author_id))"""


def _model_scores(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("author_id"), F.col("o_orderkey").alias("id"), "o_totalprice")
    k = F.col("id")
    made = F.array(
        F.when((k % 7 != 0) & (F.col("author_id") % 11 != 0), F.struct(F.lit("m1").alias("model"), F.col("o_totalprice").alias("score"))),
        F.when(k % 5 != 0, F.struct(F.lit("m2").alias("model"), (k % 97).cast("double").alias("score"))),
        F.struct(F.lit("m3").alias("model"), (F.col("o_totalprice") * 2 + k % 13).alias("score")),
        F.when(k % 3 != 0, F.struct(F.lit("m4").alias("model"), (k % 31).cast("double").alias("score"))),
        F.struct(F.lit("m5").alias("model"), (-F.col("o_totalprice")).alias("score")),
        F.struct(F.lit("m6").alias("model"), (k % 17).cast("double").alias("score")),
    )
    return o.select("author_id", "id", F.explode(F.array_compact(made)).alias("s")).select("s.model", "author_id", "id", "s.score")


@query(f"""WITH {_MODELS},
led AS (SELECT DISTINCT author_id, id FROM normal WHERE model IN ('m1', 'm2') AND author_id IN (SELECT author_id FROM normal WHERE model = 'm1')),
wide AS (SELECT author_id, id, sum(score * CASE WHEN model = 'm6' THEN 0.2 ELSE 0.16 END) AS score FROM normal GROUP BY ALL)
SELECT author_id, id, round(score, 6) AS score FROM wide SEMI JOIN led USING (author_id, id)""")
def fuse_scores(spark, d):
    """Min-max by model and author, weighted sum, missing models 0, items of two leading models."""
    return rounded(O.fuse(_model_scores(spark, d), WEIGHTS, ["m1", "m2"]))


@query("""SELECT o_custkey, o_orderkey, round(CASE WHEN max(o_totalprice) OVER w <> min(o_totalprice) OVER w
 THEN (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) ELSE 0.0 END, 6) AS score
FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def minmax_by_group(spark, d):
    """A09."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"))
    return rounded(O.min_max(o, ["o_custkey"]))


@query("""SELECT o_custkey, count(*) AS n_rows, count(o_orderstatus) AS o_orderstatus_count, count(DISTINCT o_orderstatus) AS o_orderstatus_nunique,
 count(o_orderpriority) AS o_orderpriority_count, count(DISTINCT o_orderpriority) AS o_orderpriority_nunique,
 round(max(o_totalprice), 6) AS o_totalprice_max, round(min(o_totalprice), 6) AS o_totalprice_min, round(avg(o_totalprice), 6) AS o_totalprice_mean,
 round(stddev_samp(o_totalprice), 6) AS o_totalprice_std, round(sum(o_totalprice), 6) AS o_totalprice_sum
FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1""")
def group_statistics(spark, d):
    """A01."""
    return rounded(O.group_stats(table(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]))


@query("""WITH k AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS grp FROM orders),
s AS (SELECT grp, count(*) AS n, avg(o_totalprice) AS m FROM k WHERE grp IS NOT NULL GROUP BY 1)
SELECT o_orderkey, k.grp, s.n AS grp_n_rows, round(s.m, 6) AS grp_o_totalprice_mean FROM k LEFT JOIN s ON k.grp = s.grp""")
def group_statistics_joined(spark, d):
    """Statistics back on their rows; a null key has none."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("grp"))
    made = O.with_group_stats(o, "grp", numeric=["o_totalprice"], stats=["mean"])
    return rounded(made.select("o_orderkey", "grp", "grp_n_rows", "grp_o_totalprice_mean"))


@query("""SELECT o_custkey, round(max(r), 6) AS r_max, round(min(r), 6) AS r_min, round(avg(r), 6) AS r_mean, round(stddev_samp(r), 6) AS r_std, round(sum(r), 6) AS r_sum,
 round(max(q), 6) AS q_max, round(min(q), 6) AS q_min, round(avg(q), 6) AS q_mean, round(stddev_samp(q), 6) AS q_std, round(sum(q), 6) AS q_sum, count(*) AS n_rows
FROM (SELECT o_custkey, o_totalprice / (o_orderkey % 50 + 1) AS r, sqrt(o_totalprice) AS q FROM orders) GROUP BY 1""")
def derived_statistics(spark, d):
    """Five statistics of derived columns in one pass."""
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / (F.col("o_orderkey") % 50 + 1)).alias("r"), F.sqrt("o_totalprice").alias("q"))
    return rounded(O.group_stats(o, "o_custkey", numeric=["r", "q"]))


@query("""SELECT o_orderkey, round(avg(o_totalprice) OVER w, 6) AS o_custkey_o_orderstatus_o_totalprice_mean, round(sum(o_totalprice) OVER w, 6) AS o_custkey_o_orderstatus_o_totalprice_sum
FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus)""")
def composite_key_transform(spark, d):
    """W02."""
    o = O.transformed(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_totalprice"])
    return rounded(o.select("o_orderkey", "o_custkey_o_orderstatus_o_totalprice_mean", "o_custkey_o_orderstatus_o_totalprice_sum"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) AS BIGINT) AS rank FROM c
QUALIFY rank <= 2""")
def top_two_values(spark, d):
    """Most frequent values, ties by first appearance."""
    return rounded(O.top_values(table(spark, d, "events"), "user_id", "event_type", "event_id", 2))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events WHERE event_type <> 'error' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) AS rank FROM c)
SELECT user_id, max(event_type) FILTER (rank = 1) AS top1, max(event_type) FILTER (rank = 2) AS top2 FROM k GROUP BY 1""")
def top_entities(spark, d):
    """The two most frequent, one value excluded."""
    e = table(spark, d, "events").filter("event_type <> 'error'")
    lists = O.top_lists(e, "user_id", "event_type", "event_id", 2)
    return lists.select("user_id", F.get("top", F.lit(0)).alias("top1"), F.get("top", F.lit(1)).alias("top2"))


@query("""SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, f, event_type) - 1 AS BIGINT) AS index FROM (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1)""")
def vocabulary_index(spark, d):
    """A28."""
    return O.vocabulary(table(spark, d, "events"), "event_type", "event_id")


@query("""SELECT conv_id, string_agg(role, ' ' ORDER BY turn, role) AS role FROM conversations GROUP BY 1""")
def concatenated_lists(spark, d):
    """A05, P: ordered concatenation by group."""
    return O.concatenated(table(spark, d, "conversations"), "conv_id", "role", "turn")


@query("SELECT CAST(quality AS BIGINT) AS quality, count(*) AS count FROM labels GROUP BY 1")
def value_counts(spark, d):
    """A13."""
    return rounded(table(spark, d, "labels").groupBy("quality").count())


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, round(avg(o_totalprice * (f + 1)), 6) AS prob FROM orders, (SELECT unnest(range(5)) AS f) GROUP BY 1""")
def fold_mean(spark, d):
    """The mean over folds."""
    o = table(spark, d, "orders").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return rounded(o.groupBy("o_orderkey").agg(F.avg(F.col("o_totalprice") * (F.col("f") + 1)).alias("prob")))


@query("""SELECT p_brand AS feature, round(avg(p_retailprice), 6) AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_importance(spark, d):
    """Mean importance, the ten largest (a top-k report)."""
    return rounded(table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance")).orderBy(F.desc(F.round("importance", 6)), "feature").limit(10))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20")
def head_rows(spark, d):
    """The first rows in an explicit order."""
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(20)


@query("""SELECT c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey, printf('%.4f±%.4f', avg(x), stddev_pop(x)) AS summary FROM (SELECT *, c_acctbal / 7.0 AS x FROM customer) GROUP BY ALL""")
def metric_table(spark, d):
    """A30."""
    from quillon.operators.evaluate import mean_and_deviation

    return rounded(mean_and_deviation(table(spark, d, "customer").withColumn("x", F.col("c_acctbal") / 7), ["c_mktsegment", "c_nationkey"], "x"))


# ------------------------------------------------------------------ joins


@query("""SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 10 <> 0""")
def rows_with_dimension(spark, d):
    """Left join of a fact with a dimension; unmatched rows stay."""
    c = table(spark, d, "customer").filter("c_custkey % 10 <> 0").withColumnRenamed("c_custkey", "o_custkey")
    return table(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("""SELECT o.o_orderkey, a.n_lines, round(b.revenue, 6) AS revenue, e.n_status FROM orders o
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) a ON a.l_orderkey = o.o_orderkey
LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS revenue FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.l_orderkey = o.o_orderkey
LEFT JOIN (SELECT o_orderstatus, count(*) AS n_status FROM orders GROUP BY 1) e ON e.o_orderstatus = o.o_orderstatus""")
def feature_families_merged(spark, d):
    """Several families joined on their keys; two families of one key share its exchange."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("revenue"))
    e = o.groupBy("o_orderstatus").agg(F.count("*").alias("n_status"))
    return rounded(o.join(a, "o_orderkey", "left").join(e, "o_orderstatus", "left").select("o_orderkey", "n_lines", "revenue", "n_status"))


@query("""SELECT a.user_id, a.event_id AS target, count(b.event_id) AS others, CAST(sum(b.event_id % 10) AS BIGINT) AS checksum FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.event_type = 'purchase' GROUP BY ALL""")
def other_items_of_group(spark, d):
    """Every target with all other items of its group."""
    e = table(spark, d, "events")
    target = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("target"))
    whole = e.groupBy("user_id").agg(F.count("event_id").alias("n"), F.sum(F.col("event_id") % 10).alias("s"))  # a group's sums less the own row's: no pairs
    return target.join(whole, "user_id").filter("n > 1").select("user_id", "target", (F.col("n") - 1).alias("others"), (F.col("s") - F.col("target") % 10).alias("checksum"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_join(spark, d):
    """J12, U04."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT c_mktsegment AS k FROM customer)""")
def distinct_relabelled(spark, d):
    """A31, P19."""
    return O.dense_positions(table(spark, d, "customer").select(F.col("c_mktsegment").alias("k")).distinct(), [F.asc("k")], "code")


@query("""WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part))
SELECT p_partkey, CAST(code AS BIGINT) AS p_brand_code FROM part JOIN c USING (p_brand)""")
def label_encoder(spark, d):
    """One fit for all rows."""
    return O.label_codes(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "p_brand_code")


@query("""SELECT o_orderkey AS k, 'orders' AS src FROM orders UNION ALL SELECT l_orderkey, 'lines' FROM lineitem""")
def bag_union(spark, d):
    """U01."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("orders").alias("src")).unionByName(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("lines").alias("src")))


@query("""SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer""")
def key_union(spark, d):
    """U02, U05."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").select("c_custkey")).distinct()


@query("""SELECT l_orderkey, CAST(len(list_intersect(list_distinct(list(l_returnflag)), ['A', 'R'])) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def array_intersection(spark, d):
    """U03."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return rounded(li.select("l_orderkey", F.size(F.array_intersect("f", F.array(F.lit("A"), F.lit("R")))).alias("n")))


# ------------------------------------------------------------------ windows


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id) AS a,
 sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS r FROM conversations)
SELECT conv_id, turn, CAST(n AS BIGINT) AS n FROM t WHERE a <= 600 OR r < 600""")
def budget_prefix(spark, d):
    """Running budget; a row that reaches it goes, a group within it stays whole."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"))
    return rounded(O.within_budget(c, ["conv_id"], ["turn"], "n", 600))


_HOURLY = "SELECT event_type AS s, date_trunc('hour', ts) AS h, sum(value) AS v FROM events GROUP BY ALL"


@query(f"""WITH t AS ({_HOURLY}), w AS (SELECT s, h, list(v) OVER (PARTITION BY s ORDER BY h ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS x,
 lead(v, 7) OVER (PARTITION BY s ORDER BY h) AS y, row_number() OVER (PARTITION BY s ORDER BY h) AS p, count(*) OVER (PARTITION BY s) AS n FROM t)
SELECT s, h, round(list_sum(x), 6) AS x_sum, CAST(len(x) AS BIGINT) AS x_len, round(y, 6) AS y FROM w WHERE p <= n - 6 - 2""")
def history_windows(spark, d):
    """Six past values and the one two steps on."""
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("s"), F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("v"))
    w = O.history_windows(t, ["s"], "h", "v", 6, 2)
    return rounded(w.select("s", "h", V.total(F.col("x")).alias("x_sum"), F.size("x").alias("x_len"), "y"))


@query(f"""WITH t AS ({_HOURLY}), w AS (SELECT s, h, row_number() OVER (PARTITION BY s ORDER BY h) AS p, count(*) OVER (PARTITION BY s) AS n FROM t)
SELECT s, h, CASE WHEN p <= round_even(n * 0.8, 0) THEN 'train' WHEN p <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM w""")
def chronological_split(spark, d):
    """W08."""
    t = table(spark, d, "events").select(F.col("event_type").alias("s"), F.date_trunc("hour", "ts").alias("h")).distinct()
    return O.chronological_split(t, ["s"], "h")


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS pos FROM orders""")
def positions_in_group(spark, d):
    """W04."""
    return rounded(table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("pos")))


@query("""SELECT c_mktsegment, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rank FROM customer""")
def confidence_rank(spark, d):
    """W06."""
    return rounded(table(spark, d, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank")))


@query("""WITH w AS (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS p FROM events)
SELECT a.event_type AS centre, b.event_type AS context, count(*) AS n FROM w a JOIN w b ON a.user_id = b.user_id AND abs(a.p - b.p) BETWEEN 1 AND 2 GROUP BY ALL""")
def skip_gram_pairs(spark, d):
    """Pairs at most two places apart."""
    w = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("p"))
    return O.pair_windows(w, "user_id", "p", "event_type", 2).groupBy("centre", "context").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT user_id, event_id AS node, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
r AS (SELECT a.node AS x, b.node AS y, b.kind, string_agg(c.kind, '>' ORDER BY c.p) AS path FROM w a JOIN w b ON a.user_id = b.user_id AND b.p - a.p BETWEEN 1 AND 2 JOIN w c ON c.user_id = a.user_id AND c.p BETWEEN a.p AND b.p GROUP BY ALL),
i AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS relation FROM (SELECT DISTINCT path FROM r)),
o AS (SELECT event_id AS node, event_type AS kind, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events), s AS (SELECT DISTINCT kind, n FROM o),
d AS (SELECT x, y, path, kind, CAST('0x' || substr(md5('t|' || x || '|' || y || '|' || path), 1, 15) AS BIGINT) % n AS k FROM r JOIN s USING (kind))
SELECT x, y, CAST(relation AS BIGINT) AS relation, path, o.node AS negative FROM d JOIN i USING (path) JOIN o USING (kind, k)""")
def typed_pair_windows(spark, d):
    """Pairs up to two hops apart in a walk, their relation (the path of types, numbered), and a drawn node of the same type."""
    e = table(spark, d, "events")
    walk = e.select("user_id", F.col("event_id").alias("node"), F.col("event_type").alias("kind"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("p"))
    nodes = e.select(F.col("event_id").alias("node"), F.col("event_type").alias("kind"))
    return rounded(O.typed_pairs(walk, "user_id", "p", "node", "kind", 2, nodes, "t"))


@query("""SELECT src, CAST(coalesce(sum(n) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pointer, n FROM (SELECT l_suppkey AS src, count(*) AS n FROM lineitem GROUP BY 1)""")
def row_pointers(spark, d):
    """Cumulative counts by node, for export."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src")).agg(F.count("*").alias("n"))
    return O.running_total(n, [F.asc("src")], "n", "pointer").select("src", "pointer", "n")


# ------------------------------------------------------------------ samples


@query("""WITH l AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('s|' || doc_id), doc_id) AS r FROM labels)
SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM l WHERE quality = 0 OR r <= (SELECT count(*) FROM labels WHERE quality = 0)""")
def under_sample(spark, d):
    """K08."""
    return rounded(O.under_sampled(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 1.0, "s"))


@query("""SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('k|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 5""")
def sampled_by_group(spark, d):
    """Five rows of each group in md5 order."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return rounded(O.first_by_hash(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 5, "k"))


@query("""WITH h AS (SELECT o_orderkey, CAST('0x' || substr(md5('x|' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM orders)
SELECT o_orderkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM h""")
def hash_split(spark, d):
    """A split by hash, without an order."""
    return O.hash_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], {"train": 0.8, "val": 0.1, "test": 0.1}, "x").select("o_orderkey", "split")


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, avg(CAST(o_orderstatus = 'F' AS INT)) AS share FROM orders GROUP BY 1)
SELECT o_custkey, CAST((row_number() OVER (PARTITION BY floor(log2(n)), round(share, 1) ORDER BY md5('0|' || o_custkey), o_custkey) - 1) % 5 AS BIGINT) AS fold FROM g""")
def group_folds(spark, d):
    """Whole groups in five folds with like label shares."""
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(O.group_folds(o, "o_custkey", "y"))


@query("""WITH h AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
u AS (SELECT *, (CAST('0x' || substr(md5('w|' || l_partkey), 1, 12) AS BIGINT) + 1) / 281474976710657.0 AS u FROM h)
SELECT l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY -ln(u) / w, l_partkey) AS r FROM u) WHERE r <= 5""")
def weighted_sample(spark, d):
    """In proportion to weight, without replacement, by an exponential race."""
    h = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("w"))
    return O.weighted_sample(h, ["l_suppkey"], ["l_partkey"], "w", 5, "w").select("l_suppkey", "l_partkey")


@query("""SELECT CAST(p_partkey % 7 AS BIGINT) AS k, CAST(max(p_size) AS BIGINT) AS s FROM part GROUP BY 1""")
def downcast_columns(spark, d):
    """The narrowest whole-number type that holds a column's range, without loss."""
    p = O.downcast(table(spark, d, "part").select("p_partkey", "p_size"), ["p_partkey", "p_size"])
    return rounded(p.groupBy((F.col("p_partkey") % 7).alias("k")).agg(F.max("p_size").alias("s")))


# ------------------------------------------------------------------ scalars


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round(l_extendedprice / nullif(l_discount, 0), 6) AS ratio, round(l_extendedprice - l_quantity, 6) AS diff,
 round(l_extendedprice * l_quantity, 6) AS product, round(l_quantity ** 2, 6) AS square, round(sqrt(l_extendedprice), 6) AS root, round(l_tax / (l_quantity + 0.001), 6) AS guarded FROM lineitem""")
def arithmetic_features(spark, d):
    """Ratios (null for a zero divisor), differences, products, powers."""
    li = table(spark, d, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return rounded(li.select("l_orderkey", "l_linenumber", "l_partkey", F.try_divide(p, F.col("l_discount")).alias("ratio"), (p - q).alias("diff"), (p * q).alias("product"), F.pow(q, 2).alias("square"), F.sqrt(p).alias("root"), (F.col("l_tax") / (q + 0.001)).alias("guarded")))


@query("""SELECT o_orderkey, concat_ws('_', o_custkey, year(o_orderdate)) AS key, CAST(2024 - year(o_orderdate) AS BIGINT) AS year_now, isodow(o_orderdate) < 6 AS workday FROM orders""")
def keys_and_dates(spark, d):
    """P07, P08, P37."""
    o = table(spark, d, "orders")
    y = F.year("o_orderdate")
    return rounded(o.select("o_orderkey", X.composite_key(F.col("o_custkey").cast("string"), y.cast("string")).alias("key"), (2024 - y).alias("year_now"), (F.weekday("o_orderdate") < 5).alias("workday")))


@query("""SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels WHERE quality <> -1 AND toxic = 0""")
def rows_by_label(spark, d):
    """P21."""
    return rounded(table(spark, d, "labels").filter("quality <> -1 and toxic = 0").select("doc_id", "quality"))


@query("""SELECT vec_id, round(x / nullif(x + y, 0), 6) AS score FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)""")
def yes_share(spark, d):
    """Raw score of yes over yes and no."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rounded(e.select("vec_id", X.yes_share(F.col("x"), F.col("y")).alias("score")))


@query("""WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem WHERE l_returnflag = 'N')
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round((l_quantity - m) / nullif(sd, 0), 6) AS l_quantity FROM lineitem, s""")
def standard_scaling(spark, d):
    """Population deviation, fitted on a slice."""
    from quillon.operators.features import standard_scaled

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return rounded(standard_scaled(li, ["l_quantity"], F.col("l_returnflag") == "N").drop("l_returnflag"))


@query("""SELECT o_orderstatus, list_transform(range(3), lambda i: CAST(['F','O','P'][i+1] = o_orderstatus AS BIGINT)) AS one_hot, count(*) AS n FROM orders GROUP BY ALL""")
def one_hot(spark, d):
    """P33."""
    code = F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")) - 1
    return rounded(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).select("o_orderstatus", V.one_hot(code, 3).alias("one_hot"), "n"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, CAST((n_nationkey + 7) % 25 AS BIGINT) AS shifted FROM nation""")
def cycle_index(spark, d):
    """P34."""
    return rounded(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") + 7) % 25).alias("shifted")))


_SCALARS = "SELECT c_custkey, c_acctbal / 5000 - 0.5 AS v FROM customer"


@query(f"""SELECT c_custkey, round(v, 6) AS linear, round(greatest(v, 0), 6) AS relu, round(least(greatest(v, 0), 6), 6) AS relu6, round(CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END, 6) AS elu,
 round(CASE WHEN v > 0 THEN v ELSE v * 0.01 END, 6) AS leaky_relu, round(1 / (1 + exp(-v)), 6) AS sigmoid, round((exp(v) - exp(-v)) / (exp(v) + exp(-v)), 6) AS tanh, round(ln(1 + exp(v)), 6) AS softplus,
 round(least(greatest(v, -0.2), 0.8), 6) AS clamped FROM ({_SCALARS})""")
def activations(spark, d):
    """P31, P32."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 5000 - 0.5).alias("v"))
    return rounded(c.select("c_custkey", *(f(F.col("v")).alias(n) for n, f in V.ACTIVATIONS.items()), V.clamped(F.col("v"), -0.2, 0.8).alias("clamped")))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round(-p * ln(p + 1e-9) - (1 - p) * ln(1 - p + 1e-9), 6) AS entropy FROM (SELECT *, l_discount * 5 AS p FROM lineitem)""")
def binary_entropy(spark, d):
    """P30."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 5).alias("p"))
    return rounded(li.select("l_orderkey", "l_linenumber", "l_partkey", V.binary_entropy(F.col("p")).alias("entropy")))


@query("""WITH p AS (SELECT s_suppkey AS id, s_acctbal / 200 AS lat, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey * 5.0 END AS lon FROM supplier),
q AS (SELECT a.id AS a, b.id AS b, radians(a.lat) AS y1, radians(b.lat) AS y2, radians(coalesce(a.lon, 0)) AS x1, radians(coalesce(b.lon, 0)) AS x2 FROM p a, p b WHERE a.id <> b.id),
m AS (SELECT a, b, 2 * 6371008.8 * asin(sqrt(least(sin((y2 - y1) / 2) ** 2 + cos(y1) * cos(y2) * sin((x2 - x1) / 2) ** 2, 1))) AS d FROM q),
s AS (SELECT stddev_pop(d) AS s FROM m)
SELECT a, b, round(exp(-((d / s) ** 2)), 6) AS w FROM m, s WHERE exp(-((d / s) ** 2)) >= 0.1""")
def station_kernel(spark, d):
    """Pairwise station distances in blocks, Gaussian weights of at least 0.1.

    All ordered pairs of stations are what the operator is asked for.  They are
    worked out twice, for the deviation and for the weights, and never written.
    """
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 200).alias("lat"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey") * 5.0).alias("lon"))
    return rounded(B.station_weights(p, 0.1))


@query("""WITH t AS (SELECT date_trunc('day', ts) AS day, event_type, avg(value) AS v FROM events GROUP BY ALL)
SELECT day, round(max(v) FILTER (event_type = 'click'), 6) AS click, round(max(v) FILTER (event_type = 'error'), 6) AS error, round(max(v) FILTER (event_type = 'view'), 6) AS view FROM t GROUP BY 1""")
def pivot_mean(spark, d):
    """Time by series, means."""
    t = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).pivot("event_type", ["click", "error", "view"]).agg(F.avg("value"))
    return rounded(t)


@query("""SELECT event_type, bucket, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM (SELECT event_type, CAST(user_id % 3 AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL)""")
def cross_table(spark, d):
    """A25."""
    n = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("bucket")).agg(F.count("*").alias("n"))
    return n.select("event_type", "bucket", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy("event_type"))).alias("share"))


@query("""SELECT o_custkey AS author_id, CAST('{' || string_agg('"' || o_orderkey || '":' || CAST(o_orderkey % 10 AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) || '}' AS VARCHAR) AS scores FROM orders GROUP BY 1""")
def score_json(spark, d):
    """Nested score objects, by key."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("author_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 10).alias("score"))
    return O.score_maps(o)
