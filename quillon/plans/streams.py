"""Event-window and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans.registry import query, rounded
from quillon.sources import tables as S
from quillon.sources.tables import table
from quillon.streaming import windows as W


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def hourly_windows(spark, d):
    """Tumbling windows over events."""
    return rounded(W.tumbling(table(spark, d, "events"), ["event_type"], "value"))


@query("""WITH e AS (SELECT *, time_bucket(INTERVAL '30 minutes', ts) AS b FROM events), x AS (SELECT event_type, value, b AS window_start FROM e UNION ALL SELECT event_type, value, b - INTERVAL '30 minutes' FROM e)
SELECT window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM x GROUP BY ALL""")
def sliding_windows(spark, d):
    """Windows of an hour every half hour."""
    return rounded(W.tumbling(table(spark, d, "events"), ["event_type"], "value", "1 hour", "30 minutes"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    """Sessions by half an hour of inactivity."""
    return W.sessions(table(spark, d, "events"), ["user_id"])


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(spark, d):
    """A declared schema over JSON text."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


@query("""WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS author_id, 'Customer ' || o_custkey AS author_name, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS label FROM orders)
SELECT author_id, author_name, CAST(o_orderkey AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY author_id ORDER BY label DESC, CAST(o_orderkey AS VARCHAR)) - 1 AS BIGINT) AS pos, CAST(label AS BIGINT) AS label FROM a""")
def author_rows(spark, d):
    """Dictionaries of lists as labelled rows, in the lists' order."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("author_id"))
    ids = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("o_orderkey").cast("string"))))
    a = o.agg(ids(F.col("o_orderstatus") != "F").alias("normal_data"), ids(F.col("o_orderstatus") == "F").alias("outliers"))
    a = a.select("author_id", F.concat(F.lit("Customer "), "author_id").alias("name"), "normal_data", "outliers", F.lit(None).cast("array<string>").alias("papers"))
    return rounded(S.unpivot_authors(a))


@query("""SELECT o_orderkey, o_orderkey % 10 < 7 AS train, o_orderkey % 10 = 7 AS val, o_orderkey % 10 > 7 AS test FROM orders""")
def split_masks(spark, d):
    """Roles as three masks."""
    k = F.col("o_orderkey") % 10
    o = table(spark, d, "orders").select("o_orderkey", F.when(k < 7, "train").when(k == 7, "val").otherwise("test").alias("role"))
    return S.split_masks(o).drop("role")
