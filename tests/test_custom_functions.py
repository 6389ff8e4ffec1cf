"""A user's own functions over groups, against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import custom as C
from quillon.plans import registry
from quillon.sources.tables import table


def test_states_merge_to_the_whole_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(x)) for k in ("a", "b") for x in rng.exponential(size=500)] + [("c", 2.0), ("c", 2.0), ("d", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double").withColumn("n", F.lit(7)).repartition(5)
    got = {r["k"]: (r["n"], r["skew"]) for r in C.merged_groups(df, ["k"], C.moments("k", "x"), "k string, n long, s1 double, s2 double, s3 double, s4 double", {"n": F.sum("n"), "skew": C.skewness()}).collect()}
    for k in "ab":
        x = np.array([v for key, v in rows if key == k])
        assert got[k] == (500, pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3))
    assert got["c"] == (2, 0.0) and got["d"] == (0, None) and got[None][0] == 1
    empty = C.merged_groups(df.limit(0), ["k"], C.moments("k", "x"), "k string, n long, s1 double, s2 double, s3 double, s4 double", {"n": F.sum("n")})
    assert empty.count() == 0


def test_mapped_groups(spark):
    df = spark.range(20).select((F.col("id") % 3).alias("k"), "id")
    f = lambda t: pa.table({"k": t["k"][:1], "n": [t.num_rows]})
    assert sorted(map(tuple, C.mapped_groups(df, ["k"], f, "k long, n long").collect())) == [(0, 7), (1, 7), (2, 6)]


def test_groups_streamed_in_order(spark):
    rows = [(k, float(t * t % 50_000), t, float(t % 4) if t % 5 else None) for k in ("a", "b") for t in range(300)]
    df = spark.createDataFrame(rows, "key string, at double, id long, value double").repartition(4)
    got = {(r["key"], r["id"]): r["total"] for r in C.streamed_groups(df, ["key"], ["at", "id"], C.Decayed, "key string, at double, id long, total double").collect()}
    assert len(got) == len(rows)
    for key in ("a", "b"):
        total, last = 0.0, None
        for _, at, i, value in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            total = total * 0.5 ** ((at - last) / 86_400 if last is not None else 0) + (value or 0)
            last = at
            assert got[key, i] == pytest.approx(total)


def test_decayed_activity_of_all_events(spark, sf):
    got = {r["event_id"]: r["total"] for r in registry.queries()["decayed_activity"](spark, sf).collect()}
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value").collect()
    users, expected = {}, {}
    for r in sorted(events, key=lambda r: (r["ts"], r["event_id"])):
        total, last = users.get(r["user_id"], (0.0, r["ts"]))
        users[r["user_id"]] = (total * 0.5 ** ((r["ts"] - last).total_seconds() / 86_400) + float(r["value"] or 0.0), r["ts"])
        expected[r["event_id"]] = users[r["user_id"]][0]
    assert got == pytest.approx(expected, abs=2e-6)
