"""Tables that grow with the input are not broadcast, however small their files are."""

from pyspark.sql import functions as F

from quillon.operators import features as M
from quillon.operators import similar as N
from quillon.operators import spectra


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_matrix_is_not_broadcast(spark):
    cells = spark.createDataFrame([(1, 2, 1.0), (2, 1, 3.0)], "src long, dst long, w double")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, x array<double>")
    made = spectra.times(cells, vectors, 1)
    assert "Broadcast" not in plan(made)
    assert sorted((r["id"], r["x"][0]) for r in made.collect()) == [(1, 2.0), (2, 3.0)]


def test_tf_idf_broadcasts_counted_terms_only(spark, monkeypatch):
    df = spark.createDataFrame([(1, "aa bb"), (2, "bb cc"), (None, "aa")], "k long, t string")
    found = []
    for few in (1 << 17, 0):
        monkeypatch.setattr(M, "FEW_TERMS", few)
        made = M.tf_idf(df, "k", "t", 1, max_df=1.0)
        assert plan(made).count("BroadcastHashJoin") == (few > 0)
        found.append(sorted((r["k"], r["term"], round(r["weight"], 9)) for r in made.collect()))
    assert found[0] == found[1] and len(found[0]) == 4


def test_alias_draws_broadcast_nothing(spark):
    df = spark.createDataFrame([("a", i, 1.0 + i % 3) for i in range(30)], "g string, i long, w double")
    wanted = df.groupBy("g").agg(F.count("*").cast("int").alias("n"))
    assert "Broadcast" not in plan(N.alias_draws(N.alias_tables(df, "g", "i", "w"), wanted, "g", "n", "t"))
