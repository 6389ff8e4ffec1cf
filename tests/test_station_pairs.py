"""The pairs of stations are worked out in tiles; no row of a pair beside the result's is made."""

from quillon.plans import tabular


def test_station_pairs_are_not_joined(spark, sf):
    made = tabular.station_kernel(spark, sf)
    assert made.count() > 0
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
