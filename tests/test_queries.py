"""Every registered query against its SQL on the smallest tables; those without SQL against properties."""

import math

import duckdb
import pytest

from quillon.plans import registry
from quillon.sources.tables import NAMES

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):  # a list of whole numbers isn't one of doubles
        return tuple((type(x).__name__, plain(x)) if isinstance(x, (int, float)) else plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def table_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = con.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_no_row_by_row_python(spark, sf):
    for name in SQL:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_filters_reach_the_scan(spark, sf):
    plan = QUERIES["rows_by_label"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "EqualTo(toxic,0)" in plan
    plan = QUERIES["value_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<quality:int>" in plan
