"""Every query outside the training-data folder, by name, and its SQL.

Query modules register with `query`; a query is named after the operators it
shows.  Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
MODULES = ("tabular", "texts", "similarity", "graphs", "matrices", "models", "streams", "files")


def query(sql: str | None = None):
    def take(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return take


def r6(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)  # no negative zero


def halves_as_sql(c: str | Column) -> Column:
    """c to six places as the SQL engine does it: times 10^6, to a whole number, and back; at halves of the last place that can differ from r6."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


def rounded(df: DataFrame) -> DataFrame:
    """df with its doubles (also inside arrays) rounded and its small integers as longs."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = r6(c)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "array<double>":
            c = F.transform(c, lambda x: F.round(x, 6) + F.lit(0.0))
        elif kind in ("array<int>",):
            c = c.cast("array<bigint>")
        out.append(c.alias(name))
    return df.select(*out)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"quillon.plans.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
