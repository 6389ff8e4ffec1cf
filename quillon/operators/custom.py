"""Functions of a user's own over groups: Arrow tables in, Arrow tables out.

`merged_groups` combines before the shuffle and takes groups of any size;
`mapped_groups` holds one group in memory; `streamed_groups` sees a group in
order, batch by batch, and keeps only what its state keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_groups(df: DataFrame, keys: Sequence[str], partial: Callable[[pa.Table], pa.Table], schema: str, merge: dict[str, Column]) -> DataFrame:
    """(keys, results): `partial` makes mergeable states (keys, state columns, of `schema`) from any batch of rows, plain aggregates merge them.

    No group comes together before it is a handful of states: each batch gives
    one state a key.  Null keys form a group of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from partial(pa.Table.from_batches([batch])).to_batches()

    return df.mapInArrow(run, schema).groupBy(*keys).agg(*(c.alias(n) for n, c in merge.items()))


def mapped_groups(df: DataFrame, keys: Sequence[str], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows of `schema` that f makes of each whole group; for groups of bounded size, as one task holds a group."""
    return df.groupBy(*keys).applyInArrow(f, schema)


def streamed_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: type, schema: str) -> DataFrame:
    """Rows of `schema` from a table function over each group's rows in order.

    `state` is a class: `eval(batch)` takes the next record batch of a group
    and yields tables; `terminate()`, if it has one, yields what is left at the
    group's end.  A group is one task's, read batch by batch.
    """
    return F.arrow_udtf(state, returnType=schema)(df.asTable().partitionBy(*keys).orderBy(*order))


def moments(key: str, value: str) -> Callable[[pa.Table], pa.Table]:
    """For merged_groups: (key, n, s1, s2, s3, s4), the sums of powers of the values that aren't null."""

    def partial(table: pa.Table) -> pa.Table:
        x = table[value].cast(pa.float64())
        powers = {"s1": x}
        for k in (2, 3, 4):
            powers[f"s{k}"] = pa.compute.multiply(powers[f"s{k - 1}"], x)
        sums = pa.table({key: table[key], "n": x, **powers}).group_by(key).aggregate([("n", "count"), *((p, "sum") for p in powers)])
        return pa.table({key: sums[key], "n": sums["n_count"], **{p: sums[f"{p}_sum"] for p in powers}})

    return partial


def skewness() -> Column:
    """From merged sums of powers: the third central moment over the deviation cubed; null without values, 0 without spread."""
    n, s1, s2, s3 = F.sum("n"), F.sum("s1"), F.sum("s2"), F.sum("s3")
    mean = F.try_divide(s1, n)
    spread = F.try_divide(s2, n) - mean * mean
    third = F.try_divide(s3, n) - 3 * mean * F.try_divide(s2, n) + 2 * mean * mean * mean
    return F.when(n > 0, F.coalesce(F.try_divide(third, F.pow(F.greatest(spread, F.lit(0.0)), F.lit(1.5))), F.lit(0.0)))


class Decayed:
    """For streamed_groups: a total that halves every HALF seconds and grows by each value; (key, at, id, total) a row.

    Reads columns `key`, `at` (seconds), `id` and `value`, null values as 0.
    """

    HALF = 86_400.0

    def __init__(self):
        self.total, self.last = 0.0, None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        at, value = batch.column("at").to_pylist(), batch.column("value").to_pylist()
        out = []
        for t, v in zip(at, value):
            if self.last is not None:
                self.total *= 0.5 ** ((t - self.last) / self.HALF)
            self.total, self.last = self.total + (v or 0.0), t
            out.append(self.total)
        yield pa.table({"key": batch.column("key"), "at": batch.column("at"), "id": batch.column("id"), "total": pa.array(out, pa.float64())})
