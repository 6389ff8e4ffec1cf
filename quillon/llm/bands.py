"""Numeric band join: rows of two tables whose numbers are near, as bounded first pairs and sums.

Both sides are sorted by value and cut into blocks that know their smallest and
largest value (zone maps).  Blocks meet where their zones overlap, found by an
equality join on cells of the value axis; each pair of blocks is one numpy tile
of comparisons.  Before that, rows of one value become one entry: their number,
the sum of their weights and those rows that can be among anyone's first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Values in a block, rows held before a reduction, entries each side of a value that are looked at first.
BLOCK, HELD, LOOK = 1024, 1 << 20, 16
#: A null in the second order column comes first.
NULL, LARGEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

#: One row a candidate; the entry's number n and sums stand in its first row.
FLAT = "key long, n long, gaps long, weight long, u long, a long, b long, owner long"
_COLUMNS = [c.split()[0] for c in FLAT.split(", ")]
_FIELDS = ("n", "gaps", "weight")


def _place(*keys: np.ndarray) -> np.ndarray:
    """Each row's place, from 0, in its run of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    starts = np.ones(n, bool)
    starts[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def _reduced(rows: dict[str, np.ndarray], top: int) -> dict[str, np.ndarray]:
    """For each key, its sums and its first 2 * top rows by gap, u, a, b, owner with at most top of an owner.

    Whoever leaves one owner out still finds its own first top rows among them.
    """
    key, owner = rows["key"], rows["owner"]
    order = np.lexsort((owner, rows["b"], rows["a"], rows["u"], np.abs(rows["u"] - key), key))
    rows = {c: v[order] for c, v in rows.items()}
    key, owner = rows["key"], rows["owner"]
    first = np.flatnonzero(_place(key) == 0)
    sums = {c: np.add.reduceat(rows[c], first) if len(first) else rows[c] for c in _FIELDS}
    by = np.lexsort((owner, key))
    kept = np.empty(len(key), bool)
    kept[by] = _place(key[by], owner[by]) < top
    kept = np.flatnonzero(kept)
    kept = kept[_place(key[kept]) < 2 * top]
    out = {c: v[kept] for c, v in rows.items()}
    heads = np.flatnonzero(_place(out["key"]) == 0)
    for c in _FIELDS:
        out[c] = np.zeros(len(kept), np.int64)
        out[c][heads] = sums[c]
    return out


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in _COLUMNS}


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(_COLUMNS)}


def _batches(rows: dict[str, np.ndarray], size: int = 1 << 16):
    for at in range(0, len(rows["key"]), size):
        yield pa.RecordBatch.from_arrays([pa.array(rows[c][at : at + size]) for c in _COLUMNS], names=_COLUMNS)


def _compacted(top: int):
    """Reduces the rows of a task, some HELD at a time."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(_arrays(batch))
            n += batch.num_rows
            if n >= HELD:
                yield from _batches(_reduced(_joined(held), top))
                held, n = [], 0
        if held:
            yield from _batches(_reduced(_joined(held), top))

    return run


def _entries(batches, top: int):
    """Whole keys, reduced, of batches that are sorted by key; only the last key waits for the next batch."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _arrays(batch)
        rows = _reduced(rows if waiting is None else _joined([waiting, rows]), top)
        last = np.searchsorted(rows["key"], rows["key"][-1])
        if last:
            yield {c: v[:last] for c, v in rows.items()}
        waiting = {c: v[last:] for c, v in rows.items()}
    if waiting is not None:
        yield waiting


def _whole(flat: DataFrame, top: int) -> DataFrame:
    """flat with one entry a key."""

    def run(batches):
        for rows in _entries(batches, top):
            yield from _batches(rows)

    return flat.repartition("key").sortWithinPartitions("key").mapInArrow(run, FLAT)


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i8").tobytes()


def _back(x) -> np.ndarray:
    return np.frombuffer(x.as_py(), "<i8")


def _blocks(sorted_rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(block, lo, hi, one binary a column): sorted rows in blocks of about BLOCK keys; the rows of a key stay together."""
    names = ["block", "lo", "hi", *columns]

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0

        def out(rows):
            nonlocal number
            number += 1
            key = rows["key"]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([int(key[0])]), pa.array([int(key[-1])]), *(pa.array([_binary(rows[c])], pa.binary()) for c in columns)], names=names)

        held, keys = [], 0
        for batch in batches:
            rows = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(columns)}
            while len(rows["key"]):
                new = np.ones(len(rows["key"]), bool)
                new[1:] = rows["key"][1:] != rows["key"][:-1]
                new[0] = not held or held[-1]["key"][-1] != rows["key"][0]
                count = keys + np.cumsum(new)
                cut = int(np.searchsorted(count, BLOCK, side="right"))
                if cut:
                    held.append({c: v[:cut] for c, v in rows.items()})
                    keys = int(count[cut - 1])
                if cut < len(count):
                    yield out({c: np.concatenate([h[c] for h in held]) for c in columns})
                    held, keys = [], 0
                rows = {c: v[cut:] for c, v in rows.items()}
        if held:
            yield out({c: np.concatenate([h[c] for h in held]) for c in columns})

    schema = ", ".join(["block long", "lo long", "hi long", *(f"{c} binary" for c in columns)])
    return sorted_rows.select(*columns).mapInArrow(run, schema)


def _cell(v: Column, width: int) -> Column:
    """The cell of the value axis that holds v: as wide as the band near zero, by steps of half a hundredth beyond; it never falls as v grows."""
    edge = 200 * width
    far = 200 + F.floor(F.log(F.abs(v) / F.lit(float(edge))) / F.lit(math.log(1.005)))
    return F.when(F.abs(v) < edge, F.floor(v / F.lit(float(width)))).otherwise(F.signum(v).cast("long") * F.greatest(far, F.lit(200))).cast("long")


def _meetings(left: DataFrame, right: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(left block, right block) whose zones can hold a pair; each once, in the first cell that both have."""
    axis = max(width, 1)
    reach = F.greatest(F.lit(width), F.floor(F.greatest(F.col("hi"), F.lit(0)) * num / den).cast("long") + 1)
    low = F.greatest(F.lit(width), F.floor(F.greatest(F.col("lo"), F.lit(0)) * num / den).cast("long") + 1)
    spread = lambda df, lo, hi, tag: df.select(F.col("block").alias(f"{tag}_block"), lo.alias(f"{tag}_lo"), hi.alias(f"{tag}_hi")).select(
        "*", F.explode(F.sequence(_cell(F.col(f"{tag}_lo"), axis), _cell(F.col(f"{tag}_hi"), axis))).alias("cell")
    )
    ours = spread(left, F.col("lo") - low, F.col("hi") + reach, "left")
    theirs = spread(right, F.col("lo"), F.col("hi"), "right")
    both = ours.join(theirs.hint("merge"), "cell").filter("left_lo <= right_hi and right_lo <= left_hi")
    return both.filter(F.col("cell") == F.greatest(_cell(F.col("left_lo"), axis), _cell(F.col("right_lo"), axis))).select("left_block", "right_block")


def _near(u: np.ndarray, p: np.ndarray, width: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(gap, whether it is in the band) of all u against all p."""
    gap = np.abs(u - p)
    return gap, (gap <= width) | (den * gap <= num * np.minimum(u, p))


def _tile(p: np.ndarray, rows: dict[str, np.ndarray], width: int, num: int, den: int, top: int) -> dict[str, np.ndarray] | None:
    """The entries of the values p from one block of right entries."""
    heads = np.flatnonzero(_place(rows["key"]) == 0)
    u, n, weight = rows["key"][heads], rows["n"][heads], rows["weight"][heads]
    ends = np.append(heads[1:], len(rows["key"]))
    gap, near = _near(u[None, :], p[:, None], width, num, den)
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return None
    p, gap, near = p[some], gap[some], near[some]
    sums = {"n": (near * n).sum(axis=1), "gaps": (near * gap * n).sum(axis=1), "weight": (near * weight).sum(axis=1)}
    inside = near.sum(axis=1)
    parts, open_, look = [], np.arange(len(p)), LOOK
    while len(open_):
        q = p[open_]
        at = np.searchsorted(u, q)
        lo, hi = np.maximum(at - look, 0), np.minimum(at + look, len(u))
        # what is nearer than every entry not looked at
        far = np.minimum(np.where(lo > 0, q - u[lo - 1], LARGEST), np.where(hi < len(u), u[np.minimum(hi, len(u) - 1)] - q, LARGEST))
        size = hi - lo
        row = np.repeat(np.arange(len(q)), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        good = near[open_][row, col] & (gap[open_][row, col] < far[row])
        row, col = row[good], col[good]
        seen = np.bincount(row, minlength=len(q))
        size = ends[col] - heads[col]
        of = np.repeat(row, size)
        line = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(heads[col], size)
        zero = np.zeros(len(of), np.int64)
        made = _reduced({"key": q[of], "n": zero, "gaps": zero, "weight": zero, "u": rows["u"][line], "a": rows["a"][line], "b": rows["b"][line], "owner": rows["owner"][line]}, top)
        got = np.bincount(np.searchsorted(q, made["key"]), minlength=len(q))
        ready = (got >= 2 * top) | (seen >= inside[open_])
        parts.append({c: v[ready[np.searchsorted(q, made["key"])]] for c, v in made.items()})
        open_, look = open_[~ready], 4 * look
    out = _joined(parts)
    order = np.argsort(out["key"], kind="stable")
    out = {c: v[order] for c, v in out.items()}
    first = np.flatnonzero(_place(out["key"]) == 0)
    for c in _FIELDS:
        out[c][first] = sums[c]
    return out


def band_join(left: DataFrame, right: DataFrame, width: int = 50, num: int = 5, den: int = 1000, top: int = 10) -> DataFrame:
    """Pairs of left and right rows of different owners with |u - p| <= width or den * |u - p| <= num * min(u, p).

    left (id, p) and right (owner, a, b, u, weight) have long columns.  Returns
    for each left row its first `top` pairs by gap, u, a, b, owner, one a row:
    (id, rank from 1, gap, u, a, b, owner, n_pairs, gap_sum, weight_sum), where
    the sums are over all its pairs; a left row without pairs has rank 0, nulls
    and zeros.  Rows null in id, p, owner, a, u or weight never pair; a null b
    comes first; repeated right rows each count and take a rank each; repeated
    left rows are each joined; empty tables give no pairs; other columns are
    not read.  weight_sum is a long and wraps beyond.

    Exact for any data: right rows of one value are one entry that keeps, in
    order, 2 * top rows with at most `top` of an owner, so a third of all rows
    with one value or owner are few rows before the first shuffle.  A left row's
    own right rows are counted by owner and value and taken off the sums.
    """
    right = right.select("owner", "a", "b", "u", "weight").dropna(subset=["owner", "a", "u", "weight"])
    flat = right.select(F.col("u").alias("key"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("gaps"), "weight", "u", "a", F.coalesce("b", F.lit(int(NULL))).alias("b"), "owner")
    entries = store.cut(_whole(flat.mapInArrow(_compacted(top), FLAT), top))
    theirs = store.cut(_blocks(entries.repartitionByRange("key").sortWithinPartitions("key", "a", "b", "owner"), ("key", "n", "weight", "u", "a", "b", "owner")))
    values = store.cut(left.select(F.col("p").alias("key")).dropna().distinct())
    ours = store.cut(_blocks(values.repartitionByRange("key").sortWithinPartitions("key"), ("key",)))
    pairs = _meetings(ours, theirs, width, num, den)
    pairs = pairs.join(ours.select(F.col("block").alias("left_block"), F.col("key").alias("p")).hint("merge"), "left_block").join(theirs.withColumnRenamed("block", "right_block").drop("lo", "hi").hint("merge"), "right_block")

    def tiles(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = {c: _back(batch.column(1 + i)[k]) for i, c in enumerate(("key", "n", "weight", "u", "a", "b", "owner"))}
                made = _tile(_back(batch.column(0)[k]), rows, width, num, den, top)
                if made is not None:
                    yield from _batches(made)

    flat = pairs.select("p", "key", "n", "weight", "u", "a", "b", "owner").mapInArrow(tiles, FLAT)
    return _unfolded(left.select("id", "p"), _nested(flat, top), right, width, num, den, top)


def _nested(flat: DataFrame, top: int) -> DataFrame:
    """(p, n, gaps, weight, near): one row a value, its candidates in order."""

    def run(batches):
        for rows in _entries(batches, top):
            heads = np.flatnonzero(_place(rows["key"]) == 0)
            fields = [pa.array(np.abs(rows["u"] - rows["key"])), pa.array(rows["u"]), pa.array(rows["a"]), pa.array(rows["b"], mask=rows["b"] == NULL), pa.array(rows["owner"])]
            for at in range(0, len(heads), 2_000):
                part = heads[at : at + 2_000]
                end = heads[at + 2_000] if at + 2_000 < len(heads) else len(rows["key"])
                structs = pa.StructArray.from_arrays([f[part[0] : end] for f in fields], ["gap", "u", "a", "b", "owner"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(part, end) - part[0], pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([*(pa.array(rows[c][part]) for c in ("key", *_FIELDS)), lists], names=["p", *_FIELDS, "near"])

    return flat.repartition("key").sortWithinPartitions("key").mapInArrow(run, "p long, n long, gaps long, weight long, near array<struct<gap:long,u:long,a:long,b:long,owner:long>>")


def _unfolded(left: DataFrame, by_value: DataFrame, right: DataFrame, width: int, num: int, den: int, top: int) -> DataFrame:
    """The rows of each left row: its value's candidates and sums without its own right rows."""
    mine = right.groupBy(F.col("owner").alias("id"), "u").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    gap = F.abs(F.col("u") - F.col("p"))
    band = (gap <= width) | (gap * den <= F.least("u", "p") * num)
    own = left.dropna().distinct().join(mine.hint("merge"), "id").filter(band).groupBy("id", "p").agg(F.sum("n").alias("_n"), F.sum(gap * F.col("n")).alias("_g"), F.sum("w").alias("_w"))
    rows = left.withColumn("_key", F.when(F.col("id").isNotNull(), F.col("p"))).join(by_value.withColumnRenamed("p", "_key").hint("merge"), "_key", "left").join(own.hint("merge"), ["id", "p"], "left")
    rest = lambda c, o: (F.coalesce(c, F.lit(0)) - F.coalesce(o, F.lit(0))).cast("long")
    first = F.slice(F.filter("near", lambda x: x["owner"] != F.col("id")), 1, top)
    out = rows.select("id", rest("n", "_n").alias("n_pairs"), rest("gaps", "_g").alias("gap_sum"), rest("weight", "_w").alias("weight_sum"), F.posexplode_outer(first).alias("_at", "_x"))
    return out.select("id", F.coalesce(F.col("_at") + 1, F.lit(0)).cast("int").alias("rank"), *(F.col(f"_x.{c}").alias(c) for c in ("gap", "u", "a", "b", "owner")), "n_pairs", "gap_sum", "weight_sum")


def cents(x: str | Column) -> Column:
    """floor(100 * x + 0.5) as a long; null for what is no number below 10^13, where doubles no longer hold cents."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.floor(x * 100 + 0.5)
    return F.when(F.abs(x) < 1e13, y.cast("long"))


def near_prices(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Each item's nearest lines of other items by price, and sums over all near ones.

    u is a line's amount by its quantity in cents, rounded half up in exact
    integers; a quantity of 0 and amounts that are no numbers below 10^13 never pair; for a
    null line_no the checksum takes an empty text.
    """
    a, q = cents("amount"), F.col("quantity").cast("long")
    floor = F.expr("CASE WHEN _q > 0 THEN (2 * _a + _q - pmod(2 * _a + _q, 2 * _q)) div (2 * _q) WHEN _q < 0 THEN (-(2 * _a + _q) - pmod(-(2 * _a + _q), -2 * _q)) div (-2 * _q) END")
    text = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string"))
    right = lines.select(F.col("item_id").cast("long").alias("owner"), F.col("sale_id").cast("long").alias("a"), F.col("line_no").cast("long").alias("b"), a.alias("_a"), q.alias("_q"), F.crc32(text.cast("binary")).alias("weight")).withColumn("u", floor)
    left = items.select(F.col("item_id").cast("long").alias("id"), cents("price").alias("p"))
    made = band_join(left, right)
    return made.select(F.col("id").alias("item_id"), "rank", "gap", "u", F.col("a").alias("sale_id"), F.col("b").alias("line_no"), F.col("owner").alias("line_item_id"), "n_pairs", "gap_sum", F.col("weight_sum").alias("lines_crc"))
