"""JSON objects of any size as rows: one row an entry, read in byte ranges.

A file holds one object that maps keys to values.  Where a range of bytes
begins, nobody knows whether it is inside a string, or how deep; a first pass
therefore says of each range what it does to both, once for a beginning inside
a string and once outside.  These summaries, a row a range, are put together
in order; a second pass then finds the entries that begin in each range, and
reads on to the end of the last.  A task holds a range and an entry, no file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.tables import cut

#: Bytes of a range, of which a task holds several numbers a byte, and of a task's ranges together, on average.
RANGE, TASK_BYTES = 1 << 20, 32 << 20
_QUOTE, _ESCAPE, _COMMA = ord('"'), ord("\\"), ord(",")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return where.open_input_file(path)


def _escaped_before(file, at: int) -> int:
    """How many escape characters stand right before a place."""
    n, look = 0, 64
    while at > 0:
        begin = max(0, at - look)
        part = file.read_at(at - begin, begin)
        rest = len(part) - len(part.rstrip(b"\\"))
        n += rest
        if rest < len(part):
            break
        at, look = begin, 2 * look
    return n


def _strings(data: np.ndarray, before: int) -> np.ndarray:
    """For each byte, whether a beginning outside a string leaves it inside one (its opening quote counts as inside, the closing one not)."""
    other = np.flatnonzero(data != _ESCAPE)
    quotes = np.flatnonzero(data == _QUOTE)
    # escape characters right before each quote
    k = np.searchsorted(other, quotes) - 1
    run = np.where(k >= 0, quotes - 1 - other[np.maximum(k, 0)], quotes + before) if len(other) else quotes + before
    open_ = np.zeros(len(data), np.int8)
    open_[quotes[run % 2 == 0]] = 1
    return np.bitwise_and(np.cumsum(open_, dtype=np.int32), 1).astype(bool)


def _depths(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return np.cumsum(np.where(inside, np.int8(0), _STEP[data]), dtype=np.int32)


def _summaries(batches):
    """(path, start, size, flips, outside, inside): whether a range ends on the other side of strings than it begins, and how much deeper, for both beginnings."""
    for batch in batches:
        rows = []
        for path, start, size in zip(*(c.to_pylist() for c in batch.columns[:3])):
            with _open(path) as file:
                data = np.frombuffer(file.read_at(size, start), np.uint8)
                inside = _strings(data, _escaped_before(file, start))
            # a quote that opens for one beginning closes for the other; neither is a bracket
            rows.append((path, start, size, bool(inside[-1]), int(_depths(data, inside)[-1]), int(_depths(data, ~inside)[-1])))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())], names=["path", "start", "size", "flips", "outside", "inside"])


def _entries(batches):
    """(path, entry): the texts between the marks that part a range's entries, the last one read to its end."""
    for batch in batches:
        for path, start, size, inside, depth in zip(*(c.to_pylist() for c in batch.columns[:5])):
            with _open(path) as file:
                for texts in _texts(file, start, size, inside, depth):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts)), pa.array(texts, pa.string())], names=["path", "entry"])


def _marks(data: np.ndarray, before: int, inside: bool, depth: int) -> tuple[np.ndarray, bool, int]:
    """(places of the brace that opens the object, of commas between entries and of its last brace; the state behind the data)."""
    held = _strings(data, before) ^ inside
    deep = depth + _depths(data, held)
    step = np.where(held, 0, _STEP[data])
    marks = (step == 1) & (deep == 1) | (~held & (data == _COMMA) & (deep == 1)) | (step == -1) & (deep == 0)
    return np.flatnonzero(marks), bool(held[-1]), int(deep[-1])


def _texts(file, start: int, size: int, inside: bool, depth: int):
    data = np.frombuffer(file.read_at(size, start), np.uint8)
    marks, inside, depth = _marks(data, _escaped_before(file, start), inside, depth)
    if not len(marks):
        return
    raw = data.tobytes()
    texts = [t for a, b in zip(marks, marks[1:]) if (t := raw[a + 1 : b].decode().strip())]
    for k in range(0, len(texts), 2_000):
        yield texts[k : k + 2_000]
    if depth < 1:
        return
    last, at = [raw[marks[-1] + 1 :]], start + size
    while part := file.read_at(min(size, RANGE) + 64, at):
        more = np.frombuffer(part, np.uint8)
        marks, inside, depth = _marks(more, _escaped_before(file, at), inside, depth)
        if len(marks):
            last.append(part[: marks[0]])
            break
        last.append(part)
        at += len(part)
    if text := b"".join(last).decode().strip():
        yield [text]


def read_dictionary(spark: SparkSession, path: str, value: str, size: int = RANGE) -> DataFrame:
    """(key, value) of every entry of the files under path, each one JSON object; value is a type like struct<a:int>.

    The rows are the same whatever the size of the ranges.  Empty files and
    objects have none; of an entry that is no JSON the value is null, or the
    entry goes if not even its key can be read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length"))
    ranges = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"), "length")
    ranges = cut(ranges.select("path", "start", F.least(F.lit(size).cast("long"), F.col("length") - F.col("start")).alias("size")))
    counted, total = ranges.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(counted, max(-(-total // TASK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    told = cut(ranges.repartition(tasks, "path", "start").mapInArrow(_summaries, "path string, start long, size long, flips boolean, outside long, inside long"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    held = told.withColumn("held", F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1)
    placed = held.withColumn("depth", F.coalesce(F.sum(F.when(F.col("held"), F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    states = cut(placed.select("path", "start", "size", "held", "depth"))
    entries = states.repartition(tasks, "path", "start").mapInArrow(_entries, "path string, entry string")
    one = F.from_json(F.concat(F.lit("{"), F.col("entry"), F.lit("}")), f"map<string,{value}>")
    return entries.select(F.explode(one).alias("key", "value"))
