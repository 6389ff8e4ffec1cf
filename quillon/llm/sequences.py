"""Documents as packed training sequences: corpus-wide pattern packing and block-wise binary output."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packing as P
from . import store
from .tokens import encoder, texts_of

_PIECES = (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))


def _schema(docs: DataFrame, id_col: str, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in (*_PIECES, *more))])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def _documents(batches, path: str, end_id: int | None):
    """(batch, row, ids) of every document, the end id included."""
    enc = encoder(path)
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    for batch in batches:
        for k, ids in enumerate(enc.encode(texts_of(batch.column(1)))):
            yield batch, k, np.concatenate([ids, tail])


def pattern_pack(docs: DataFrame, path: str, size: int = 1024, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces, packed into few sequences of at most size tokens.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset).  Pieces
    are cut and numbered in one pass over the texts, which leaves their lengths
    and checksums in a table; the histogram of lengths alone goes to the
    driver, which fits the patterns; a second pass over the small table looks
    up each piece's place.  Within a length, pieces rank by partition and order
    in it, so a length that a third of all pieces have is no hot group.

    Null and empty texts are the end id alone (no row if end_id is None, as
    there is no token to place); null ids stay null; repeated rows are packed
    each for itself; an empty table gives no rows.
    """

    def run(batches):
        rank, task = np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        rows: list[tuple] = []

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type[0]), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (5, pa.int32()), (6, pa.int64())))], names=schema.names)
            rows.clear()
            return batch

        id_type = [None]
        for batch, k, ids in _documents(batches, path, end_id):
            id_type[0] = batch.schema.field(0).type
            doc = batch.column(0)[k].as_py()
            for piece, (start, length) in enumerate(P.piece_bounds(len(ids), size)):
                if length:
                    rows.append((doc, piece, start, length, _crc(ids[start : start + length]), task, int(rank[length])))
                    rank[length] += 1
            if len(rows) >= 10000:
                yield out()
        if rows:
            yield out()

    schema = _schema(docs, id_col, ("_task", T.IntegerType()), ("_rank", T.LongType()))
    pieces = store.written(docs.select(id_col, text_col).mapInArrow(run, schema), "pieces")
    counts = pieces.groupBy("length", "_task").agg(F.count("*").alias("n"))
    hist = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most size rows
        hist[r["length"]] = r["n"]
    plan = P.Plan(hist)
    before = counts.select("length", "_task", (F.sum("n").over(Window.partitionBy("length").orderBy("_task")) - F.col("n")).alias("_before"))
    ranked = pieces.join(before, ["length", "_task"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = [id_col, *(n for n, _ in _PIECES)]

    def place(batches):
        for batch in batches:
            sequence, offset = plan.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, _schema(docs, id_col, ("sequence_id", T.LongType()), ("offset", T.LongType())))


def write_packed(docs: DataFrame, path: str, to: str, size: int = 1024, end_id: int | None = 2, pad_id: int = 0, wide: bool = False, block: int = 16384, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Packed id matrices as a table of sequences at `to`.

    Columns: sequence_id; ids (size little-endian unsigned ids of two bytes,
    four if wide, padded with pad_id); cu_seqlens (cumulative segment lengths
    from 0); positions (as ids: restart at 0 with each segment, 0 in the
    padding); ids of the documents, piece numbers and starts of the segments.
    Each task packs blocks of at most `block` pieces by best-fit decreasing, so
    no token is shuffled and memory is bounded; a lost task is simply run
    again, as the writer commits by task.  Overlong documents are split
    losslessly.  Null and empty texts are the end id alone.
    """
    dtype = "<u4" if wide else "<u2"
    limit = 1 << (32 if wide else 16)
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("positions", T.BinaryType()),
            T.StructField("segment_ids", T.ArrayType(docs.schema[id_col].dataType)),
            T.StructField("segment_pieces", T.ArrayType(T.IntegerType())),
            T.StructField("segment_starts", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        id_type = [pa.int64()]

        def out():
            nonlocal sequence
            where, offset, bins = P.BestFit(size).pack(np.array([len(w[3]) for w in waiting]))
            order = np.lexsort((offset, where))
            edges = np.searchsorted(where[order], np.arange(bins + 1))
            for first in range(0, bins, 1024):
                last = min(bins, first + 1024)
                ids, positions = np.full((last - first, size), pad_id, dtype), np.zeros((last - first, size), dtype)
                cu, docs_, pieces, starts = [], [], [], []
                for b in range(first, last):
                    mine = order[edges[b] : edges[b + 1]]
                    for i in mine:
                        n = len(waiting[i][3])
                        ids[b - first, offset[i] : offset[i] + n] = waiting[i][3]
                        positions[b - first, offset[i] : offset[i] + n] = np.arange(n)
                    cu.append([0, *np.cumsum([len(waiting[i][3]) for i in mine]).tolist()])
                    docs_.append([waiting[i][0] for i in mine])
                    pieces.append([waiting[i][1] for i in mine])
                    starts.append([waiting[i][2] for i in mine])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(sequence + first, sequence + last)),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                        pa.array(cu, pa.list_(pa.int32())),
                        pa.array([x.tobytes() for x in positions], pa.binary()),
                        pa.array(docs_, pa.list_(id_type[0])),
                        pa.array(pieces, pa.list_(pa.int32())),
                        pa.array(starts, pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )
            sequence += bins
            waiting.clear()

        for batch, k, ids in _documents(batches, path, end_id):
            id_type[0] = batch.schema.field(0).type
            doc = batch.column(0)[k].as_py()
            if len(ids) and int(ids.max()) >= limit:
                raise ValueError(f"id {int(ids.max())} does not fit {dtype}; use wide=True")
            for piece, (start, length) in enumerate(P.piece_bounds(len(ids), size)):
                if length:
                    waiting.append((doc, piece, start, ids[start : start + length].astype(dtype)))
                if len(waiting) >= block:
                    yield from out()
        if waiting:
            yield from out()

    docs.select(id_col, text_col).mapInArrow(run, schema).write.parquet(to, compression="zstd")


def read_segments(packed: DataFrame, wide: bool = False, id_col: str = "doc_id") -> DataFrame:
    """The segments of written sequences: (id, piece, start, length, ids_crc32, sequence_id, offset, positions_reset)."""
    dtype = "<u4" if wide else "<u2"
    source = packed.schema["segment_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField(id_col, source), *(T.StructField(n, t) for n, t in _PIECES), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("positions_reset", T.BooleanType())]
    )

    def run(batches):
        for batch in batches:
            rows = []
            doc_type = batch.schema.field("segment_ids").type.value_type
            for r in batch.to_pylist():
                ids, positions = np.frombuffer(r["ids"], dtype), np.frombuffer(r["positions"], dtype)
                for k, (a, b) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
                    reset = bool((positions[a:b] == np.arange(b - a)).all())
                    rows.append((r["segment_ids"][k], r["segment_pieces"][k], r["segment_starts"][k], b - a, _crc(ids[a:b]), r["sequence_id"], a, reset))
            types = (doc_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=schema.names)

    return packed.mapInArrow(run, schema)
