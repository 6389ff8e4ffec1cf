"""Intermediate tables in the cluster's shared folder: written, kept, removed."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import shared_folder


#: Rows and bytes of an Arrow batch while a scratch folder is in use.
BATCH_ROWS, BATCH_BYTES = 2_000, "8m"
#: The scratch folder in use, of each thread its own.
_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)
_lock, _in_use = threading.Lock(), [0, None]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _short_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES until the last of those who ask for them is done."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    with _lock:
        _in_use[0] += 1
        if _in_use[0] == 1:
            _in_use[1] = {k: spark.conf.get(k) for k in (rows, size)}
            before = int(_in_use[1][rows])
            spark.conf.set(rows, str(min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS))
            spark.conf.set(size, BATCH_BYTES)
    try:
        yield
    finally:
        with _lock:
            _in_use[0] -= 1
            if not _in_use[0]:
                for k, v in _in_use[1].items():
                    spark.conf.set(k, v)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside go away at its end; give what must stay to `kept`.

    Arrow batches are short meanwhile: rows here may hold a text or two.
    """
    folder = new_path(spark, "scratch")
    token = _scratch.set(folder)
    try:
        with _short_batches(spark):
            yield
    finally:
        _scratch.reset(token)
        remove(spark, folder)
        release(spark)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished work now; it waits for the driver's garbage collection else."""
    gc.collect()
    spark._jvm.System.gc()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table that outlives the scratch folder in use."""
    token = _scratch.set(None)
    try:
        return written(df, name)
    finally:
        _scratch.reset(token)


def fresh(name: str, columns: list[str]) -> str:
    """A column name like `name` that is not among columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed table in the shared folder: computed once, safe from lost executors."""
    return written_at(df, new_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a written table.

    A checkpoint would keep the size estimates of the plan it cuts, which
    multiply with every join of an iteration; a table's sizes are its files'.
    """
    return written(df, "cut")


#: So many ids may be broadcast; beyond, a shuffle join does the same.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not among ids; a null id stays."""
    ids = cut(ids.select(id_col).distinct())
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, id_col, "left_anti").select(*docs.columns)
