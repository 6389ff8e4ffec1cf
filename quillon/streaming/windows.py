"""Event windows: the same expressions over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, by: list[str], value: str, size: str = "1 hour", slide: str | None = None, time: str = "ts", late: str | None = None) -> DataFrame:
    """(window_start, by, n, total) by fixed (or sliding) windows; `late` sets a watermark on streams."""
    if late:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, by: list[str], gap: str = "30 minutes", time: str = "ts", late: str | None = None) -> DataFrame:
    """(by, session_start, session_end, n) by gaps of inactivity."""
    if late:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = events.groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stream_of(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
