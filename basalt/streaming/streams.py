"""Streams: chunked files, windowed event statistics, incremental exact dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", files: int = 1) -> DataFrame:
    """Files of a folder as a stream, `files` at a time."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).load(path)


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n, sum, mean) by event time; works on tables and on streams, where `late` bounds the state."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width, slide), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean")).select(F.col("window.start").alias("window_start"), key, "n", "sum", "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n)."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap), F.col(key)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def unique_texts(documents: DataFrame, text: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first document of each text; on a stream the state holds text hashes, of the last `late` if time is given."""
    hashed = documents.withColumn("_h", F.sha2(F.col(text), 256))
    if documents.isStreaming and time:
        return hashed.withWatermark(time, late).dropDuplicatesWithinWatermark(["_h"]).drop("_h")
    return hashed.dropDuplicates(["_h"]).drop("_h")


def running_monitor(batches: DataFrame, label: str) -> DataFrame:
    """(label, samples, tokens): counters that a stream keeps in update mode."""
    return batches.groupBy(label).agg(F.count("*").alias("samples"), F.sum(F.size("input_ids")).alias("tokens"))
