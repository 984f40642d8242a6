"""Structured Streaming over event files, and the same windows in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_each: int = 4) -> DataFrame:
    """New Parquet files of a folder as a stream, so many files a batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_each).parquet(folder)


def tumbling(events: DataFrame, length: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; in a stream, windows close when the watermark passes."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, step: str, late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events with less than ``gap`` between them."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    out = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each, as far back as the watermark reaches."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def to_folder(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is closed to a folder, exactly once, then stop; the checkpoint belongs in a shared folder."""
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
