"""Structured Streaming over files of annotated documents and events; each has the same result as its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of events in a folder, as they come."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events by window and type; ``late`` is the watermark of a stream."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """Sessions of each user, parted by a gap, with their events."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(documents: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Each document once, as far as its repeats come within the watermark."""
    return documents.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def append(stream: DataFrame, path: str, checkpoint: str):
    """Starts writing a stream as Parquet, from where the checkpoint left it, and ends when all that is there is written."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
