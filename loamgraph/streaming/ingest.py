"""Structured Streaming forms: event ingest, windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, which needs an instant, not a local time; a batch as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once: of a batch the earliest row of a key (ties by the least other fields), of a stream the first within the watermark."""
    if events.isStreaming:
        return _timed(events, time, late).dropDuplicatesWithinWatermark([key])
    rest = [c for c in events.columns if c not in (key, time)]
    return events.groupBy(key).agg(F.min(F.struct(time, *rest)).alias("m")).select(key, f"m.{time}", *[f"m.{c}" for c in rest])


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling, or with ``slide`` sliding, windows."""
    e = _timed(events, "ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n) of sessions that end after ``gap`` without an event."""
    e = _timed(events, "ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def ingest(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame] = lambda df, i: df):
    """Appends each micro-batch under its own id, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
