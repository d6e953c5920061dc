"""Streaming sources and sinks of live sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge import schemas


def read_ticks(spark: SparkSession, path: str, *, files_at_once: int = 64) -> DataFrame:
    """Ticks from JSON lines that keep arriving under a path."""
    return spark.readStream.schema(schemas.LIVE_TICKS).option("maxFilesPerTrigger", files_at_once).json(path)


def clamp(events: DataFrame, slack: float = 0.05) -> DataFrame:
    """No event ends after its tick."""
    return events.withColumn("end_s", F.when(F.col("end_s") > F.col("now_s") + slack, F.col("now_s")).otherwise(F.col("end_s")))


def write_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Clamped events as JSON lines; with the checkpoint a restarted query goes on where it stopped."""
    return clamp(events).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def watermarked(events: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events with event time as a timestamp (a watermark needs one with a zone)."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def session_counts(events: DataFrame, key: str, *, time: str = "ts", gap: str = "6 hours") -> DataFrame:
    """Event-time sessions of a key, in batch or in a stream."""
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
