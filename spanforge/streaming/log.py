"""An event log with exactly-once batches.

Each micro-batch is written under its number, over whatever an earlier try
left there, and entered in a ledger once it is whole. Readers take the batches of
the ledger alone. Numbers of events are made in the live state, so a query that is
killed and started again gives neither a gap nor a repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.streaming.live import last_events
from spanforge.streaming.ticks import clamp

LEDGER = "batch long, n long"


def write_log(events: DataFrame, path: str, checkpoint: str, *, seconds: float | None = None) -> StreamingQuery:
    """Clamped events to ``path``/events/batch=n, then n to ``path``/ledger. With the checkpoint a restarted query goes on where it stopped."""

    def put(batch: DataFrame, number: int) -> None:
        put_batch(batch, number, path)

    out = clamp(events).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out).start()


def put_batch(batch: DataFrame, number: int, path: str) -> None:
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{path}/events/batch={number}")
    n = spark.read.schema(batch.schema).parquet(f"{path}/events/batch={number}").count()
    spark.createDataFrame([(number, n)], LEDGER).coalesce(1).write.mode("overwrite").json(f"{path}/ledger/batch={number}")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of whole batches and of their events."""
    return spark.read.schema("n long").json(f"{path}/ledger").select(F.col("batch").cast("long").alias("batch"), "n")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of whole batches."""
    e = spark.read.parquet(f"{path}/events")
    return e.withColumn("batch", F.col("batch").cast("long")).join(ledger(spark, path).select("batch"), "batch", "left_semi").drop("batch")


def recent(spark: SparkSession, path: str, most: int = 2000) -> DataFrame:
    """The last ``most`` events of each session."""
    return last_events(read_log(spark, path), most)


def statistics(events: DataFrame) -> DataFrame:
    """What each ended session told last: ticks, tracks, emitted and its number of events."""
    said = F.from_json("text", "ticks long, tracks long, emitted long, events long")
    return events.where("event = 'session_end'").select("session_id", F.col("now_s").alias("ended_s"), said.alias("s")).select("session_id", "ended_s", "s.*")
