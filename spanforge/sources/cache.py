"""A store of judgments: a bucketed table by key, with upserts, and the rule when it spares a model.

Judgments are appended with the time they were stored; the latest of a key
counts. The table is bucketed and sorted by its key, so neither finding the
latest nor a join moves its rows: only candidates are shuffled, to its buckets.
``compact`` rewrites it to one row a key. A retried store changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.plans.judge import needs_model
from spanforge.sources.results import candidate_key

COLUMNS = "cache_key string, judgment string, stored_us long"


def create(spark: SparkSession, table: str, *, buckets: int = 64, path: str | None = None) -> None:
    """An empty store; ``path`` puts its files elsewhere than the warehouse."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({COLUMNS}) USING parquet CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {buckets} BUCKETS" + (f" LOCATION '{path}'" if path else ""))


def _latest(rows: DataFrame) -> DataFrame:
    """Of each key the judgment stored last, the greatest of those stored at once."""
    return rows.where("cache_key IS NOT NULL AND judgment IS NOT NULL").groupBy("cache_key").agg(F.max(F.struct("stored_us", "judgment")).alias("l")).select("cache_key", "l.judgment", "l.stored_us")


def store(judgments: DataFrame, table: str, *, stored_us: int | None = None) -> None:
    """Insert or replace judgments (cache_key, judgment). Rows without either are left out."""
    at = F.lit(stored_us) if stored_us is not None else F.unix_micros(F.current_timestamp())
    _latest(judgments.select("cache_key", F.col("judgment").cast("string").alias("judgment"), at.cast("long").alias("stored_us"))).write.insertInto(table)


def latest(spark: SparkSession, table: str) -> DataFrame:
    return _latest(spark.table(table)).drop("stored_us")


def compact(spark: SparkSession, table: str) -> None:
    """One row a key. The new files are whole before the old ones go."""
    spec = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    fresh = f"{table}_{uuid.uuid4().hex[:8]}"
    create(spark, fresh, buckets=int(spec["data_type"]))
    _latest(spark.table(table)).write.insertInto(fresh)
    spark.sql(f"DROP TABLE {table}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table.split('.')[-1]}")


def planned(candidates: DataFrame, table: str, *, key: str = "video_id", kind: str = "kind") -> DataFrame:
    """Candidates with their stored judgment, and what is to be done for their video.

    ``outcome`` is "skipped" where the rules suffice, "cache" where every
    candidate of the video has a judgment (those are then used), else "ask": the
    model is asked for the whole video, and ``judgment`` is null.
    """
    known = latest(candidates.sparkSession, table)
    keyed = candidates.withColumn("cache_key", candidate_key(kind)).join(known, "cache_key", "left")
    whole = F.min(F.col("judgment").isNotNull()).over(W.partitionBy(key))
    outcome = keyed.withColumn("whole", whole).join(needs_model(candidates, key=key, kind=kind), key)
    outcome = outcome.withColumn("outcome", F.when(~F.col("needs_model"), "skipped").when(F.col("whole"), "cache").otherwise("ask"))
    return outcome.withColumn("judgment", F.when(F.col("outcome") == "cache", F.col("judgment"))).drop("whole", "needs_model")
