"""Gold and predicted results, and judgment caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.functions.text import cache_key
from spanforge.functions.urls import video_id


def _segments(videos: DataFrame, named: Column | None = None) -> DataFrame:
    content = F.nullif(video_id(F.col("source.url")), F.lit(""))
    rows = videos.select(F.coalesce(*([named] if named is not None else []), content, F.lit("")).alias("video_id"), F.posexplode_outer("segments").alias("seq", "seg"))
    return rows.select("video_id", F.col("seq").cast("long").alias("seq"), F.col("seg.start_s").alias("start_s"), F.col("seg.end_s").alias("end_s"), F.col("seg.ad_type").alias("ad_type"), F.col("seg.brand").alias("brand"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    videos = spark.read.schema(schemas.GOLD).option("multiLine", True).json(path).select(F.explode("videos").alias("v")).select("v.*")
    return _segments(videos)


def read_predictions(spark: SparkSession, path: str, gold: DataFrame | None = None) -> DataFrame:
    """Segments of prediction files, keyed by the video: the one of ``gold`` that the file is named after, else the one in its content."""
    files = spark.read.schema(schemas.PREDICTION).option("multiLine", True).json(path).select("source", "segments", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[A-Za-z]+)?$", 1).alias("stem"))
    named = _segments(files) if gold is None else _segments(files.join(gold.select(F.col("video_id").alias("stem")).distinct().withColumn("known", F.lit(True)), "stem", "left"), F.when(F.col("known"), F.col("stem")))
    return named


def candidate_key(kind: str = "kind") -> Column:
    """A candidate's key in a store of judgments: its kind, source, times and the first 400 characters of its texts."""
    return cache_key(F.col(kind), F.col("source"), F.format_string("%.2f", "start_s"), F.format_string("%.2f", "end_s"), F.substring(F.array_join("texts", " "), 1, 400), F.lit(""))


def with_cache(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Candidates with their key and, where the cache has it, the stored judgment (else null)."""
    return candidates.withColumn("cache_key", candidate_key()).join(cache.select("cache_key", "judgment"), "cache_key", "left")


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """Overlay hits as tab-separated lines, blanks of their texts made spaces."""
    line = hits.select(F.concat_ws("\t", F.format_string("%.2f", "timestamp_s"), F.col("score").cast("string"), F.array_join("triggers", ","), F.regexp_replace("text", r"[\x09-\x0D]+", " ")).alias("value"))
    line.write.mode("overwrite").text(path)


def write_captions(captions: DataFrame, path: str, most: int = 400) -> None:
    """The first ``most`` caption lines of each video, a file folder a video."""
    first = captions.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy("seq"))).where(F.col("rank") <= most)
    first.select("video_id", "rank", F.concat(F.format_string("[%.2f-%.2f] ", "start_s", "end_s"), "text").alias("line")).repartition("video_id").sortWithinPartitions("video_id", "rank").drop("rank").write.mode("overwrite").partitionBy("video_id").text(path)
