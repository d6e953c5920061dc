"""Queries of live sessions over the driver's tables, through the machines that streams run.

A user's events make a session. Its time is in hours since the user's first
event, told in ticks of two; the standing limits (6 of silence, 180 at most)
then count hours.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators.similar import similar
from spanforge.plans.detect import detect
from spanforge.shared import checkpoint, remove, shared_dir
from spanforge.sources import cache
from spanforge.streaming import live

TICK_H = 2
SOURCES = (("view", "asr"), ("click", "ocr"), ("purchase", "ocr_persist_tr"), ("signup", "ocr+intent"))


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole minutes since the user's first."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.withColumn("m", F.floor((F.col("us") - F.min("us").over(W.partitionBy("user_id"))) / 60_000_000).cast("long"))


def _told(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SOURCES for x in pair])[kind], F.lit("ocr"))


def live_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of all sessions up to the one after the last event, which ends the session; each with the events that began since the one before."""
    m = _minutes(spark, sf_dir)
    text = F.concat("event_type", F.lit(" x"), F.regexp_extract(F.coalesce("props", F.lit("")), "([0-9]+)", 1))
    cand = F.struct(
        (F.col("m") / 60).alias("start_s"),
        ((F.col("m") + F.floor("value").cast("long")) / 60).alias("end_s"),
        _told(F.col("event_type")).alias("source"),
        F.array("event_type").alias("raw_triggers"),
        F.array(text).alias("texts"),
        F.array(F.col("m") / 60).alias("frame_timestamps"),
        F.pmod(F.floor("value"), F.lit(4)).cast("int").alias("score_hint"),
    )
    at = m.withColumn("tick", F.floor(F.col("m") / (60 * TICK_H)).cast("long") + 1).where("tick IS NOT NULL")
    said = at.groupBy("user_id", "tick").agg(F.array_sort(F.collect_list(F.struct("m", "event_id", cand.alias("c")))).alias("cands"))
    # A user's first event is in tick 1; each tick with events is followed by the silent ones before the next, so no clock is joined and rows stay dealt by user.
    spans = said.withColumn("next", F.lead("tick").over(W.partitionBy("user_id").orderBy("tick")))
    rows = spans.select("user_id", "tick", "next", "cands", F.explode(F.sequence(F.col("tick"), F.coalesce(F.col("next") - 1, F.col("tick")))).alias("now"))
    return rows.select(F.col("user_id").cast("string").alias("session_id"), (F.col("now") * TICK_H).cast("double").alias("now_s"), F.when(F.col("now") == F.col("tick"), F.transform("cands", lambda c: c["c"])).alias("cands"), F.col("next").isNull().alias("is_end"))


def live_tracks(spark, d):
    """Tracks that were committed, with all their evidence."""
    e = live.replay(live_ticks(spark, d), kinds=["emitted"])
    return e.select(
        F.col("session_id").cast("long").alias("user_id"),
        F.col("track").cast("long").alias("track"),
        F.col("now_s").cast("long").alias("now_h"),
        F.round("start_s", 4).alias("start_h"),
        F.round("end_s", 4).alias("end_h"),
        "source",
        "signature",
        F.array_join("triggers", ",").alias("triggers"),
        F.md5(F.array_join("texts", "|")).alias("texts_md5"),
        F.size("frame_timestamps").cast("long").alias("n_frames"),
        F.col("score").cast("long").alias("score"),
    )


def live_log(spark, d):
    """The last 50 numbered events of each session: what is open or committed at which tick, and the end."""
    e = live.replay(live_ticks(spark, d), columns=["session_id", "seq", "now_s", "event", "status", "track", "end_s"], most=50)
    return e.select(F.col("session_id").cast("long").alias("user_id"), "seq", F.col("now_s").cast("long").alias("now_h"), "event", "status", F.col("track").cast("long").alias("track"), F.round("end_s", 4).alias("end_h"))


def judgment_cache(spark, d):
    """Events as candidates of a user's medium; those of two users in three are stored in whole, the others' from a value of 5 on, then each user's are looked up."""
    m = _minutes(spark, d)
    kind = F.when(F.col("user_id") % 2 == 0, "vod").otherwise("short")
    text = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    c = m.select("user_id", "event_id", "value", F.col("m").cast("double").alias("start_s"), (F.col("m") + 9).cast("double").alias("end_s"), _told(F.col("event_type")).alias("source"), F.array(text).alias("texts"), kind.alias("kind"))
    name, path = f"judgments_{uuid.uuid4().hex}", f"{shared_dir(spark).rstrip('/')}/judgments-{uuid.uuid4().hex}"
    cache.create(spark, name, buckets=8, path=path)
    known = c.where((F.col("user_id") % 3 > 0) | (F.col("value") >= 5)).withColumn("cache_key", cache.candidate_key())
    cache.store(known.select("cache_key", F.concat(F.lit("old "), text_of_event()).alias("judgment")), name, stored_us=1)
    cache.store(known.where("value >= 20").select("cache_key", F.concat(F.lit("new "), text_of_event()).alias("judgment")), name, stored_us=2)
    found = checkpoint(cache.planned(c, name, key="user_id").select("user_id", "event_id", "cache_key", "outcome", "judgment"))
    spark.sql(f"DROP TABLE {name}")
    remove(spark, path)
    return found


def text_of_event() -> Column:
    return F.get("texts", F.lit(0))


def similar_bags(spark, d):
    """Conversations and benchmark items whose words over three letters have a cosine of 0.15 or more."""
    words = lambda t: F.filter(F.split(F.lower(T.text(t)), "[^a-z]+"), lambda w: F.length(w) > 3)
    said = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", words("text").alias("tokens"))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", words("text").alias("tokens"))
    pairs = similar(said.select(F.struct("conv_id", "turn").alias("said"), "tokens"), items, "said", "item_id", least=0.15)
    return pairs.select("said.conv_id", "said.turn", "item_id", F.round("cosine", 6).alias("cosine"))


#: What an event shows on screen.
SHOWN = (("view", "breaking interview"), ("click", "Acme Foods buy now"), ("purchase", "tile cleaning, 74169 02233"), ("signup", "Rs 499 only"))


def detect_segments(spark, d):
    """The whole batch plan: conversations as captions of media, events of the user with a conversation's number as what its medium shows, cuts before each turn."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("seq"), (F.col("turn") * 10.0).alias("start_s"), (F.col("turn") * 10.0 + 8).alias("end_s"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("lang"))
    media = turns.groupBy("video_id").agg((F.max("end_s") + 30).alias("duration_s")).withColumn("kind", F.when(F.col("duration_s") > 60, "vod").otherwise("short"))
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("video_id"), "event_id", "event_type").join(media, "video_id")
    text = F.coalesce(F.create_map(*[F.lit(x) for pair in SHOWN for x in pair])[F.col("event_type")], F.lit(""))
    at = e.select("video_id", (F.col("event_id") % F.col("duration_s").cast("long")).cast("double").alias("timestamp_s"), text.alias("text"))
    hits = at.select("video_id", "timestamp_s", "text", T.class_score("text").alias("score"), T.class_triggers("text").alias("triggers"))
    cuts = turns.where("seq > 0").select("video_id", (F.col("start_s") - 0.4).alias("cut_s"), F.col("seq").alias("cut_seq"))
    found = detect(media, hits, turns, cuts, strong=("with", "avec", "nicht"), medium=("from", "dans", "this"), series="(?i)that|les", promo=[{"with": 2, "from": 1}], anti=[{"the": 1, "and": 1}], phrases=("with", "from", "dans"), named={"acme": "Acme"})
    return found.select(F.col("video_id").cast("long").alias("conv_id"), "id", F.round("start_s", 2).alias("start_s"), F.round("end_s", 2).alias("end_s"), "ad_type", F.round("confidence", 4).alias("confidence"), "brand", "description", "presentation", F.array_join("signals_used", ",").alias("signals"), F.md5("transcript_span").alias("span_md5"), F.md5("ocr_text").alias("ocr_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (live_tracks, live_log, judgment_cache, similar_bags, detect_segments)}
