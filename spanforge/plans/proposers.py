"""Live proposers, run statistics and small projections of results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators.islands import persistent
from spanforge.operators.sampling import bhattacharyya
from spanforge.operators.windows import hopping_text, intent_reasons, intent_score, suppressed_top
from spanforge.streaming.captions import LOOK_BACK_S, look_back

HARD_CUT, SOFT_CUT, FORGET_S, LASTING_S, STALL_S = 0.35, 0.28, 6.0, 8.0, 12.0


def spot(ticks: DataFrame, *, strong_brands: Sequence[str] = (), known: Mapping[str, str] | None = None) -> DataFrame:
    """A candidate without length for each region whose text scores 2 or more now."""
    scored = ticks.withColumn("score", T.live_score("raw_text", strong_brands)).where((F.col("score") >= 2) & ~F.col("is_chrome"))
    return scored.select("session_id", "now_s", F.col("now_s").alias("start_s"), F.col("now_s").alias("end_s"), F.lit("ocr_spot").alias("source"), F.col("roi_name").alias("roi"), T.signature("raw_text", known).alias("signature"), F.col("raw_text").alias("text"), "score")


def lasting(ticks: DataFrame, *, known: Mapping[str, str] | None = None) -> DataFrame:
    """Candidates of brands that a region has shown for LASTING_S without a pause over FORGET_S."""
    seen = ticks.where("is_brand AND NOT is_chrome").withColumn("signature", T.signature("raw_text", known)).where("signature <> ''")
    tracks = persistent(seen, ["session_id", "roi_name", "signature"], "now_s", ["now_s"], forget=FORGET_S, least=LASTING_S)
    return tracks.where("proposed").select("session_id", F.col("first_seen").alias("start_s"), F.col("last_seen").alias("end_s"), F.concat(F.lit("ocr_persist_"), "roi_name").alias("source"), F.col("roi_name").alias("roi"), "signature", F.lit(3).alias("score"))


def scene_breaks(frames: DataFrame, *, hist: str = "hist", text: str = "text", score: Callable[[Column], Column] = T.live_score) -> DataFrame:
    """Scored texts at changes of scene: texts are read, and proposed if they score 2, from SOFT_CUT on; HARD_CUT makes a cut."""
    w = W.partitionBy("session_id").orderBy("now_s")
    moved = frames.withColumn("distance", bhattacharyya(F.lag(hist).over(w), F.col(hist))).where(F.col("distance") >= SOFT_CUT)
    sensed = moved.withColumn("score", score(F.col(text))).where("score >= 2")
    return sensed.select("session_id", F.col("now_s").alias("start_s"), F.col("now_s").alias("end_s"), F.lit("ocr_break").alias("source"), F.col(text).alias("text"), "score", "distance", (F.col("distance") >= HARD_CUT).alias("is_cut"))


def intents(captions: DataFrame, promo: Sequence[dict[str, int]], anti: Sequence[dict[str, int]], phrases: Sequence[str], *, key: str = "video_id", least: float = 0.18, width: float = 25.0, hop: float = 12.0, apart: float = 15.0, k: int = 5, until: str | None = None) -> DataFrame:
    """The best windows of speech by intent, none near another, with their reasons. ``until`` is a column with the medium's end."""
    win = hopping_text(captions, [key], start="start_s", end="end_s", text="text", order="seq", width=width, hop=hop, until=until)
    tokens, hits = T.words("text"), T.lexicon_hits("text", phrases)
    scored = win.withColumn("score", F.round(intent_score(F.size(hits), tokens, promo, anti), 6)).where(F.col("score") >= least).withColumn("reasons", intent_reasons(hits, tokens, promo, anti))
    top = suppressed_top(scored, [key], score="score", start="win_start", seq="win", apart=apart, k=k)
    return top.join(scored.select(key, "win", "win_end", "text", "reasons"), [key, "win"])


def live_captions(captions: DataFrame, ticks: DataFrame) -> DataFrame:
    """Captions of the last LOOK_BACK_S of each tick, cut at the tick; a stream's are read as they come."""
    return look_back(captions, ticks, back=LOOK_BACK_S)


def live_intents(captions: DataFrame, ticks: DataFrame, promo: Sequence[dict[str, int]], anti: Sequence[dict[str, int]], phrases: Sequence[str], **kw) -> DataFrame:
    """The best windows of speech that each tick of a session can see."""
    seen = live_captions(captions, ticks).withColumn("tick", F.struct("session_id", "now_s"))
    first = F.min("start_s").over(W.partitionBy("tick"))
    moved = seen.withColumn("__at", first).withColumns({"start_s": F.col("start_s") - F.col("__at"), "end_s": F.col("end_s") - F.col("__at")})
    at = moved.groupBy("tick").agg(F.first("__at").alias("__at"))
    found = intents(moved, promo, anti, phrases, key="tick", **kw).join(at, "tick")
    return found.select("tick.session_id", "tick.now_s", (F.col("win_start") + F.col("__at")).alias("start_s"), F.least(F.col("win_end") + F.col("__at"), F.col("tick.now_s")).alias("end_s"), "score", "reasons", "text")


def stalls(ticks: DataFrame, arrived: str = "arrived_s") -> DataFrame:
    """One row for each pause of STALL_S or more between arrivals of a session."""
    w = W.partitionBy("session_id").orderBy(arrived)
    return ticks.withColumn("pause_s", F.col(arrived) - F.lag(arrived).over(w)).where(F.col("pause_s") >= STALL_S).select("session_id", arrived, "pause_s")


def quantile_95(df: DataFrame, key: Sequence[str], value: str, name: str = "p95") -> DataFrame:
    """The value at rank 0.95 (n + 1) of a key's values, between its neighbours in proportion; the largest below 20 values.

    Equal values are counted map-side, so a key's window holds its distinct values alone.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    w = W.partitionBy(*key).orderBy("__v")
    c = counted.withColumn("__upto", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(W.partitionBy(*key)))
    rank = F.floor(F.lit(19) * (F.col("__all") + 1) / 20)
    at = lambda r: F.min(F.when(F.col("__upto") >= r, F.col("__v")))
    found = c.groupBy(*key).agg(F.max("__all").alias("__all"), F.max("__v").alias("__top"), at(rank).alias("__low"), at(rank + 1).alias("__high"))
    share = (19 * (F.col("__all") + 1)) % 20
    return found.select(*key, F.when(F.col("__all") < 20, F.col("__top")).otherwise((F.col("__low") * (20 - share) + F.col("__high") * share) / 20).alias(name))


def run_statistics(ticks: DataFrame, *, key: str = "session_id", value: str = "tick_ms", cost_per_call: float = 0.002) -> DataFrame:
    """Counts, mean and the 95th of 100 (quantile_95) of a session's ticks, and costs."""
    s = ticks.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum("model_calls").alias("model_calls"), F.avg("ocr_calls").alias("mean_ocr"))
    s = s.join(quantile_95(ticks, [key], value), key, "left")
    return s.select(key, "n", F.round("mean", 4).alias("mean"), "p95", "model_calls", F.round(F.col("model_calls") * cost_per_call, 4).alias("cost"), F.round("mean_ocr", 4).alias("mean_ocr"))


def summary(c: Column, most: int = 80) -> Column:
    """Open or emitted intervals without their evidence, texts cut."""
    return F.transform(c, lambda t: F.struct(F.round(t["start_s"], 2).alias("start_s"), F.round(t["end_s"], 2).alias("end_s"), t["source"].alias("source"), F.substring(t["text"], 1, most).alias("text")))


def seek_bar(segments: DataFrame, duration: str = "duration_s") -> DataFrame:
    """Left edge and width of each segment in percent of its medium."""
    return segments.withColumn("left_pct", F.round(100 * F.col("start_s") / F.col(duration), 3)).withColumn("width_pct", F.round(100 * (F.col("end_s") - F.col("start_s")) / F.col(duration), 3))


def longest_text(df: DataFrame, key: Sequence[str], text: str, seq: str) -> DataFrame:
    """The longest text of a key, the first by ``seq`` among equals."""
    return df.groupBy(*key).agg(F.max_by(text, F.struct(F.length(text), -F.col(seq))).alias(text))
