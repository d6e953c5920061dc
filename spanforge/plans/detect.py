"""The batch plan: hits, captions and cuts to segments, by one shuffle on the video for each step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import islands
from spanforge.operators.folds import rolling_dedupe
from spanforge.operators.intervals import overlap_flag, refined_start, snap_nearest
from spanforge.plans.judge import SPEECH, answered, from_answers, judge, needs_model, with_speech
from spanforge.plans.proposers import intents
from spanforge.shared import checkpoint

GROUP_GAP_S, SPEECH_GAP_S, SERIES_GAP_S, MERGE_GAP_S, SNAP_S = 16.0, 45.0, 150.0, 15.0, 0.75
MERGEABLE = ("self_promo", "midroll_sponsor_read", "other", "affiliate")
KEY = ("video_id",)


def _distinct_sorted(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def _rollup(df: DataFrame, group: str, source: Column) -> DataFrame:
    """A candidate a group; lists keep the rows' order."""
    rows = F.array_sort(F.collect_list(F.struct("start_s", "seq", "text")))
    return df.groupBy("video_id", group).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), source.alias("source"), _distinct_sorted("triggers").alias("raw_triggers"), rows.alias("rows"), F.sum("score").cast("int").alias("score_hint")).select(
        "video_id", "start_s", "end_s", "source", "raw_triggers", F.transform("rows", lambda r: r["text"]).alias("texts"), F.transform("rows", lambda r: r["start_s"]).alias("frame_timestamps"), "score_hint"
    )


def overlay_candidates(hits: DataFrame, media: DataFrame, *, least: int = 2) -> DataFrame:
    """Groups of hot overlay hits: near in time, or sharing a word of over three letters with the hit before; a group near the end reaches it."""
    hot = hits.where(F.col("score") >= least).select("video_id", F.col("timestamp_s").alias("start_s"), F.col("timestamp_s").alias("end_s"), F.lit(0).alias("seq"), "text", "score", "triggers")
    tokens = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 3)
    grouped = islands.gap_groups(hot.withColumn("tokens", tokens), KEY, "start_s", "end_s", ["start_s", "text", "seq"], GROUP_GAP_S, tokens="tokens")
    c = _rollup(grouped, "grp", F.lit("ocr")).join(media.select("video_id", "duration_s"), "video_id")
    return c.withColumn("end_s", F.when(F.col("duration_s") - F.col("end_s") <= GROUP_GAP_S, F.col("duration_s")).otherwise(F.col("end_s"))).drop("duration_s")


def first_of(texts: Column, head: int = 80, most: int = 10) -> Column:
    """Texts that differ in their first ``head`` characters, the first ``most`` of them."""
    fresh = lambda acc, t: F.when((F.size(acc) < most) & ~F.exists(acc, lambda k: F.substring(k, 1, head) == F.substring(t, 1, head)), F.array_append(acc, t)).otherwise(acc)
    return F.aggregate(texts, F.expr("CAST(array() AS array<string>)"), fresh)


def speech_candidates(captions: DataFrame, media: DataFrame, strong: Sequence[str], medium: Sequence[str], series: str, *, least: int = 2, within: float = 3.0, guard: Sequence[str] = (), waive: Sequence[str] = ()) -> DataFrame:
    """Groups of caption lines with promotional phrases, once rolling captions are folded; lines of one series (a course, say) stay together longer.

    A group starts at its first hot line of all captions from a second before it, ends inside the medium and keeps its first texts.
    """
    lines = rolling_dedupe(captions, KEY, order="seq", start="start_s", end="end_s", text="text", within=within)
    scored = lambda df: df.withColumn("score", T.lexicon_score("text", strong, medium, guard=guard, waive=waive)).where(F.col("score") >= least)
    hot = scored(lines).withColumn("triggers", T.lexicon_hits("text", [*strong, *medium]))
    grouped = islands.two_level_groups(hot, KEY, "start_s", "end_s", ["start_s", "seq"], SPEECH_GAP_S, SERIES_GAP_S, F.col("text").rlike(series))
    c = _rollup(grouped, "grp", F.lit("asr")).withColumn("texts", first_of(F.col("texts"))).withColumn("raw_triggers", F.slice("raw_triggers", 1, 12)).withColumn("frame_timestamps", F.expr("CAST(array() AS array<double>)"))
    c = c.join(media.select("video_id", "duration_s"), "video_id").withColumn("end_s", F.least("end_s", "duration_s")).drop("duration_s")
    spans = c.withColumnRenamed("start_s", "span_start").withColumnRenamed("end_s", "span_end")
    refined = refined_start(spans, scored(captions), KEY, time="start_s", width=60.0)
    return refined.withColumnRenamed("span_start", "start_s").withColumnRenamed("span_end", "end_s").select(*c.columns)


def intent_candidates(captions: DataFrame, media: DataFrame, promo: Sequence[dict[str, int]], anti: Sequence[dict[str, int]], phrases: Sequence[str]) -> DataFrame:
    """The best windows of speech by intent, as candidates."""
    lines = captions.join(media.select("video_id", "duration_s"), "video_id")
    until = lines.withColumn("until", F.greatest("duration_s", F.max("end_s").over(W.partitionBy("video_id"))))
    found = intents(until, promo, anti, phrases, until="until").join(media.select("video_id", "duration_s"), "video_id")
    return found.select(
        "video_id",
        F.col("win_start").alias("start_s"),
        F.least("win_end", "duration_s").alias("end_s"),
        F.lit("intent").alias("source"),
        F.col("reasons").alias("raw_triggers"),
        F.array(F.substring("text", 1, 500)).alias("texts"),
        F.expr("CAST(array() AS array<double>)").alias("frame_timestamps"),
        F.greatest(F.lit(2), F.floor(F.col("score") * 10).cast("int")).alias("score_hint"),
    )


def drop_incidental(candidates: DataFrame, media: DataFrame) -> DataFrame:
    """Overlays of long media stay at the opening, at the end or beside speech; editorial ones only beside speech."""
    c = candidates.join(media.select("video_id", "kind", "duration_s"), "video_id")
    c = overlap_flag(c, candidates.where(F.col("source").rlike(SPEECH)), KEY, 60.0, start="start_s", end="end_s", name="beside")
    edge = ((F.col("start_s") <= 8) & (F.col("end_s") - F.col("start_s") <= 30)) | (F.col("start_s") >= F.greatest(F.lit(0.0), F.col("duration_s") - 20))
    editorial = F.array_join("texts", " ").rlike(T.EDITORIAL)
    keep = (F.col("kind") == "short") | F.col("source").rlike(SPEECH) | F.col("beside") | (edge & ~editorial)
    return c.where(F.coalesce(keep, F.lit(False))).drop("beside", "kind", "duration_s")


def union_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates whose gap is GROUP_GAP_S at most become one."""
    ranked = candidates.withColumn("rank", F.when(F.startswith("source", F.lit("ocr")), 0).when(F.startswith("source", F.lit("asr")), 1).otherwise(2))
    g = islands.interval_groups(ranked, KEY, "start_s", "end_s", ["start_s", "rank", "end_s"], GROUP_GAP_S)
    rows = F.array_sort(F.collect_list(F.struct("start_s", "rank", "end_s", "source", "texts", "frame_timestamps")))
    out = g.groupBy("video_id", "grp").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), _distinct_sorted("raw_triggers").alias("raw_triggers"), F.sum("score_hint").cast("int").alias("score_hint"), rows.alias("rows"))
    return out.select("video_id", F.col("grp").cast("int").alias("cand_seq"), "start_s", "end_s", F.array_join(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.split(r["source"], r"\+")))), "+").alias("source"), "raw_triggers", F.flatten(F.transform("rows", lambda r: r["texts"])).alias("texts"), F.flatten(F.transform("rows", lambda r: r["frame_timestamps"])).alias("frame_timestamps"), "score_hint")


def snap(segments: DataFrame, cuts: DataFrame, media: DataFrame) -> DataFrame:
    """Ends move to the nearest cut, inside the medium; an empty segment lasts half a second."""
    instants = cuts.select("video_id", F.col("cut_s"), F.col("cut_seq"), F.col("cut_s").alias("start_s"), F.col("cut_s").alias("end_s"))
    s = segments
    for end in ("start_s", "end_s"):
        s = snap_nearest(s, instants.select("video_id", F.col("cut_s").alias(end), "cut_seq"), KEY, end, SNAP_S, seq="cut_seq", name="__to").withColumn(end, F.col("__to")).drop("__to")
    s = s.join(media.select("video_id", "duration_s"), "video_id")
    inside = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.col("duration_s"))
    s = s.withColumn("start_s", inside(F.col("start_s"))).withColumn("end_s", inside(F.col("end_s")))
    s = s.withColumn("end_s", F.when(F.col("end_s") <= F.col("start_s"), inside(F.col("start_s") + 0.5)).otherwise(F.col("end_s")))
    return s.withColumn("start_s", F.round("start_s", 2)).withColumn("end_s", F.round("end_s", 2)).drop("duration_s")


def merge_segments(segments: DataFrame) -> DataFrame:
    """Neighbours of one mergeable type, brand and presentation within MERGE_GAP_S become one; evidence is joined, each text once, and cut."""
    g = islands.keyed_interval_groups(segments, KEY, ["ad_type", "brand", "presentation"], "start_s", "end_s", ["start_s", "end_s", "cand_seq"], MERGE_GAP_S, mergeable=F.col("ad_type").isin(*MERGEABLE))
    kept = ("ocr_text", "transcript_span", "description")
    rows = F.array_sort(F.collect_list(F.struct("start_s", "end_s", "cand_seq", *kept, "signals_used")))
    joined = lambda name, most: F.substring(F.aggregate(F.transform("rows", lambda r: T.text(r[name])), F.lit(""), lambda a, t: F.when((t == "") | F.contains(a, t), a).when(a == "", t).otherwise(F.concat(a, F.lit(" | "), t))), 1, most)
    out = g.groupBy("video_id", "grp").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.first("ad_type").alias("ad_type"), F.first("brand").alias("brand"), F.first("presentation").alias("presentation"), F.max("confidence").alias("confidence"), _distinct_sorted("frame_timestamps").alias("frames"), rows.alias("rows"))
    signals = F.array_distinct(F.flatten(F.transform("rows", lambda r: r["signals_used"])))
    return out.select("video_id", F.format_string("seg_%02d", F.col("grp").cast("int")).alias("id"), "start_s", "end_s", "ad_type", "confidence", "brand", F.get("rows", F.lit(0))["description"].alias("description"), "presentation", F.slice("frames", 1, 12).alias("frame_timestamps"), joined("transcript_span", 400).alias("transcript_span"), joined("ocr_text", 500).alias("ocr_text"), signals.alias("signals_used"))


#: Segment columns of judged candidates.
JUDGED = ("video_id", "cand_seq", "start_s", "end_s", "ad_type", "confidence", "brand", "description", "presentation", "frame_timestamps", "transcript_span", "ocr_text", "signals_used")


def united(media: DataFrame, hits: DataFrame, captions: DataFrame, *, strong: Sequence[str], medium: Sequence[str], series: str, promo: Sequence[dict[str, int]] = (), anti: Sequence[dict[str, int]] = (), phrases: Sequence[str] = (), guard: Sequence[str] = (), waive: Sequence[str] = ()) -> DataFrame:
    """Candidates: overlays, speech and intents are proposed, incidental overlays go, the rest are united.

    What is proposed is written once (a checkpoint), as the next steps read it several times.
    """
    proposed = overlay_candidates(hits, media).unionByName(speech_candidates(captions, media, strong, medium, series, guard=guard, waive=waive))
    if promo or phrases:
        proposed = proposed.unionByName(intent_candidates(captions, media, promo, anti, phrases))
    return union_candidates(drop_incidental(checkpoint(proposed), media)).join(media.select("video_id", "kind", "duration_s"), "video_id")


def detect(media: DataFrame, hits: DataFrame, captions: DataFrame, cuts: DataFrame, *, strong: Sequence[str], medium: Sequence[str], series: str = r"(?i)(^|[^a-z])(course|class|lesson|batch)([^a-z]|$)", answers: DataFrame | None = None, known: dict[str, str] | None = None, named: dict[str, str] | None = None, **lexicons) -> DataFrame:
    """Segments: propose, filter, unite (in this order), judge, snap, merge.

    ``answers`` (video_id, cand_seq, answer) are a model's: media that are worth
    asking about and have any are judged by these, all others by the rules.
    """
    candidates = with_speech(united(media, hits, captions, strong=strong, medium=medium, series=series, **lexicons), captions)
    if answers is None:
        accepted = judge(candidates, known=known, named=named).where("reject_reason IS NULL").select(*JUDGED)
    else:
        asked = needs_model(candidates).where("needs_model").join(answers.select("video_id").distinct(), "video_id", "left_semi").select("video_id")
        by_model = from_answers(answered(candidates.join(asked, "video_id", "left_semi"), answers), known=known)
        by_rule = judge(candidates.join(asked, "video_id", "left_anti"), known=known, named=named).where("reject_reason IS NULL")
        accepted = by_model.select(*JUDGED).unionByName(by_rule.select(*JUDGED))
    return merge_segments(snap(accepted, cuts, media))
