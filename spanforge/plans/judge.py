"""Judgment of candidates: by rules (rejection, type, confidence, description, evidence) and by a model's answers.

All are expressions over candidate rows; what needs captions or hits joins them
by the medium and a bucket of time. Lexicons are parameters with own defaults.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators.intervals import bucketed, context_rows, first_in_span
from spanforge.shared import worked_out

SPEECH = r"asr|intent"
LEAST_SPEECH_S, OPENING_S, OPENING_END_S, CARD_S, CARD_EDGE_S = 8, 1.5, 20, 5, 1.5
#: Words that tell a paid read, a course of one's own and an offer; each is looked for anywhere in the lower-cased text.
SPONSORED, COURSE = ("sponsored", "paid partnership"), ("course", "program", "join")
PROMOTED = ("sponsor", "partnership", "enroll", "use code", "promo code", "discount", "link below", "free months", *COURSE)
COMEDY = r"(?i)(^|[^a-z0-9_])(comedy|funny|prank|joke|skit)([^a-z0-9_]|$)"
# Types of segments.
TYPES = ("preroll", "midroll_sponsor_read", "product_placement", "self_promo", "affiliate", "platform_inserted", "bumper", "other")
#: Seconds of a bucket in joins of candidates with captions and hits.
BUCKET_S = 60.0


def ocr_only(source: Column) -> Column:
    return F.contains(source, F.lit("ocr")) & ~source.rlike(SPEECH)


def _says(said: Column, words: Sequence[str]) -> Column:
    return F.size(T.lexicon_hits(said, words)) > 0


def reject_reason(start: Column, end: Column, source: Column, triggers: Column, blob: Column, score: Column, brand: Column, *, promoted: Sequence[str] = PROMOTED) -> Column:
    """Why a candidate isn't an ad, the first rule that applies; null for accepted ones."""
    has = lambda name: F.coalesce(F.array_contains(triggers, name), F.lit(False))
    phone = has("phone") | T.text(blob).rlike(T.PHONE)
    branded = has("brand_word") | has("service") | (T.text(brand) != "")
    speech = source.rlike(SPEECH)
    return (
        F.when(has("price") & ~has("cta") & ~phone & ~branded, "bare_price")
        .when(T.text(blob).rlike(COMEDY) & ~has("cta"), "comedy")
        .when((score < 2) & ~phone, "weak")
        .when(speech & ~_says(blob, promoted) & ~branded, "no_intent")
        .when(speech & (end - start < LEAST_SPEECH_S) & ~_says(blob, ("sponsored",)), "brief_speech")
    )


def ad_type(kind: Column, start: Column, end: Column, duration: Column, source: Column, said: Column, *, sponsored: Sequence[str] = SPONSORED, course: Sequence[str] = COURSE) -> Column:
    """A paid read (at a long medium's very start a preroll), one's own course by speech, an opening, an end card, a code, else other."""
    opening = (kind == "vod") & (start <= OPENING_S)
    card = (end >= duration - CARD_EDGE_S) & (start >= F.greatest(F.lit(0.0), duration - CARD_S))
    return (
        F.when(_says(said, sponsored), F.when(opening, "preroll").otherwise("midroll_sponsor_read"))
        .when(_says(said, course) & source.rlike(SPEECH), "self_promo")
        .when(opening & (end <= OPENING_END_S), "preroll")
        .when(card, "self_promo")
        .when(_says(said, ("code",)) & _says(said, ("http", "use")), "affiliate")
        .otherwise("other")
    )


def confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.95), 0.55 + 0.05 * F.least(F.lit(8), score)), 4)


def presentation(kind: Column, source: Column, type_: Column, start: Column, end: Column, duration: Column) -> Column:
    """Overlay text alone lies over a short medium, or over a live one that it doesn't fill."""
    fills = (start <= 0.2) & (end >= duration - 0.2)
    return F.when(ocr_only(source) & ((kind == "short") | ((kind == "live") & (type_ == "other") & ~F.coalesce(fills, F.lit(False)))), "overlay")


def signals(source: Column, *extra: str) -> Column:
    """Kinds of evidence, in order; overlay text where there is no other."""
    found = F.array_compact(F.array(*[F.when(F.contains(source, F.lit(s)), F.lit(s)) for s in ("asr", *(x for x in extra if x == "intent"), "ocr")]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("ocr")))


def description(source: Column, triggers: Column, type_: Column) -> Column:
    """A sentence on how a segment was found, with up to eight triggers where they are all there is."""
    some = F.array_join(F.slice(triggers, 1, 8), ", ")
    heard, shown = F.contains(source, F.lit("asr")), F.contains(source, F.lit("ocr"))
    return (
        F.when(ocr_only(source), F.concat(F.lit("Overlay that stays on screen, read as: "), F.when(some == "", "ocr").otherwise(some), F.lit(".")))
        .when(heard & shown, "Spoken promotion that text on screen confirms.")
        .when(heard, "Spoken promotion.")
        .when(type_ == "self_promo", "Promotion of one's own: a course, a contact or an end card.")
        .when(type_ == "preroll", "Commercial before the programme.")
        .otherwise(F.concat(F.lit("Commercial passage."), F.when(some == "", "").otherwise(F.concat(F.lit(" Triggers: "), some, F.lit(".")))))
    )


def with_speech(candidates: DataFrame, captions: DataFrame, *, key: str = "video_id", pad: float = 0.5, name: str = "spoken") -> DataFrame:
    """Candidates with the captions that touch them, widened by ``pad``: "seconds text" a line, in order; null without any."""
    spans = candidates.select(key, "cand_seq", F.col("start_s").alias("__s"), F.col("end_s").alias("__e"))
    rows = bucketed(captions.where(F.trim("text") != "").select(key, "seq", "start_s", "end_s", "text"), F.col("start_s"), F.col("end_s"), BUCKET_S)
    met = rows.join(bucketed(spans, F.col("__s") - pad, F.col("__e") + pad, BUCKET_S), [key, "__bucket"]).where((F.col("end_s") >= F.col("__s") - pad) & (F.col("start_s") <= F.col("__e") + pad))
    once = met.where(F.col("__bucket") == F.floor(F.greatest(F.col("start_s"), F.col("__s") - pad) / BUCKET_S).cast("long"))
    lines = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.format_string("%.1f", "start_s"), F.lit(" "), "text").alias("line"))))
    return candidates.join(once.groupBy(key, "cand_seq").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias(name)), [key, "cand_seq"], "left")


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def judge(candidates: DataFrame, *, known: Mapping[str, str] | None = None, named: Mapping[str, str] | None = None, key: str = "video_id", kind: str = "kind") -> DataFrame:
    """All candidates with reject_reason, and the segment's columns where that is null; ids number the accepted ones by start.

    ``named`` is a table of brands by phrase that goes before all other rules (in its order); ``duration_s``
    and ``spoken`` (of with_speech) are read where they are there.
    """
    duration, spoken = _column(candidates, "duration_s", "double"), _column(candidates, "spoken", "string")
    c = worked_out(candidates, said=F.array_join("texts", " "), blob=T.best_banner(F.col("texts")))
    ours = [F.when(F.contains(F.lower("said"), F.lit(k)), F.lit(v)) for k, v in (named or {}).items()]
    c = worked_out(c, blob=F.when(F.col("blob") == "", F.substring("said", 1, 500)).otherwise(F.col("blob")))
    c = worked_out(c, brand=F.coalesce(*ours, T.title_brand("blob", known)))
    source, triggers = F.col("source"), F.col("raw_triggers")
    c = c.withColumn("reject_reason", reject_reason(F.col("start_s"), F.col("end_s"), source, triggers, F.col("blob"), F.col("score_hint"), F.col("brand")))
    c = c.withColumn("ad_type", ad_type(F.col(kind), F.col("start_s"), F.col("end_s"), duration, source, F.col("said")))
    c = c.withColumn("confidence", confidence(F.col("score_hint"))).withColumn("signals_used", signals(source))
    c = c.withColumn("presentation", presentation(F.col(kind), source, F.col("ad_type"), F.col("start_s"), F.col("end_s"), duration)).withColumn("description", description(source, triggers, F.col("ad_type")))
    heard = F.array_join(F.filter("texts", lambda t: ~t.rlike("^[|>]")), " ")
    heard = F.when(heard == "", F.col("said")).otherwise(heard)
    span = F.when(F.col("presentation").isNotNull() | ocr_only(source), "").otherwise(F.coalesce(spoken, F.when(F.contains(source, F.lit("asr")), heard), F.lit("")))
    c = c.withColumn("transcript_span", F.substring(span, 1, 400)).withColumn("ocr_text", F.when(ocr_only(source), T.overlay_text("blob", F.col("brand"), known)).otherwise(""))
    accepted = F.col("reject_reason").isNull()
    w = W.partitionBy(key).orderBy(F.when(accepted, 0).otherwise(1), "start_s", "cand_seq")
    return c.withColumn("id", F.when(accepted, F.format_string("seg_%02d", F.row_number().over(w)))).drop("said", "blob")


def needs_model(candidates: DataFrame, *, key: str = "video_id", kind: str = "kind") -> DataFrame:
    """For each key whether a hosted model is worth asking: any speech, or an overlay past a long video's opening."""
    worth = F.col("source").rlike(SPEECH) | ((F.col(kind) == "vod") & F.contains("source", F.lit("ocr")) & (F.col("start_s") > 15))
    return candidates.groupBy(key).agg(F.max(worth).alias("needs_model"))


def packets(candidates: DataFrame, captions: DataFrame, hits: DataFrame, *, kind: str = "kind", duration: str = "duration_s", pad: float = 20.0) -> DataFrame:
    """Candidates with what a model is asked, as JSON: the candidate, what is said before, in and after it, and what is shown in it.

    The last 12 lines before, the first 40 in and 12 after, within ``pad`` seconds;
    the first 25 hits with a text, within a second. Overlay text alone is sent without speech.
    """
    key, span = ["video_id"], ["cand_seq"]
    spans = candidates.select("video_id", "cand_seq", "source", F.col("start_s").alias("span_start"), F.col("end_s").alias("span_end"))
    near = context_rows(spans.where(~ocr_only(F.col("source"))).drop("source"), captions.select("video_id", "seq", "start_s", "end_s", "text"), key, pad=pad, before=12, inside=40, after=12, width=BUCKET_S, time="start_s", end="end_s", order="seq", span_id=span)
    line = F.concat(F.format_string("%.1f", "start_s"), F.lit(" "), T.text("text"))
    said = near.groupBy("video_id", "cand_seq").agg(F.array_sort(F.collect_list(F.struct("seq", "part", line.alias("line")))).alias("__said"))
    shown = first_in_span(spans.drop("source"), hits.where("text <> ''").withColumn("__n", F.xxhash64("text", "score")), key, "timestamp_s", 1.0, 25, width=BUCKET_S, span_id=span, order=["timestamp_s", "__n"])
    told = F.concat(F.format_string("%.1f", "timestamp_s"), F.lit(" score="), F.col("score").cast("string"), F.lit(" "), F.substring("text", 1, 220))
    seen = shown.groupBy("video_id", "cand_seq").agg(F.array_sort(F.collect_list(F.struct("rank", told.alias("line")))).alias("__seen"))
    c = candidates.join(said, [*key, *span], "left").join(seen, [*key, *span], "left")
    part = lambda name: F.coalesce(F.array_join(F.transform(F.filter("__said", lambda r: r["part"] == name), lambda r: r["line"]), "\n"), F.lit(""))
    body = F.struct(
        F.col(kind).alias("kind"),
        F.col(duration).alias("video_duration_s"),
        F.struct("start_s", "end_s", "source", F.slice("raw_triggers", 1, 12).alias("rule_triggers")).alias("candidate"),
        part("before").alias("transcript_before"),
        part("span").alias("transcript_span"),
        part("after").alias("transcript_after"),
        F.coalesce(F.array_join(F.transform("__seen", lambda r: r["line"]), "\n"), F.lit("")).alias("ocr_in_span"),
    )
    return c.withColumn("packet", F.to_json(body)).drop("__said", "__seen")


_ANSWER = "decision string, start_s double, end_s double, ad_type string, brand string, confidence double, description string"


def from_answers(answered: DataFrame, *, answer: str = "answer", duration: str = "duration_s", kind: str = "kind", known: Mapping[str, str] | None = None) -> DataFrame:
    """Segments from candidates and a model's raw answers to them: repaired JSON, decisions for an ad alone, times inside the medium.

    Missing times are the candidate's; a segment lasts 0.3 seconds at least; unknown types are
    "other", a missing or zero confidence is 0.8. Overlay text alone keeps its banner as evidence, other segments what is spoken (of with_speech).
    """
    a = answered.withColumn("__a", F.from_json(T.first_json(answer), _ANSWER)).where(F.upper("__a.decision") == "AD")
    source, end_of = F.col("source"), F.col(duration)
    inside = lambda c: F.least(c, end_of)
    start = F.greatest(F.lit(0.0), inside(F.coalesce("__a.start_s", "start_s")))
    a = a.withColumn("__start", start).withColumn("__end", F.greatest(F.col("__start") + 0.3, inside(F.coalesce("__a.end_s", "end_s"))))
    only, said = ocr_only(source), F.substring(F.array_join("texts", " "), 1, 500)
    a = worked_out(a, __blob=T.best_banner(F.col("texts")))
    a = worked_out(a, __blob=F.when(F.col("__blob") == "", said).otherwise(F.col("__blob")))
    named = F.substring(T.text("__a.brand"), 1, 80)
    a = a.withColumn("brand", F.when(only & (named == ""), T.title_brand("__blob", known)).otherwise(named))
    cleaned = F.get(F.transform(F.array(T.clean_banner("__blob", known)), lambda x: F.when(x == "", F.col("__blob")).otherwise(x)), F.lit(0))
    lead = F.lower(F.split(F.col("brand"), r"[\x20\x09-\x0D]+")[0])
    shown = F.get(F.transform(F.array(cleaned), lambda x: F.when((F.col("brand") == "") | F.contains(F.lower(x), lead), x).when(x == "", F.col("brand")).otherwise(F.concat(F.col("brand"), F.lit(" | "), x))), F.lit(0))
    triggers = F.when(F.size("raw_triggers") > 0, F.array_join(F.slice("raw_triggers", 1, 8), ", ")).otherwise("ocr")
    told = F.trim(T.text("__a.description"))
    told = F.when(told != "", told).when(only, F.concat(F.lit("Overlay that stays on screen, read as: "), triggers, F.lit("."))).otherwise("Decided by the model.")
    heard = F.array_compact(F.array(*[F.when(F.contains(source, F.lit(s)), F.lit(s)) for s in ("asr", "intent", "ocr")], F.lit("llm")))
    out = {
        "ad_type": F.when(F.col("__a.ad_type").isin(*TYPES), F.col("__a.ad_type")).otherwise("other"),
        "confidence": F.coalesce(F.nullif("__a.confidence", F.lit(0.0)), F.lit(0.8)),
        "brand": F.col("brand"),
        "description": F.substring(told, 1, 400),
        "frame_timestamps": F.filter("frame_timestamps", lambda f: (f >= F.col("__start") - 1) & (f <= F.col("__end") + 1)),
        "transcript_span": F.when(only, "").otherwise(F.substring(T.text(_column(answered, "spoken", "string")), 1, 500)),
        "ocr_text": F.when(only, shown).otherwise(""),
        "signals_used": F.when(only, F.array(F.lit("ocr"))).otherwise(heard),
        "presentation": F.when(only & (F.col(kind) == "short"), "overlay"),
        "start_s": F.round("__start", 2),
        "end_s": F.round("__end", 2),
    }
    rest = [c for c in answered.columns if c not in out and c not in (answer, "spoken")]
    return a.select(*rest, *[v.alias(k) for k, v in out.items()])


def answered(candidates: DataFrame, answers: DataFrame, key: str = "video_id", index: str = "cand_seq") -> DataFrame:
    """Candidates joined with judgments by index; a missing index drops the candidate."""
    return candidates.join(answers, [key, index])
