"""Queries over the driver's tables, one an operator, and the SQL that they are compared with.

The tables play roles: events are timestamped hits of a user, conversations are
caption lines, documents are texts, pages are URLs and markup, embeddings are
thumbnails or histograms, labels are gold flags. Words that the synthetic texts
hold stand in for lexicons. Whole tables are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.functions import urls as U
from spanforge.operators import evaluate, folds, intervals, islands, sampling, windows
from spanforge.plans import judge as J
from spanforge.plans import proposers as P
from spanforge.plans.detect import drop_incidental, union_candidates
from spanforge.shared import worked_out
from spanforge.sources.captions import best_track, cues, transcript
from spanforge.sources.captions import language_rank as rank_of

#: Six hours and one hour in microseconds.
GAP_US, HOUR_US = 21_600_000_000, 3_600_000_000
STRONG, MEDIUM, GUARD = ("thered", "tionent", "eneau"), ("with", "from", "this", "dans", "nicht"), ("stupid", "idiot")
DEMO_CLASSES = (("price", r"[0-9]{3,}", 2), ("offer", r"(^|[^a-z])(with|avec|mit)([^a-z]|$)", 2), ("cta", r"(^|[^a-z])(from|dans|nicht)([^a-z]|$)", 2), ("sponsor", r"licensed", 2))
DEMO_EDITORIAL = r"(^|[^a-z])(that|des)([^a-z]|$)"


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an interval that lasts its value in minutes."""
    return _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", F.col("us").alias("s"), (F.col("us") + F.floor(F.col("value") * 60_000_000).cast("long")).alias("e"))


def hit_filter(spark, d):
    return _load(spark, d, "events").where("value >= 2").select("event_id", "user_id", "value")


def gap_islands(spark, d):
    hits = _events(spark, d).where("value >= 10")
    g = islands.gap_groups(hits, ["user_id"], "us", "us", ["us", "event_id"], GAP_US)
    return g.groupBy("user_id", "grp").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n_hits"), F.round(F.sum("value"), 2).alias("score"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("triggers"))


def token_related_groups(spark, d):
    c = _load(spark, d, "conversations").withColumn("s", F.col("turn") * 100)
    c = c.withColumn("tokens", F.filter(F.split(F.lower(T.text("text")), "[^a-z]+"), lambda w: F.length(w) > 8))
    g = islands.gap_groups(c, ["conv_id"], "s", "s", ["turn"], 50, tokens="tokens")
    return g.groupBy("conv_id", "grp").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def two_level_gap_groups(spark, d):
    g = islands.two_level_groups(_events(spark, d), ["user_id"], "us", "us", ["us", "event_id"], GAP_US, 3 * GAP_US, F.col("event_type").isin("click", "view"))
    return g.groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


def interval_union(spark, d):
    g = islands.interval_groups(_spans(spark, d), ["user_id"], "s", "e", ["s", "event_id"], HOUR_US)
    return g.groupBy("user_id", "grp").agg(F.min("s").alias("start_us"), F.max("e").alias("end_us"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("score"))


def keyed_interval_merge(spark, d):
    g = islands.keyed_interval_groups(_spans(spark, d), ["user_id"], ["event_type"], "s", "e", ["s", "e", "event_id"], GAP_US)
    return g.groupBy("user_id", "grp").agg(F.min("s").alias("start_us"), F.max("e").alias("end_us"), F.first("event_type").alias("event_type"), F.count("*").alias("n"))


def nearest_snap(spark, d):
    e = _events(spark, d)
    cuts = e.where("event_type = 'view'")
    out = intervals.snap_nearest(e.where("event_type = 'click'").select("user_id", "event_id", "us"), cuts, ["user_id"], "us", HOUR_US, seq="event_id")
    return out.select("user_id", "event_id", "us", "snapped")


def overlap_semi_filter(spark, d):
    s = _spans(spark, d)
    kept = intervals.overlap_semi(s.where("event_type = 'click'"), s.where("event_type = 'view'"), ["user_id"], HOUR_US, start="s", end="e")
    return kept.select("user_id", "event_id")


def tolerance_anti(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'click'")
    return intervals.near_anti(left, e.where("event_type = 'view'"), ["user_id"], "us", GAP_US).select("user_id", "event_id")


def context_before_span_after(spark, d):
    rows = _load(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 8).alias("end"))
    spans = rows.select("conv_id", F.col("turn").alias("span"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    out = intervals.context_rows(spans, rows, ["conv_id"], pad=20, before=12, inside=40, after=12, width=60, order="turn", span_id=["span"])
    return out.select("conv_id", "span", "turn", "part")


def span_hits_top_n(spark, d):
    s = _spans(spark, d)
    spans = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span"), F.col("s").alias("span_start"), F.col("e").alias("span_end"))
    hits = s.select("user_id", "event_id", "s")
    return intervals.first_in_span(spans, hits, ["user_id"], "s", HOUR_US, 25, width=GAP_US, span_id=["span"], order=["s", "event_id"]).select("user_id", "span", "event_id", F.col("rank").cast("long").alias("rank"))


def refine_start(spark, d):
    s = _spans(spark, d)
    spans = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span"), F.col("s").alias("span_start"), F.col("e").alias("span_end"))
    hits = s.where("event_type <> 'purchase' AND value >= 5")
    return intervals.refined_start(spans, hits, ["user_id"], time="s", width=GAP_US, back=HOUR_US).select("user_id", "span", "span_start", "span_end")


def interval_iou(spark, d):
    s = _spans(spark, d)
    w = W.partitionBy("user_id").orderBy("s", "event_id")
    paired = s.withColumn("ps", F.lag("s").over(w)).withColumn("pe", F.lag("e").over(w)).where("ps IS NOT NULL")
    return paired.select("user_id", "event_id", F.round(intervals.iou(F.col("s"), F.col("e"), F.col("ps"), F.col("pe")), 6).alias("iou"))


def hopping_text_windows(spark, d):
    c = _load(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 10).alias("s"), (F.col("turn") * 10 + 8).alias("e"), "text")
    w = windows.hopping_text(c, ["conv_id"], start="s", end="e", text="text", order="turn", width=25.0, hop=12.0)
    return w.select("conv_id", "win", "win_start", "win_end", F.md5("text").alias("text_md5"))


def weighted_lexicon_score(spark, d):
    return _load(spark, d, "documents").select("doc_id", T.lexicon_score("text", STRONG, MEDIUM).cast("long").alias("score"))


def identity_guard(spark, d):
    return _load(spark, d, "documents").select("doc_id", T.lexicon_score("text", STRONG, MEDIUM, guard=GUARD).cast("long").alias("score"))


def class_pattern_score(spark, d):
    low = F.lower("text")
    return _load(spark, d, "documents").select("doc_id", T.class_score(low, DEMO_CLASSES, editorial=DEMO_EDITORIAL).cast("long").alias("score"), F.array_join(T.class_triggers(low, DEMO_CLASSES), ",").alias("triggers"))


def bow_cosine(spark, d):
    words = lambda t: F.filter(F.split(F.lower(T.text(t)), "[^a-z]+"), lambda w: F.length(w) > 3)
    docs = _load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), " ").alias("text"))
    bags = docs.select("conv_id", words("text").alias("tokens"))
    items = _load(spark, d, "benchmark").select("item_id", words("text").alias("tokens"))
    return windows.pairwise_cosine(bags, items, "conv_id", "item_id").select("conv_id", "item_id", F.round("cosine", 6).alias("cosine"))


def suppressed_top_k(spark, d):
    e = _events(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return windows.suppressed_top(e, ["user_id"], score="cents", start="us", seq="event_id", apart=4 * GAP_US, k=5).select("user_id", "event_id", F.col("us").alias("start_us"), "cents")


def normalise_text(spark, d):
    return _load(spark, d, "documents").select("doc_id", F.md5(T.normalise("text")).alias("norm_md5"), F.length(T.normalise("text")).cast("long").alias("n"))


def phone_extract(spark, d):
    return _load(spark, d, "documents").select("doc_id", F.array_join(T.phones("text"), ",").alias("phones"))


#: Lines as a channel and brands show them, one for each line of a text.
PROBES = ("LIVE | NEWS 24", "AUG 29 2026 SATURDAY", "LIVE|O7:10PM", "10:30 11:45 Acme Cola", "ok", "G-Mart", "x 12/10/2024 y", "breaking news")


def _probe(i: Column) -> Column:
    return F.get(F.array(*map(F.lit, PROBES)), i % len(PROBES))


def chrome_filter(spark, d):
    """Lines of the texts (part 0), and as many of a channel's and of brands (part 1)."""
    lines = _load(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    parts = F.array(F.col("lines"), F.transform("lines", lambda _, i: _probe(i + 1)))
    t = lines.select("doc_id", F.posexplode(parts).alias("part", "ls")).select("doc_id", "part", F.posexplode("ls").alias("line", "t"))
    return t.where(T.is_chrome("t", ("the", "of", "and", "is", "la", "de", "der", *T.CHROME))).select("doc_id", F.col("part").cast("long").alias("part"), F.col("line").cast("long").alias("line"))


def brand_candidate(spark, d):
    lines = F.split("text", "\n")
    t = _load(spark, d, "documents").select("doc_id", F.explode(F.concat(lines, F.transform(lines, lambda _, i: _probe(i + 1)))).alias("t"))
    return t.where(T.is_brand_candidate("t")).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def title_brand(spark, d):
    return _load(spark, d, "documents").select("doc_id", T.title_brand("text", {"apache": "Apache"}).alias("brand"))


def best_banner(spark, d):
    t = _load(spark, d, "documents").select("source", "doc_id", "text", T.class_score(F.lower("text"), DEMO_CLASSES, editorial=None).alias("score"), T.banner_bonus("text", services="(?i)licensed", brands=["apache"]).alias("bonus"))
    best = t.groupBy("source").agg(F.max_by("doc_id", F.struct("score", "bonus", F.length("text"), -F.col("doc_id"))).alias("doc_id"), F.max("score").cast("long").alias("score"))
    return best.select("source", "doc_id", "score")


def url_normalise(spark, d):
    return _load(spark, d, "pages").select("page_id", U.normalise_url("url", r"(?i)^(ref|utm_[^=]*)(=|$)").alias("url"))


#: Forms of media addresses; the page's own comes first.
URL_FORMS = ("https://www.youtube.com/watch?a=1&v={11}", "https://youtu.be/{11}?t=1", "https://youtube.com/embed/{11}", "https://www.youtube.com/live/{11}", "https://www.instagram.com/tv/{9}/", "https://instagr.am/share/reels/{7}", "https://example.org/livestream/{5}")


def url_ids(spark, d):
    """Each page's address and one of each form, with a code made of the page's address."""
    forms = []
    for f in URL_FORMS:
        before, n, after = f.partition("{")[0], int(f.partition("{")[2].partition("}")[0]), f.partition("}")[2]
        forms.append(F.concat(F.lit(before), F.substring(F.md5(T.text("url")), 1, n), F.lit(after)))
    p = _load(spark, d, "pages").select("page_id", F.posexplode(F.array(F.col("url"), *forms)).alias("form", "u"))
    return p.select("page_id", F.col("form").cast("long").alias("form"), U.host("u").alias("host"), U.video_id("u").alias("video_id"), U.platform("u").alias("platform"), U.is_live_url("u").alias("live"))


def kind_inference(spark, d):
    p = _load(spark, d, "pages").withColumn("hint", F.when(F.col("page_id") % 7 == 0, "live").otherwise("")).withColumn("dur", F.when(F.col("page_id") % 3 > 0, F.length("html").cast("double") / 10))
    return p.select("page_id", U.kind("url", F.col("hint"), F.col("dur")).alias("kind"))


def error_classify(spark, d):
    return _load(spark, d, "documents").select("doc_id", T.classify_error("text", (("first", ("thered", "429")), ("second", ("that", "private")), ("third", ("la ", "timeout"))), "unknown").alias("code"))


def markup_clean(spark, d):
    return _load(spark, d, "pages").select("page_id", F.md5(T.strip_markup("html")).alias("text_md5"))


def sampling_plan(spark, d):
    m = _load(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).select("conv_id", (F.col("n") * 2.5).alias("duration"))
    p = m.select("conv_id", F.posexplode(sampling.sampling_points(F.col("duration"), F.lit("vod"))).alias("i", "t"))
    return p.select("conv_id", F.col("i").cast("long").alias("i"), F.round("t", 3).alias("t"))


def mae_skip(spark, d):
    e = _load(spark, d, "embeddings").select("label", "vec_id", "embedding")
    return folds.near_duplicate_plan(e, ["label"], order="vec_id", thumb="embedding", least=1.1, ranges=int(spark.conf.get("spark.sql.shuffle.partitions"))).select("vec_id", "source", "reused")


def rolling_dedupe(spark, d):
    c = _load(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 2).alias("s"), (F.col("turn") * 2 + 2).alias("e"), F.col("text").alias("t"))
    return folds.rolling_dedupe(c, ["conv_id"], order="turn", start="s", end="e", text="t", within=3.0).select("conv_id", "turn", "s", "e", "t")


def lag_distance_cuts(spark, d):
    e = _load(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", F.abs).alias("h"))
    return sampling.scene_cuts(e, ["label"], time="vec_id", hist="h", least=0.35, most=40).select("label", "vec_id", F.round("distance", 4).alias("distance"))


#: What the candidates of rule_judge say.
SAID = ("", "a funny video", "use my code", "join our program course", "sponsored by zed", "prank of the week", "see http code page", "call 74169 02233", "our discount", "paid partnership", "no joke, use code", "link below")


def rule_judge(spark, d):
    """Groups of events as candidates of a medium of 30 seconds, with triggers by their types and something said."""
    s = _spans(spark, d)
    g = islands.interval_groups(s, ["user_id"], "s", "e", ["s", "event_id"], GAP_US)
    c = g.groupBy("user_id", "grp").agg((F.floor(F.min("s") / 60_000_000) % 30).cast("double").alias("start_s"), F.array_sort(F.collect_set("event_type")).alias("types"), F.count("*").alias("score"))
    names = F.create_map(*[F.lit(x) for pair in (("click", "cta"), ("view", "price"), ("purchase", "service"), ("signup", "phone"), ("error", "brand_word")) for x in pair])
    said = F.get(F.array(*map(F.lit, SAID)), ((F.col("grp") + F.col("user_id")) % len(SAID)).cast("int"))
    source = F.get(F.array(*map(F.lit, ("asr", "ocr", "intent", "ocr+asr"))), (F.col("grp") % 4).cast("int"))
    c = c.select("user_id", "grp", "start_s", (F.col("start_s") + F.col("score") * 3 % 20).alias("end_s"), F.transform("types", lambda t: names[t]).alias("triggers"), "score", said.alias("said"), source.alias("source"), F.when(F.col("user_id") % 2 == 0, "vod").otherwise("short").alias("kind"), F.when(F.col("grp") % 5 == 0, "x").otherwise("").alias("brand"))
    start, end, src, duration = F.col("start_s"), F.col("end_s"), F.col("source"), F.lit(30.0)
    c = c.withColumn("ad_type", J.ad_type(F.col("kind"), start, end, duration, src, F.col("said")))
    reason = J.reject_reason(start, end, src, F.col("triggers"), F.col("said"), F.col("score"), F.col("brand"))
    return c.select("user_id", "grp", reason.alias("reason"), "ad_type", J.confidence(F.col("score")).alias("confidence"), J.presentation(F.col("kind"), src, F.col("ad_type"), start, end, duration).alias("presentation"), J.description(src, F.col("triggers"), F.col("ad_type")).alias("description"))


def cache_key(spark, d):
    return _load(spark, d, "documents").select("doc_id", T.cache_key(F.lit("vod"), F.col("source"), F.substring(T.text("text"), 1, 400)).alias("cache_key"))


def persist_tracks(spark, d):
    e = _events(spark, d)
    p = islands.persistent(e, ["user_id", "event_type"], "us", ["us", "event_id"], forget=4 * GAP_US, least=4 * GAP_US)
    return p.select("user_id", "event_type", "track", "first_seen", "last_seen", "n_seen", "proposed")


def silence_commit(spark, d):
    """Commits of tracks in event time: silence closes a track, short ones are dropped."""
    p = islands.persistent(_events(spark, d).where("value >= 5"), ["user_id"], "us", ["us", "event_id"], forget=GAP_US, least=HOUR_US)
    return p.where("proposed").select("user_id", F.col("first_seen").alias("start_us"), F.col("last_seen").alias("end_us"), (F.col("last_seen") + GAP_US).alias("committed_us"), "n_seen")


def eval_prf(spark, d):
    docs, labels = _load(spark, d, "documents"), _load(spark, d, "labels")
    both = labels.join(docs, "doc_id").select(F.col("quality").alias("gold"), "lang", (F.length("text") > 200).alias("predicted"))
    out = evaluate.flag_scores(both, F.col("predicted"), F.col("gold") == 1, ["lang"])
    return out.select("lang", "tp", "fp", "fn", "precision", "recall", "f1")


def interval_matches(spark, d):
    """Views matched to clicks of a user. A fold takes the intervals between two gaps that none spans, so no pair is parted."""
    s = _spans(spark, d).where("event_type IN ('click', 'view')")
    g = islands.interval_groups(s, ["user_id"], "s", "e", ["s", "event_id"], 0)
    rows = g.select(F.struct("user_id", "grp").alias("part"), F.col("event_id").alias("seq"), F.col("s").alias("start_s"), F.col("e").alias("end_s"), "event_type")
    m = evaluate.matched(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), "part", least=0.1)
    iou = F.sum(F.aggregate("matches", F.lit(0.0), lambda a, x: a + x["iou"]))
    total = m.groupBy(F.col("part.user_id").cast("string").alias("key")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), iou.alias("iou"))
    return total.select("key", "tp", "fp", "fn", F.round(F.when(F.col("tp") > 0, F.col("iou") / F.col("tp")), 6).alias("mean_iou"))


def run_stats(spark, d):
    """Per event type and user: counts, mean, and the value at rank 0.95 (n + 1) (the largest below 20 rows)."""
    e = _load(spark, d, "events").where("value IS NOT NULL")
    s = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean")).join(P.quantile_95(e, ["event_type", "user_id"], "value"), ["event_type", "user_id"])
    return s.select("event_type", "user_id", "n", "mean", F.round("p95", 8).alias("p95"))


def brand_signature(spark, d):
    return _load(spark, d, "documents").select("doc_id", F.md5(T.signature("text", {"apache": "Apache"})).alias("signature_md5"))


def event_sessions(spark, d):
    """Event-time sessions by a gap, as a stream would have them."""
    from spanforge.streaming.ticks import session_counts

    e = _load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = session_counts(e, "user_id")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), (F.unix_micros("end") - GAP_US).alias("last_us"), "n", F.round("value", 2).alias("value"))


def scene_break_hits(spark, d):
    """Changes of a histogram whose document scores, in order of vectors of a label."""
    e = _load(spark, d, "embeddings").join(_load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    frames = e.select(F.col("label").alias("session_id"), F.col("vec_id").alias("now_s"), F.transform("embedding", F.abs).alias("hist"), "text")
    found = P.scene_breaks(frames, score=lambda t: T.class_score(F.lower(t), DEMO_CLASSES, editorial=None))
    return found.select(F.col("session_id").alias("label"), F.col("start_s").alias("vec_id"), F.col("score").cast("long").alias("score"), F.round("distance", 4).alias("distance"))


def platform_errors(spark, d):
    """A phrase of either platform's errors (or none) between words of a document, classified for both."""
    phrases = [p for ladder in (T.YOUTUBE_ERRORS, T.INSTAGRAM_ERRORS) for _, group in ladder for p in group] + ["http error 403", "csrf", ""]
    at = F.length(T.text("text")) % len(phrases)
    e = _load(spark, d, "documents").select("doc_id", F.concat(T.text("text"), F.lit(" "), F.upper(F.get(F.array(*map(F.lit, phrases)), at))).alias("t"))
    return e.select("doc_id", T.platform_error("t", F.lit("youtube")).alias("youtube"), T.platform_error("t", F.lit("instagram")).alias("instagram"))


def caption_cues(spark, d):
    """Conversations written as VTT files and parsed."""
    ms = F.col("turn") * 10_000 + 500
    clock = lambda x: F.format_string("%02d:%02d:%02d.%03d", F.floor(x / 3_600_000).cast("long"), (F.floor(x / 60_000) % 60).cast("long"), (F.floor(x / 1000) % 60).cast("long"), (x % 1000).cast("long"))
    block = F.concat(clock(ms), F.lit(" --> "), clock(ms + 8000), F.lit(" align:start\n<c>"), F.regexp_replace(T.text("text"), r"[\x20\x09-\x0D]+", " "), F.lit("</c>"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda r: r["b"])
    files = _load(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(lines, "\n\n")).alias("body"))
    return cues(files, "conv_id", "body").select("conv_id", F.col("seq").cast("long").alias("seq"), F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), F.md5("text").alias("text_md5"))


def clock_text(spark, d):
    ms = F.floor(F.col("us") / 1000) % 86_400_000
    text = F.format_string("%d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("long"), (F.floor(ms / 60_000) % 60).cast("long"), (F.floor(ms / 1000) % 60).cast("long"), (ms % 1000).cast("long"))
    return _events(spark, d).select("event_id", F.round(T.clock_seconds(text), 3).alias("seconds"))


def json_repair(spark, d):
    answer = F.concat(F.lit("Here it is:\n```json\n"), T.text("props"), F.lit("\n``` I hope it helps."))
    return _load(spark, d, "events").select("event_id", F.get_json_object(T.first_json(answer), "$.k").cast("long").alias("k"))


def language_rank(spark, d):
    lang = F.when(F.length("text") % 2 == 0, F.concat("lang", F.lit("-orig"))).otherwise(F.col("lang"))
    return _load(spark, d, "documents").select("doc_id", rank_of(lang).cast("long").alias("rank"))


def intent_score(spark, d):
    c = _load(spark, d, "conversations").select("conv_id", "turn", "text")
    score = windows.intent_score(F.size(T.lexicon_hits("text", ("with", "from", "dans"))), T.words("text"), [{"with": 2, "from": 1, "avec": 1}, {"dans": 1, "les": 1}], [{"that": 1, "this": 1}])
    return c.select("conv_id", "turn", F.round(score, 6).alias("score"))


def _turns(spark, d):
    """Conversation turns as caption lines of ten seconds."""
    return _load(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 10.0).alias("s"), (F.col("turn") * 10.0 + 8).alias("e"), F.coalesce("text", F.lit("")).alias("text"))


def _seconds(spark, d):
    """Events as intervals of a user in seconds since the user's first, as long as their value."""
    e = _events(spark, d)
    return e.withColumn("s", (F.col("us") - F.min("us").over(W.partitionBy("user_id"))) / 1e6).withColumn("e", F.col("s") + F.col("value"))


_SOURCES = (("view", "asr"), ("click", "ocr"), ("purchase", "ocr_persist_tr"), ("signup", "ocr+intent"))


def _source(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in _SOURCES for x in pair])[kind], F.lit("ocr"))


def padded_overlap(spark, d):
    s = _spans(spark, d)
    kept = intervals.overlap_semi(s.where("event_type = 'click'"), s.where("event_type = 'view'"), ["user_id"], HOUR_US, start="s", end="e", pad=HOUR_US, inclusive=True)
    return kept.select("user_id", "event_id")


def all_text_windows(spark, d):
    """Windows with their texts, the last ones too."""
    w = windows.all_windows(_turns(spark, d), ["conv_id"], start="s", end="e", text="text", order="turn", width=20.0, hop=8.0)
    return w.select("conv_id", "win", "win_start", "win_end", F.md5("text").alias("text_md5"))


def transcript_choice(spark, d):
    """Long texts as captions, all as recognised speech; captions of a conversation come first, folded."""
    t = _turns(spark, d)
    out = transcript(t.where("length(text) > 150"), t, "conv_id", order="turn", start="s", end="e", within=30.0)
    return out.select("conv_id", "turn", F.col("e").alias("end_s"), "source", F.md5("text").alias("text_md5"))


def caption_track(spark, d):
    """Of each source's languages the best-ranked one; texts of even length count as original tracks."""
    lang = F.when(F.length("text") % 2 == 0, F.concat("lang", F.lit("-orig"))).otherwise(F.col("lang"))
    lines = _load(spark, d, "documents").where("lang IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL").select("source", "doc_id", lang.alias("lang"))
    return best_track(lines, "source").select("source", "doc_id", "lang")


def signal_flags(spark, d):
    """Whether a source is overlay text alone, and whether an error means a limit of requests."""
    e = _load(spark, d, "events")
    code = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "click", 503).when(F.col("event_type") == "view", 404)
    return e.select("event_id", J.ocr_only(_source(F.col("event_type"))).alias("ocr_only"), T.is_rate_limit(code, F.concat(F.lit("HTTP "), F.col("event_id").cast("string"))).alias("rate_limited"))


def model_gate(spark, d):
    """Events as candidates; those of one user in four count without the spoken ones."""
    c = _seconds(spark, d).where("user_id % 4 > 0 OR event_type NOT IN ('view', 'signup')").select("user_id", _source(F.col("event_type")).alias("source"), F.col("s").alias("start_s"), F.when(F.col("user_id") % 2 == 0, "vod").otherwise("short").alias("kind"))
    return J.needs_model(c, key="user_id")


def incidental_filter(spark, d):
    """Events as candidates of a user's medium, which lasts until the last of them ends."""
    e = _seconds(spark, d)
    text = F.when(F.col("event_id") % 3 == 0, "breaking interview").otherwise(F.col("event_type"))
    c = e.select(F.col("user_id").cast("string").alias("video_id"), "event_id", F.col("s").alias("start_s"), F.col("e").alias("end_s"), _source(F.col("event_type")).alias("source"), F.array(text).alias("texts"))
    media = c.groupBy("video_id").agg(F.max("end_s").alias("duration_s")).withColumn("kind", F.when(F.length("video_id") > 1, "vod").otherwise("short"))
    return drop_incidental(c, media).select("video_id", "event_id")


def overlay_parts(spark, d):
    """Documents as banners: what stays of them when a brand stands before them, beside a banner of a shop."""
    shown = F.concat(F.lit("Acme Foods plumbing Rs 499 98765 43210 | "), F.translate(F.lower(T.text("text")), "|", " "))
    t = _load(spark, d, "documents").select("doc_id", shown.alias("t"))
    cleaned = worked_out(t, cleaned=T.clean_banner("t"))
    return cleaned.select("doc_id", F.md5(T.overlay_text("t", F.lit("Acme Foods"), cleaned=F.col("cleaned"))).alias("text_md5"), F.length("cleaned").cast("long").alias("n"))


#: Latin letters and the native ones that stand in for them.
LATIN, NATIVE = "abcdefghijklmnopqrst", "कखगघचछजझटठडढणतथदధనపఫ"


def native_text(spark, d):
    """Texts with letters made native."""
    t = F.translate(F.lower(T.text("text")), LATIN, NATIVE)
    return _load(spark, d, "documents").select("doc_id", F.md5(T.native_spans(t)).alias("spans_md5"), T.script_language(t).alias("language"))


#: What is shown on screen beside a text.
SHOWN = ("", "call 74169 02233", "cars 50 left", "$85 only", "₹5 off", "499/-", "Rs 499", "rs.499", "Rs499", "74169 0223", "1 9876 5432 10", "breaking plumbing", "buy now episode", "INR 20 discount")


def overlay_score(spark, d):
    """Documents, each with something shown, scored by the standing classes."""
    shown = F.get(F.array(*map(F.lit, SHOWN)), (F.col("doc_id") % len(SHOWN)).cast("int"))
    t = _load(spark, d, "documents").select("doc_id", F.concat(T.text("text"), F.lit(" "), shown).alias("t"))
    found = worked_out(t, found=T.class_matches("t"))
    return found.select("doc_id", T.matched_score(F.col("found")).cast("long").alias("score"), F.array_join(T.matched_triggers(F.col("found")), ",").alias("triggers"), T.live_score("t", ("apache",), found=F.col("found")).cast("long").alias("live_score"))


def live_spots(spark, d):
    """Documents as ticks of a source, in regions by language."""
    docs = _load(spark, d, "documents")
    ticks = docs.select(F.col("source").alias("session_id"), F.col("doc_id").cast("double").alias("now_s"), F.col("lang").alias("roi_name"), F.col("text").alias("raw_text"), T.is_chrome("text").alias("is_chrome"))
    out = P.spot(ticks, strong_brands=("apache", "mit license"), known={"apache": "Apache"})
    return out.select("session_id", F.col("now_s").cast("long").alias("doc_id"), "roi", "signature", F.col("score").cast("long").alias("score"))


def first_texts(spark, d):
    f = folds.first_texts(_turns(spark, d), ["conv_id"], order="turn", text="text", head=8)
    return f.select("conv_id", F.size("texts").cast("long").alias("n"), F.md5(F.array_join("texts", "|")).alias("texts_md5"))


def longest_text(spark, d):
    return P.longest_text(_turns(spark, d), ["conv_id"], "text", "turn").select("conv_id", F.md5("text").alias("text_md5"))


def evidence_packets(spark, d):
    """Turns as captions and, each, as a candidate; a hit every three seconds. What a model would be sent."""
    t = _turns(spark, d).select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("seq"), F.col("s").alias("start_s"), F.col("e").alias("end_s"), "text")
    source = F.get(F.array(*map(F.lit, ("asr", "ocr", "ocr+asr"))), (F.col("seq") % 3).cast("int"))
    none = F.expr("CAST(array() AS array<string>)")
    c = t.select("video_id", F.col("seq").alias("cand_seq"), "start_s", "end_s", source.alias("source"), none.alias("raw_triggers"), F.array("text").alias("texts"), F.lit("vod").alias("kind"), F.lit(600.0).alias("duration_s"))
    hits = t.select("video_id", (F.col("seq") * 3.0).alias("timestamp_s"), "text", (F.length("text") % 5).cast("int").alias("score"))
    at = lambda path: F.get_json_object("packet", path)
    p = J.packets(c, t, hits)
    return p.select(F.col("video_id").cast("long").alias("conv_id"), F.col("cand_seq").alias("turn"), at("$.candidate.source").alias("source"), at("$.candidate.end_s").cast("double").cast("long").alias("end_s"), F.md5(at("$.transcript_before")).alias("before_md5"), F.md5(at("$.transcript_span")).alias("span_md5"), F.md5(at("$.transcript_after")).alias("after_md5"), F.md5(at("$.ocr_in_span")).alias("shown_md5"))


def answers_to_segments(spark, d):
    """Events as candidates and a model's answers to them, times in cents of their value, in a medium of 3,000 seconds."""
    e = _load(spark, d, "events").where("value IS NOT NULL")
    cents, kinds = F.round(F.col("value") * 100).cast("long"), F.create_map(*[F.lit(x) for pair in (("click", "affiliate"), ("view", "bumper"), ("purchase", "banner"), ("signup", "")) for x in pair])
    sources = F.create_map(*[F.lit(x) for pair in (("view", "asr"), ("click", "ocr"), ("purchase", "ocr+intent"), ("signup", "intent"), ("error", "asr")) for x in pair])
    said = F.struct(
        F.when(F.col("event_type") == "error", "NOT_AD").when(F.col("event_id") % 2 == 0, "AD").otherwise("ad").alias("decision"),
        F.when(F.col("event_id") % 7 > 0, cents).alias("start_s"),
        F.when(F.col("event_id") % 7 > 0, cents + F.col("event_id") % 5 - 1).alias("end_s"),
        kinds[F.col("event_type")].alias("ad_type"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.repeat("event_type", 20)).alias("brand"),
        (F.col("event_id") % 3).alias("confidence"),
    )
    at = cents.cast("double")
    c = e.select("event_id", at.alias("start_s"), (at + 9).alias("end_s"), sources[F.col("event_type")].alias("source"), F.array("event_type").alias("raw_triggers"), F.array(F.concat("event_type", F.lit(" now"))).alias("texts"), F.array(at, at + 5, at + 200).alias("frame_timestamps"), F.when(F.col("event_id") % 2 == 0, "vod").otherwise("short").alias("kind"), F.lit(3000.0).alias("duration_s"), F.concat(F.lit("```json\n"), F.to_json(said), F.lit("\n```")).alias("answer"))
    s = J.from_answers(c)
    return s.select("event_id", "start_s", "end_s", "ad_type", "confidence", "brand", "description", F.array_join("signals_used", ",").alias("signals"), "presentation", F.size("frame_timestamps").cast("long").alias("n_frames"), "ocr_text")


def indexed_answers(spark, d):
    """Turns and the one that answers them, by number."""
    t = _turns(spark, d)
    answers = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.md5("text").alias("answer_md5"))
    return J.answered(t.select("conv_id", "turn"), answers, "conv_id", "turn").select("conv_id", "turn", "answer_md5")


def stall_events(spark, d):
    t = _events(spark, d).groupBy(F.col("user_id").alias("session_id"), F.floor(F.col("us") / 1e6).cast("long").alias("arrived_s")).agg(F.count("*").alias("n"))
    return P.stalls(t).select("session_id", "arrived_s", "pause_s")


def look_back(spark, d):
    """What of a conversation each of its ticks can see."""
    t = _turns(spark, d).select(F.col("conv_id").alias("session_id"), "turn", F.col("s").alias("start_s"), F.col("e").alias("end_s"))
    ticks = t.select("session_id", (F.col("turn") * 7.0 + 3).alias("now_s"))
    out = P.live_captions(t, ticks)
    return out.select(F.col("session_id").cast(t.schema["session_id"].dataType).alias("session_id"), F.col("now_s").cast("long").alias("now_s"), "turn", F.col("end_s").cast("long").alias("end_s"))


def sensed_texts(spark, d):
    """Each vector with the document that was sensed last."""
    e = _load(spark, d, "embeddings").join(_load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    out = sampling.sensed(e, ["label"], order="vec_id", thumb="embedding", text="text", least=1.1)
    return out.select("label", "vec_id", "source", "reused", F.md5("sensed_text").alias("text_md5"))


def candidate_union(spark, d):
    """Events as candidates, united by nearness in time."""
    e = _seconds(spark, d)
    c = e.select(F.col("user_id").cast("string").alias("video_id"), (F.floor("s") / 3600).alias("start_s"), (F.floor("e") / 3600).alias("end_s"), _source(F.col("event_type")).alias("source"), F.array("event_type").alias("raw_triggers"), F.array("event_type").alias("texts"), F.array("s").alias("frame_timestamps"), F.lit(1).alias("score_hint"))
    u = union_candidates(c)
    return u.select("video_id", F.col("cand_seq").cast("long").alias("cand_seq"), F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"), F.array_join("raw_triggers", ",").alias("triggers"), F.size("texts").cast("long").alias("n_texts"), F.col("score_hint").cast("long").alias("score"))


def seek_bar(spark, d):
    e = _seconds(spark, d).select("user_id", "event_id", F.col("s").alias("start_s"), F.col("e").alias("end_s"))
    whole = e.withColumn("duration_s", F.max("end_s").over(W.partitionBy("user_id"))).where("duration_s > 0")
    return P.seek_bar(whole).select("user_id", "event_id", "left_pct", "width_pct")


def eval_micro(spark, d):
    """Totals of views matched to clicks over all users."""
    s = _spans(spark, d).where("event_type IN ('click', 'view')")
    g = islands.interval_groups(s, ["user_id"], "s", "e", ["s", "event_id"], 0)
    rows = g.select(F.struct("user_id", "grp").alias("part"), F.col("event_id").alias("seq"), F.col("s").alias("start_s"), F.col("e").alias("end_s"), "event_type")
    m = evaluate.matched(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), "part", least=0.1)
    return evaluate.micro(m).select("tp", "fp", "fn", "precision", "recall", "f1", "mean_iou")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        hit_filter, gap_islands, token_related_groups, two_level_gap_groups, interval_union, keyed_interval_merge, nearest_snap,
        overlap_semi_filter, tolerance_anti, context_before_span_after, span_hits_top_n, refine_start, interval_iou, hopping_text_windows,
        weighted_lexicon_score, identity_guard, class_pattern_score, bow_cosine, suppressed_top_k, normalise_text, phone_extract,
        chrome_filter, brand_candidate, title_brand, best_banner, url_normalise, url_ids, kind_inference, error_classify, markup_clean,
        sampling_plan, mae_skip, rolling_dedupe, lag_distance_cuts, rule_judge, cache_key, persist_tracks, silence_commit, eval_prf,
        interval_matches, run_stats, brand_signature, event_sessions, scene_break_hits,
        platform_errors, caption_cues, clock_text, json_repair, language_rank, intent_score,
        padded_overlap, all_text_windows, transcript_choice, caption_track, signal_flags, model_gate, incidental_filter, overlay_parts,
        native_text, overlay_score, live_spots, first_texts, longest_text, evidence_packets, answers_to_segments, indexed_answers,
        stall_events, look_back, sensed_texts, candidate_union, seek_bar, eval_micro,
    )
}
