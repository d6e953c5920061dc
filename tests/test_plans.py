import random
import json

import pytest
from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.operators import evaluate, folds, intervals, islands, sampling, windows
from spanforge.plans import detect as D
from spanforge.plans import judge as J
from spanforge.sources import captions, results

MEDIA = [("v", "u", "youtube", "vod", 621.0)]


def media(spark, kind="vod", duration=63.0):
    return spark.createDataFrame([("v", "u", "youtube", kind, duration)], schemas.MEDIA)


def test_hits_that_share_words_are_one_group_to_the_end(spark):
    hits = spark.createDataFrame([("v", float(t), f"Acme Interiors {t}", 4, ["brand_word"]) for t in (5, 12, 21, 48, 60)], schemas.HITS)
    got = D.overlay_candidates(hits, media(spark)).collect()
    assert [(r.start_s, r.end_s, r.score_hint, len(r.texts)) for r in got] == [(5.0, 63.0, 20, 5)]


def candidate(start, end, source="ocr", texts=("x",), triggers=("cta",), score=4):
    return ("v", 0, float(start), float(end), source, list(triggers), list(texts), [float(start)], score)


def test_union(spark):
    c = spark.createDataFrame([candidate(5, 12), candidate(14, 20, "asr"), candidate(80, 90)], schemas.CANDIDATES).drop("cand_seq")
    got = D.union_candidates(c).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, r.source) for r in got] == [(5.0, 20.0, "ocr+asr"), (80.0, 90.0, "ocr")]


def test_incidental_overlay_goes_and_speech_stays(spark):
    c = spark.createDataFrame([candidate(120, 128), candidate(469, 621, "asr"), candidate(500, 505), candidate(2, 9, texts=["episode"])], schemas.CANDIDATES).drop("cand_seq")
    got = D.drop_incidental(c, media(spark, duration=621.0)).orderBy("start_s").collect()
    assert [(r.start_s, r.source) for r in got] == [(469.0, "asr"), (500.0, "ocr")]


def segment(seq, start, end, kind="self_promo", brand="B", text="t", signals=("ocr",)):
    return ("v", seq, float(start), float(end), kind, brand, None, 0.7, [float(start)], list(signals), f"d{seq}", text, f"said {text}")


SEGMENT = "video_id string, cand_seq int, start_s double, end_s double, ad_type string, brand string, presentation string, confidence double, frame_timestamps array<double>, signals_used array<string>, description string, ocr_text string, transcript_span string"


@pytest.mark.parametrize(("rows", "want"), [([segment(0, 36, 109), segment(1, 115, 163)], [(36.0, 163.0)]), ([segment(0, 0, 5, "preroll"), segment(1, 7, 9)], [(0.0, 5.0), (7.0, 9.0)]), ([segment(0, 0, 5, "preroll"), segment(1, 6, 9, "preroll")], [(0.0, 5.0), (6.0, 9.0)])])
def test_merge(spark, rows, want):
    got = D.merge_segments(spark.createDataFrame(rows, SEGMENT)).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s) for r in got] == want


def test_snap_takes_the_first_of_equal_cuts_and_clamps(spark):
    s = spark.createDataFrame([segment(0, 10.0, 20.0), segment(1, 30.0, 99.0), segment(2, 40, 40)], SEGMENT)
    cuts = spark.createDataFrame([("v", 10.5, 1), ("v", 9.5, 0), ("v", 21.0, 2)], "video_id string, cut_s double, cut_seq int")
    got = {r.cand_seq: (r.start_s, r.end_s) for r in D.snap(s, cuts, media(spark)).collect()}
    assert got == {0: (9.5, 20.0), 1: (30.0, 63.0), 2: (40.0, 40.5)}


def test_merged_evidence(spark):
    rows = [segment(0, 0, 5, text="one"), segment(1, 7, 9, text="one two", signals=("asr", "ocr")), segment(2, 10, 12, text="two"), segment(3, 13, 14, text="x" * 600)]
    got = D.merge_segments(spark.createDataFrame(rows, SEGMENT)).first()
    assert got.ocr_text == ("one | one two | " + "x" * 600)[:500] and got.transcript_span.startswith("said one | said one two | said two") and len(got.transcript_span) == 400
    assert (got.description, got.signals_used, got.frame_timestamps) == ("d0", ["ocr", "asr"], [0.0, 7.0, 10.0, 13.0])


WORDS = {"strong": ["use my code"], "medium": ["sponsored"]}


def detected(spark, hits=(), lines=(), cuts=(), *, kind="vod", duration=621.0, **kw):
    h = spark.createDataFrame([("v", *x) for x in hits], schemas.HITS)
    c = spark.createDataFrame([("v", i, *x, "en") for i, x in enumerate(lines)], schemas.CAPTIONS)
    k = spark.createDataFrame([("v", x, i) for i, x in enumerate(cuts)], "video_id string, cut_s double, cut_seq int")
    return D.detect(media(spark, kind, duration), h, c, k, **(WORDS | kw)).orderBy("start_s").collect()


def test_detect_end_to_end(spark):
    hits = [(500.0, "Acme Interiors call us", 4, ["cta", "service"]), (300.0, "Rs 500 Zed", 2, ["price"])]
    lines = [(470.0, 490.0, "sponsored by acme, use my code"), (495.0, 520.0, "use my code today")]
    (got,) = detected(spark, hits, lines, [469.5])
    assert (got.id, got.start_s, got.end_s, got.ad_type, got.description, got.signals_used) == ("seg_01", 469.5, 520.0, "midroll_sponsor_read", "Spoken promotion that text on screen confirms.", ["asr", "ocr"])
    assert got.transcript_span == "470.0 sponsored by acme, use my code\n495.0 use my code today" and got.ocr_text == "" and got.frame_timestamps == [500.0]


def test_rolling_captions_count_once_and_starts_are_refined(spark):
    """Of rolling lines the whole one is scored; the start is that of the first line, from a second before, that scores by itself."""
    lines = [(100.0, 102.0, "use my code"), (101.0, 104.0, "use my code now for"), (103.5, 112.0, "use my code now for our course, enroll")]
    (got,) = D.speech_candidates(spark.createDataFrame([("v", i, *x, "en") for i, x in enumerate(lines)], schemas.CAPTIONS), media(spark, duration=110.0), WORDS["strong"], WORDS["medium"], "course").collect()
    assert (got.start_s, got.end_s, got.score_hint) == (100.0, 110.0, 6)  # the third starts too late to replace the first, so it counts by itself
    assert got.texts == ["use my code now for", "use my code now for our course, enroll"] and got.frame_timestamps == []
    many = [(200.0 + 2 * i, 201.0 + 2 * i, f"use my code number {i} " + "y" * 80) for i in range(14)] + [(230.0, 231.0, f"use my code number 3 {'y' * 80} z")]
    (got,) = D.speech_candidates(spark.createDataFrame([("v", i, *x, "en") for i, x in enumerate(many)], schemas.CAPTIONS), media(spark, duration=621.0), WORDS["strong"], WORDS["medium"], "course").collect()
    assert len(got.texts) == 10 and got.texts[3].endswith("y")


def test_intents_become_candidates_beside_news(spark):
    lines = [(0.0, 40.0, "the government and the weather today"), (40.0, 80.0, "city news and sports of the day"), (100.0, 140.0, "buy our course with a discount, enroll now"), (140.0, 180.0, "use the link to buy the course today")]
    lexicons = {"promo": [{"buy": 1, "course": 1, "discount": 1}], "anti": [{"news": 1, "weather": 1}], "phrases": ["enroll", "discount", "link"]}
    captions_ = spark.createDataFrame([("v", i, *x, "en") for i, x in enumerate(lines)], schemas.CAPTIONS)
    c = D.intent_candidates(captions_, media(spark, duration=180.0), **lexicons).collect()
    assert c and min(r.start_s for r in c) >= 80 and {r.source for r in c} == {"intent"} and all(r.end_s <= 180 and r.score_hint >= 2 for r in c)
    assert any("promo_sim=" in t for r in c for t in r.raw_triggers) and any("enroll" in r.raw_triggers for r in c)
    got = detected(spark, (), lines, duration=180.0, **lexicons)
    assert [r.ad_type for r in got] == ["self_promo"] and got[0].start_s >= 80


def judged(spark, *rows, kind="vod", duration=100.0, **kw):
    c = spark.createDataFrame([(*r, kind, duration) for r in rows], schemas.CANDIDATES + ", kind string, duration_s double")
    return J.judge(c, **kw).orderBy("start_s").collect()


def test_types(spark):
    kind = lambda *a, k="vod", **kw: judged(spark, candidate(*a, **kw), kind=k)[0].ad_type
    assert kind(30, 50, "asr", texts=["join our program course"]) == "self_promo" and kind(30, 50, "ocr", texts=["join our program course"]) == "other"
    assert kind(10, 40, "asr", texts=["sponsored"]) == "midroll_sponsor_read" and kind(1.5, 40, "asr", texts=["sponsored"]) == "preroll"
    assert kind(1, 40, "asr", texts=["sponsored"], k="short") == "midroll_sponsor_read"
    assert kind(1, 20) == "preroll" and kind(1, 21) == "other" and kind(2, 20) == "other" and kind(1, 20, k="short") == "other"
    assert kind(95, 98.5) == "self_promo" and kind(94, 99) == "other" and kind(95, 98) == "other"
    assert kind(30, 50, texts=["use this code"]) == "affiliate" and kind(30, 50, texts=["code red"]) == "other"


def test_rejections(spark):
    why = lambda *a, **kw: judged(spark, candidate(*a, **kw))[0].reject_reason
    assert why(30, 50, triggers=["price"]) == "bare_price" and why(30, 50, triggers=["price", "service"]) is None and why(30, 50, triggers=["price"], texts=["pay 74169 02233"]) is None
    assert why(30, 50, triggers=["price"], texts=["Acme Foods"]) is None  # a brand is told by the text too
    assert why(30, 50, triggers=["brand_word"], texts=["a funny skit"]) == "comedy" and why(30, 50, texts=["a funny skit"]) is None
    assert why(30, 50, triggers=[], score=1) == "weak" and why(30, 50, triggers=["phone"], score=1) is None and why(30, 50, triggers=[], score=1, texts=["74169 02233"]) is None
    assert why(30, 50, "asr", texts=["hello all"]) == "no_intent" and why(30, 50, "asr", texts=["a discount"]) is None and why(30, 50, "asr", triggers=["brand_word"], texts=["hello all"]) is None
    assert why(30, 37, "asr", texts=["a discount"]) == "brief_speech" and why(30, 37, "asr", texts=["sponsored"]) is None and why(30, 37, "intent", texts=["a discount"]) == "brief_speech"


def test_judged_evidence(spark):
    """Overlay text alone never has speech as evidence; its banner is the best text, cleaned."""
    rows = spark.createDataFrame([(*candidate(7.5, 74.9, texts=["x", "tile cleaning, Acme Foods 74169 02233"], triggers=["phone", "service"]), "short", 75.0)], schemas.CANDIDATES + ", kind string, duration_s double")
    spoken = spark.createDataFrame([("v", 0, 8.0, 12.0, "something else", "te")], schemas.CAPTIONS)
    (got,) = J.judge(J.with_speech(rows, spoken)).collect()
    assert (got.transcript_span, got.signals_used, got.presentation, got.brand) == ("", ["ocr"], "overlay", "Acme Foods")
    assert got.ocr_text == "Acme Foods | cleaning | 74169 02233" and got.description == "Overlay that stays on screen, read as: phone, service."
    (heard,) = judged(spark, candidate(30, 50, "asr", texts=["| shown", "a discount"]))
    assert (heard.transcript_span, heard.ocr_text, heard.signals_used, heard.presentation) == ("a discount", "", ["asr"], None)
    (meant,) = judged(spark, candidate(30, 50, "intent", texts=["a discount"]))
    assert (meant.signals_used, meant.transcript_span, meant.description) == (["ocr"], "", "Commercial passage. Triggers: cta.")
    assert judged(spark, candidate(30, 50, texts=["Zed at Acme Foods"]), named={"acme": "Acme Ltd"})[0].brand == "Acme Ltd"
    live_ = lambda a, b: judged(spark, candidate(a, b), kind="live", duration=60.0)[0].presentation
    assert live_(10, 40) == "overlay" and live_(0.1, 59.9) is None


def test_model_gate_and_packets(spark):
    c = lambda *rows: spark.createDataFrame([(*r, k, 100.0) for *r, k in rows], schemas.CANDIDATES + ", kind string, duration_s double")
    gate = lambda *rows: [r.needs_model for r in J.needs_model(c(*rows)).collect()]
    assert gate((*candidate(0, 7), "vod")) == [False] and gate((*candidate(5.5, 63), "short")) == [False]
    assert gate((*candidate(120, 128), "vod")) == [True] and gate((*candidate(1, 2, "asr"), "short")) == [True]
    lines = spark.createDataFrame([("v", i, 10.0 * i, 10.0 * i + 8, f"line {i}", "en") for i in range(12)], schemas.CAPTIONS)
    hits = spark.createDataFrame([("v", 49.0, "a", 2, []), ("v", 61.0, "b", 4, []), ("v", 62.1, "late", 4, []), ("v", 55.0, "", 1, [])], schemas.HITS)
    (got,) = J.packets(c((*candidate(50, 61, "asr+ocr"), "vod")), lines, hits).collect()
    packet = json.loads(got.packet)
    assert packet["transcript_before"] == "30.0 line 3\n40.0 line 4" and packet["transcript_span"] == "50.0 line 5\n60.0 line 6" and packet["transcript_after"] == "70.0 line 7\n80.0 line 8"
    assert packet["ocr_in_span"] == "49.0 score=2 a\n61.0 score=4 b" and (packet["kind"], packet["video_duration_s"], packet["candidate"]["rule_triggers"]) == ("vod", 100.0, ["cta"])
    (alone,) = J.packets(c((*candidate(50, 61), "vod")), lines, hits).collect()
    assert [json.loads(alone.packet)[f"transcript_{p}"] for p in ("before", "span", "after")] == ["", "", ""] and "score=2" in alone.packet
    assert J.packets(c((*candidate(50, 61), "vod")).limit(0), lines, hits).count() == 0


def test_answers(spark):
    def one(answer, *a, k="vod", **kw):
        c = spark.createDataFrame([(*candidate(*a, **kw), k, 50.0, f"```json\n{json.dumps(answer)}\n```" if isinstance(answer, dict) else answer)], schemas.CANDIDATES + ", kind string, duration_s double, answer string")
        return J.from_answers(c).first()

    ad = {"decision": "ad", "start_s": -1, "end_s": 99, "ad_type": "weird", "brand": "B" * 90}
    got = one(ad, 5, 9, "asr+intent+ocr")
    assert (got.start_s, got.end_s, got.ad_type, got.brand, got.confidence, got.description, got.signals_used) == (0.0, 50.0, "other", "B" * 80, 0.8, "Decided by the model.", ["asr", "intent", "ocr", "llm"])
    assert one({"decision": "NOT_AD"}, 5, 9) is None and one("no json", 5, 9) is None and one({}, 5, 9) is None
    short = one({"decision": "AD", "start_s": 10, "end_s": 10.1, "ad_type": "platform_inserted", "confidence": 0.4}, 5, 9)
    assert (short.start_s, short.end_s, short.ad_type, short.confidence) == (10.0, 10.3, "platform_inserted", 0.4)  # lengthened, not dropped
    own = one({"decision": "AD"}, 5, 9, texts=["Acme Foods call 74169 02233"], k="short")
    assert (own.start_s, own.end_s, own.brand, own.ocr_text, own.presentation, own.signals_used) == (5.0, 9.0, "Acme Foods", "Acme Foods | 74169 02233", "overlay", ["ocr"])
    assert own.frame_timestamps == [5.0] and one({"decision": "AD", "start_s": 30, "end_s": 40}, 5, 9).frame_timestamps == []
    assert one({"decision": "AD", "brand": "Zed"}, 5, 9, texts=["Acme Foods call"]).ocr_text == "Zed | Acme Foods"


def test_detect_takes_a_models_answers_where_they_are_worth_asking(spark):
    hits, lines = [(1.0, "Acme Foods buy now", 4, ["cta", "brand_word"])], [(470.0, 490.0, "use my code"), (495.0, 520.0, "use my code today")]
    answer = lambda seq, text: ("v", seq, text)
    answers = spark.createDataFrame([answer(2, '{"decision": "AD", "ad_type": "affiliate", "brand": "Zed"}'), answer(9, '{"decision": "AD"}')], "video_id string, cand_seq int, answer string")
    got = detected(spark, hits, lines, answers=answers)
    assert [(r.ad_type, r.brand, r.signals_used) for r in got] == [("affiliate", "Zed", ["asr", "llm"])]  # an index without an answer drops its candidate
    rules = detected(spark, hits, (), answers=answers)
    assert [(r.ad_type, r.signals_used) for r in rules] == [("preroll", ["ocr"])]


def test_cache_lookup(spark, tmp_path):
    c = spark.createDataFrame([(*candidate(1, 2), "vod"), (*candidate(3, 4), "vod")], schemas.CANDIDATES + ", kind string")
    keyed = results.with_cache(c, spark.createDataFrame([], "cache_key string, judgment string"))
    cache = keyed.where("start_s = 1").select("cache_key", F.lit("yes").alias("judgment"))
    assert {r.start_s: r.judgment for r in results.with_cache(c, cache).collect()} == {1.0: "yes", 3.0: None}
    results.write_lines(c, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_vtt(spark, tmp_path):
    (tmp_path / "t.te-orig.vtt").write_text("WEBVTT\nKind: captions\n\nNOTE 00:00:01.000 --> 00:00:02.000\n\n1\n00:07:48.000 --> 00:07:52.500 align:start\n<c>buy</c> &amp; save\nnow\n\n00:09:49,000 --> 00:09:50,000\nhello\n\n00:10:00.000 --> 00:10:01.000\n \n")
    (tmp_path / "t.hi.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nx\n")
    got = captions.read_vtt(spark, str(tmp_path / "*.vtt")).withColumn("v", F.lit("v"))
    best = captions.best_track(got, "v").orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, r.text, r.lang) for r in best] == [(468.0, 472.5, "buy & save now", "te-orig"), (589.0, 590.0, "hello", "te-orig")]
    chosen = captions.choose_transcript(spark.createDataFrame([("a", "x")], "v string, t string"), spark.createDataFrame([("a", "y"), ("b", "z")], "v string, t string"), "v")
    assert sorted((r.v, r.t, r.source) for r in chosen.collect()) == [("a", "x", "captions"), ("b", "z", "speech")]


def test_gold_and_predictions(spark, tmp_path):
    source = lambda v: {"url": f"https://youtu.be/{v}", "kind": "vod", "duration_s": 100.0}
    seg = lambda a, b: {"start_s": a, "end_s": b, "ad_type": "other", "brand": "B"}
    (tmp_path / "gold.json").write_text(json.dumps({"policy_version": "1", "videos": [{"source": source("a" * 11), "segments": [seg(5, 63), seg(80, 90)]}, {"source": source("b" * 11), "segments": []}]}, indent=1))
    (tmp_path / "p1.json").write_text(json.dumps({"source": source("a" * 11), "segments": [seg(5, 62), seg(95, 99)]}, indent=1))
    gold, pred = results.read_gold(spark, str(tmp_path / "gold.json")), results.read_predictions(spark, str(tmp_path / "p1.json"))
    m = evaluate.matched(gold.where("seq IS NOT NULL"), pred.where("seq IS NOT NULL"), "video_id")
    r = m.first()
    assert (r.tp, r.fp, r.fn, round(r.mean_iou, 4), r.mean_end_error) == (1, 1, 1, 0.9828, 1.0)
    assert evaluate.micro(m).first().asDict() == {"tp": 1, "fp": 1, "fn": 1, "mean_iou": 0.9828, "precision": 0.5, "recall": 0.5, "f1": 0.5}
    empty = evaluate.with_rates(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first()
    assert (empty.precision, empty.recall, empty.f1) == (1.0, 1.0, 1.0)


def test_iou(spark):
    df = spark.createDataFrame([(5.0, 63.0, 5.0, 63.0), (5.0, 63.0, 0.0, 63.0), (0.0, 1.0, 2.0, 3.0), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(intervals.iou(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[0] == 1.0 and 0.9 < got[1] < 1 and got[2:] == [0.0, 0.0]


def loop_plan(d, kind):
    if kind == "short" or d <= 180:
        return [min(d, i / 2) for i in range(int(d * 2) + 1)]
    if kind == "live":
        return [min(d, float(i)) for i in range(int(d) + 1)]
    t, out = 0.0, set()
    while t < d:
        out.add(round(t, 3))
        t += 0.5 if t < 10 else 4.0
    full = sorted(out | {0.0, round(d, 3)})
    if len(full) <= 200:
        return full
    head, body = [x for x in full if x <= 10], [x for x in full if x > 10]
    room = 200 - len(head)
    return head + [body[int(i * len(body) / room)] for i in range(room)]


@pytest.mark.parametrize(("d", "kind"), [(0.0, "short"), (13.2, "short"), (180.0, "vod"), (180.5, "vod"), (621.3, "vod"), (2805.853, "vod"), (300.5, "live")])
def test_sampling(spark, d, kind):
    got = spark.createDataFrame([(d, kind)], "d double, k string").select(sampling.sampling_points(F.col("d"), F.col("k"))).first()[0]
    assert got == loop_plan(d, kind)


def test_folds_keep_the_first_and_drift(spark):
    rows = [("v", i, [float(x)] * 4) for i, x in enumerate([0, 3, 7, 9, 12, 30])]
    got = folds.near_duplicate_plan(spark.createDataFrame(rows, "v string, i int, th array<double>"), ["v"], order="i", thumb="th", least=8.0).orderBy("i").collect()
    assert [r.source for r in got] == [0, 0, 0, 3, 3, 5]
    lines = [("v", 0, 0.0, 1.0, "buy"), ("v", 1, 1.0, 2.0, "buy now"), ("v", 2, 2.0, 3.0, "now"), ("v", 3, 9.0, 10.0, "buy now today"), ("v", 4, 10.0, 11.0, " ")]
    got = folds.rolling_dedupe(spark.createDataFrame(lines, "v string, i int, s double, e double, t string"), ["v"], order="i", start="s", end="e", text="t", within=3.0).orderBy("i").collect()
    assert [(r.s, r.e, r.t) for r in got] == [(0.0, 2.0, "buy now"), (9.0, 10.0, "buy now today")]
    rolled = lambda *lines: [(r.s, r.e, r.t) for r in folds.rolling_dedupe(spark.createDataFrame([("v", i, *x) for i, x in enumerate(lines)], "v string, i int, s double, e double, t string"), ["v"], order="i", start="s", end="e", text="t", within=3.0).orderBy("i").collect()]
    assert rolled((0.0, 9.0, "hello"), (3.0, 5.0, "hello you")) == [(0.0, 9.0, "hello"), (3.0, 5.0, "hello you")]  # three seconds are too many
    assert rolled((0.0, 9.0, "hello"), (2.9, 5.0, "hello you")) == [(0.0, 5.0, "hello you")]  # the end is the new line's
    texts = spark.createDataFrame([("v", i, t) for i, t in enumerate(["a" * 90, "a" * 85, "b"])], "v string, i int, t string")
    assert [len(t) for t in folds.first_texts(texts, ["v"], order="i", text="t").first().texts] == [90, 1]


def test_windows(spark):
    promo, anti = [{"buy": 2, "offer": 1}], [{"news": 1}]
    df = spark.createDataFrame([(["buy", "offer", "buy"],), (["news"],), ([],)], "t array<string>")
    got = [round(r[0], 4) for r in df.select(windows.intent_score(F.lit(1), F.col("t"), promo, anti)).collect()]
    assert got == [1.22, 0.0, 0.22]
    rows = [("v", i, float(s), sc) for i, (s, sc) in enumerate([(0, 5), (10, 9), (30, 9), (100, 1), (120, 2)])]
    top = windows.suppressed_top(spark.createDataFrame(rows, "v string, i int, s double, sc int"), ["v"], score="sc", start="s", seq="i", apart=15, k=3)
    assert sorted(r.s for r in top.collect()) == [10.0, 30.0, 120.0]


def test_sensing_reuses_until_the_picture_changes(spark):
    rows = [("s", i, [float(x)], t) for i, (x, t) in enumerate([(0, "a"), (5, "b"), (9, "c")])]
    got = sampling.sensed(spark.createDataFrame(rows, "k string, i int, th array<double>, t string"), ["k"], order="i", thumb="th", text="t", least=8.0).orderBy("i").collect()
    assert [r.sensed_text for r in got] == ["a", "a", "c"]


def test_persistence(spark):
    rows = [("s", "tr", "acme", float(t)) for t in (0, 2, 4, 6, 8, 14, 21)]
    got = islands.persistent(spark.createDataFrame(rows, "s string, roi string, sig string, t double"), ["s", "roi", "sig"], "t", ["t"], forget=6.0, least=8.0).orderBy("track").collect()
    assert [(r.first_seen, r.last_seen, r.proposed) for r in got] == [(0.0, 14.0, True), (21.0, 21.0, False)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], schemas.HITS)
    assert D.detect(media(spark), none, spark.createDataFrame([], schemas.CAPTIONS), spark.createDataFrame([], "video_id string, cut_s double, cut_seq int"), strong=["a"], medium=["b"]).count() == 0


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("anti", [False, True])
def test_overlap_equals_pairs_compared_one_by_one(spark, anti, inclusive):
    """Ties, touching and inverted intervals, null keys and bounds, one that is very long, and an empty right side."""
    left = [(k, i, s, e) for i, (k, s, e) in enumerate([("a", 0, 4), ("a", 4, 4), ("a", 9, 7), ("a", 30, 31), ("b", -5, -1), ("b", 10**9, 10**9 + 1), (None, 0, 9), ("a", None, 3), ("c", 0, 1), ("a", 0, 4), ("d", 5, None)])]
    right = [("a", 4, 6), ("a", 4, 6), ("a", 7, 7), ("b", -10**12, 10**12), (None, 0, 9), ("a", 25, 30), ("c", None, 2), ("d", 0, 9)]

    def meets(a, b):
        if None in (*a, *b) or a[0] != b[0]:
            return False
        early, late = a[2] - 1, a[3] + 1
        return early <= b[2] and late >= b[1] if inclusive else early < b[2] and late > b[1]

    df = spark.createDataFrame(left, "k string, i int, start bigint, end bigint")
    for rows in (right, []):
        got = intervals.overlap_semi(df, spark.createDataFrame(rows, "k string, start bigint, end bigint"), ["k"], 3, pad=1, anti=anti, inclusive=inclusive)
        assert got.columns == df.columns
        assert sorted(r.i for r in got.collect()) == [a[1] for a in left if any(meets(a, b) for b in rows) != anti]


def test_refined_start_takes_the_first_instant_of_a_span(spark):
    spans = spark.createDataFrame([("a", 1, 10.0, 20.0), ("a", 2, 10.5, 11.0), ("b", 3, 0.0, 1e9), (None, 4, 0.0, 5.0), ("c", 5, 1.0, 2.0)], "k string, i int, span_start double, span_end double")
    hot = spark.createDataFrame([("a", 9.0), ("a", 9.0), ("a", 12.0), ("b", 9e8), (None, 1.0), ("c", 2.5), ("c", None)], "k string, t double")
    got = {r.i: r.span_start for r in intervals.refined_start(spans, hot, ["k"], time="t", width=4.0).collect()}
    assert got == {1: 9.0, 2: 10.5, 3: 9e8, 4: 0.0, 5: 1.0}


def test_squared_length_of_a_bag(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],), (["x"],), (["a", None, "a"],), (None,)], "tokens array<string>")
    got = [r[0] for r in df.select(windows.squared_length(F.col("tokens"))).collect()]
    assert got[:3] == [11.0, 0.0, 1.0] and got[4] is None


@pytest.mark.parametrize("ranges", [1, 3, 8, 40])
def test_a_key_split_over_tasks_folds_as_one(spark, ranges):
    """Drift, jumps and long calm stretches, over ranges that agree at once, late or never; a second key and one of a single row."""
    rng = random.Random(ranges)
    rows, x = [], 0.0
    for i in range(600):
        x += rng.choice([0.2, 0.2, 3.0, -2.0, 9.0 if i % 50 == 0 else 0.0]) if i < 400 else 0.9
        rows.append(("hot", i, [x, x + rng.random()]))
    rows += [("cold", i, [float(i % 9)] * 2) for i in range(40)] + [("one", 7, [1.0, 1.0]), ("one", 8, None), (None, 1, [1.0, 1.0])]
    want, kept = {}, {}
    for k, i, v in rows:
        if k is None or v is None:
            continue
        if k not in kept or sum(abs(a - b) for a, b in zip(kept[k][1], v)) / 2 >= 8.0:
            kept[k] = (i, v)
        want[k, i] = kept[k][0]
    df = spark.createDataFrame(rows, "k string, i int, th array<double>").repartition(5)
    plan = lambda **kw: {(r.k, r.i): r.source for r in folds.near_duplicate_plan(df, ["k"], order="i", thumb="th", least=8.0, **kw).collect()}
    assert plan(ranges=ranges) == plan() == want
    assert folds.near_duplicate_plan(df.limit(0), ["k"], order="i", thumb="th", least=8.0, ranges=ranges).count() == 0


@pytest.mark.parametrize("tolerance", [0.3, 0.75, 5.0])
def test_nearest_instants_equal_all_compared_one_by_one(spark, tolerance):
    rng = random.Random(7)
    at = lambda: rng.choice([None, *(rng.randrange(-40, 400) / 10 for _ in range(30))])
    left = [(i, rng.choice(["a", "b", None, "a"]), at()) for i in range(300)] + [(300, "a", 1.5), (301, "a", 1.5)]
    right = [(i, rng.choice(["a", "c", None, "a"]), at()) for i in range(120)] + [(120, "a", 1.5), (121, "a", 1.5)]
    a, b = spark.createDataFrame(left, "id int, k string, t double"), spark.createDataFrame(right, "q int, k string, t double")
    want, far = {}, set()
    for i, k, t in left:
        near = [(abs(t - u), q, u) for q, j, u in right if None not in (k, t, u) and j == k and abs(t - u) <= tolerance]
        want[i] = min(near)[2] if near else t
        far |= set() if near else {i}
    got = intervals.snap_nearest(a, b, ["k"], "t", tolerance, seq="q").collect()
    assert len(got) == len(left) and {r.id: r.snapped for r in got} == want
    assert sorted(r.id for r in intervals.near_anti(a, b, ["k"], "t", tolerance).collect()) == sorted(far)
    assert intervals.snap_nearest(a, b.limit(0), ["k"], "t", tolerance, seq="q").where("snapped <=> t").count() == len(left)
