import pytest
from pyspark.sql import functions as F

from spanforge import catalogue
from spanforge.functions import text as T
from spanforge.functions import urls as U
from tests.conftest import DATA


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("04:37 PM", "pm"), ("10:30:05", ""), ("100 200 300", ""), ("Buy  NOW 50%", "buy now 50%"), (None, ""), ("", "")])
def test_normalise(spark, text, want):
    assert one(spark, T.normalise("t"), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("call 489297 21641 now", ["89297 21641"]), ("9876543210 and 9876543210, 6123456789", ["98765 43210", "61234 56789"]), ("09876543210", ["98765 43210"]), ("98765432101", ["98765 43210"]), ("9876543210 or 74169 02233", ["98765 43210", "74169 02233"]), ("74169-0223", []), ("1 9876 5432 10", ["98765 43210"]), ("12 34", []), (None, [])])
def test_phones(spark, text, want):
    assert one(spark, T.phones("t"), t=text) == want


@pytest.mark.parametrize(("text", "score"), [("72,000", 0), ("$085", 0), ("$85", 0), ("cars 50 left", 0), ("Rs 499 only", 2), ("rs.499", 2), ("Rs499", 0), ("₹5", 2), ("499/-", 2), ("INR 5", 2), ("plumbing 9876543210", 4), ("Rs 499 episode", 2), ("sponsored episode", 0), (None, 0),
    ("call 74169 02233", 2), ("74169 0223", 2), ("74169 0223x", 0), ("489297 21641", 2), ("1 9876 5432 10", 2)])
def test_class_score(spark, text, score):
    assert one(spark, T.class_score("t"), t=text) == score


def test_live_score_ignores_services_and_floors_strong_brands(spark):
    assert one(spark, T.live_score("t"), t="plumbing") == 0
    assert one(spark, T.live_score("t", ["acme"]), t="ACME plumbing") == 2
    assert one(spark, T.live_score("t"), t="1 9876 5432 10") == 0 and one(spark, T.live_score("t"), t="98765-43210") == 2


@pytest.mark.parametrize(("text", "chrome"), [("LIVE 10:30", True), ("news channel", True), ("abc", True), ("Acme Cola", False), ("12/10/2024 10:30 PM", True), (None, True),
    ("LIVE | NEWS 24", True), ("AUG 29 2026 SATURDAY", True), ("LIVE|O7:10PM", True), ("04:37 PM", True), ("22:15", True), ("news live", True), ("breaking news", True), ("   ", True), ("OK", True), ("42", True), ("G-Mart", False), ("BHIM UPI", False), ("LIVE 10:30 Acme Cola", False), ("a b c d", True), ("Acme 10:30 11:45", False)])
def test_chrome_and_brand(spark, text, chrome):
    assert one(spark, T.is_chrome("t"), t=text) is chrome
    assert one(spark, T.is_brand_candidate("t"), t=text) is not chrome


@pytest.mark.parametrize(("text", "brand"), [("by Acme Foods today", "Acme Foods"), ("try zed now", "Zed Cola"), ("the BRIGHT way", "BRIGHT"), ("at Blue River", "Blue River"), ("nothing here", ""), (None, ""),
     ("new Zoomo® tyres", "Zoomo"), ("LIVE™ from Oslo Bright River", "Oslo Bright River"), ("Meet Nova Ultra now", "Nova"), ("the City Care Hospital", "City Care Hospital"), ("tile cleaning 98765 43210 Single Heart", "Tidy House"), ("LIVE NEWS ABC", "ABC")])
def test_brands(spark, text, brand):
    assert one(spark, T.title_brand("t", {"zed": "Zed Cola"}, services="(?i)cleaning", service_brands={"tile": "Tidy House"}), t=text) == brand


def test_scripts_without_latin_are_no_brand(spark):
    assert one(spark, T.is_brand_candidate("t"), t="കേരള വാർത്ത") is False and one(spark, T.is_chrome("t"), t="കേരള വാർത്ത") is False
    assert one(spark, T.is_brand_candidate("t", channels=["citynews"]), t="CityNews കേരള വാർത്ത") is False  # the channel's name is no brand


def test_words_end_where_scripts_meet(spark):
    assert one(spark, T.words("t"), t="abcकख x1తె") == ["abc", "कख", "x1", "తె"]


def test_lexicon_guard(spark):
    waived = T.lexicon_score("t", ["enroll"], ["offer"], guard=["welcome to"], waive=["enroll"])
    assert one(spark, waived, t="Welcome to my enroll offer") == 4 and one(spark, waived, t="welcome to my offer") == 0
    score = T.lexicon_score("t", ["use my code"], ["offer"], guard=["my name is"])
    assert one(spark, score, t="Use my code for the offer") == 4
    assert one(spark, score, t="My name is X, use my code") == 0


def test_overlay_text_and_scripts(spark):
    row = lambda t, brand: one(spark, T.overlay_text("t", F.col("b"), {"acme": "Acme Cola"}), t=t, b=brand)
    assert row("Acme Cola plumbing 98765 43210 अपना घर", "Acme Cola") == "Acme Cola | plumbing | 98765 43210 | अपना घर"
    assert row("plumbing at Rs 499", "") == "plumbing | Rs 499"
    assert row("Blue River Centre", "Blue Center") == "Blue Center"  # its one part repeats the brand
    assert one(spark, T.script_language("t"), t="తెలుగు") == "te"
    for text, want in (("x अपना घर y అమ్మకం x", "अपना घर అమ్మకం"), ("कख, गघ", "कख, गघ"), ("कखग", ""), ("कखगघ\n కఖ! x कखगघ  కఖ!", "कखगघ కఖ!"), (None, "")):
        assert one(spark, T.native_spans("t"), t=text) == want


def test_banners(spark):
    raw = ". = 2 <i el Show aa 8o HD Hd Some? $e Soden SenwSb06! - ax Avis Vascular Centre | CEs) @ i 489297 21641"
    cleaned = one(spark, T.clean_banner("t"), t=raw)
    assert cleaned == "Avis Vascular Centre | 89297 21641"
    two = "Tile cleaning and plumbing Rs 499 or 599/- Acme Dental Clinic, Zed Imaging Centre 9876543210"
    assert one(spark, T.clean_banner("t", {"zed": "Zed"}, institutions=["dental", "imaging"]), t=two).split(" | ") == ["Acme Dental Clinic", "Zed Imaging Centre", "cleaning", "plumbing", "Rs 499", "599/-", "98765 43210"]
    assert one(spark, T.clean_banner("t"), t="ab cd 12 abc 12345") == "abc 12345" and one(spark, T.clean_banner("t"), t=None) == ""
    df = spark.createDataFrame([(["news of today, a long line", " call 74169 02233", "plumbing 74169 02233", None, ""],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(T.best_banner(F.col("t"))).collect()] == ["plumbing 74169 02233", "", ""]


@pytest.mark.parametrize(("text", "code"), [
    ("HTTP Error 429 private video", ("youtube_bot_check", "rate_limited")), ("This video is private", ("private_video", "private_or_missing")), ("The uploader has not made this video available in your country", ("geo_blocked", "instagram_auth")),
    ("There is no video in this post, it is private", ("youtube_bot_check", "unsupported_media")), ("login required", ("youtube_bot_check", "instagram_auth")), ("gone", ("youtube_bot_check", "instagram_auth")), (None, ("youtube_bot_check", "instagram_auth")),
])
def test_error_order(spark, text, code):
    assert tuple(one(spark, T.platform_error("t", F.lit(p)), t=text) for p in ("youtube", "instagram")) == code


@pytest.mark.parametrize(("text", "key"), [("10:30 PM visit shop-easy.com today", "shop-easy.com"), ("zed again", "zed cola"), ("citynews.in LIVE", ""), ("moswll ticker junk", ""), (None, "")])
def test_signature_keys_on_marks_and_hosts_alone(spark, text, key):
    assert one(spark, T.signature("t", {"zed": "Zed Cola"}), t=text) == key


def test_now_is_utc_text(spark):
    from datetime import UTC, datetime

    now = spark.range(1).select(T.utc_now()).first()[0]
    assert abs(datetime.fromisoformat(now).timestamp() - datetime.now(UTC).timestamp()) < 60


def test_small_functions(spark):
    assert one(spark, T.clock_seconds("t"), t="01:02:03,5") == 3723.5
    assert one(spark, T.clock_seconds("t"), t="07:48") == 468.0
    assert one(spark, T.clock_seconds("t"), t="x") is None
    assert one(spark, T.strip_markup("t"), t="<b>a&amp;b</b>  c&lt;d") == "a&b c<d"
    assert one(spark, T.first_json("t"), t='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert len(one(spark, T.cache_key(F.col("t"), F.lit("y")), t="x")) == 24
    assert one(spark, T.is_rate_limit(F.lit(503), F.col("t")), t=None) is True


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://e.com/p/Ab1?igsh=x&b=2&utm_source=q#f", "https://e.com/p/Ab1?b=2"), ("https://e.com/p/?igshid=1", "https://e.com/p/"), ("https://e.com", "https://e.com/"), ("https://e.com/?IGSH=1&UTM_a=2&flag", "https://e.com/?flag="), ("/reel/x1?igsh=2", "https://www.instagram.com/reel/x1"), (None, "")],
)
def test_normalise_url(spark, url, want):
    assert one(spark, U.normalise_url("t"), t=url) == want


@pytest.mark.parametrize(
    ("url", "hint", "dur", "kind", "platform", "vid"),
    [
        ("https://www.youtube.com/watch?v=abcdefghijk", "", 52.0, "short", "youtube", "abcdefghijk"),
        ("https://youtu.be/abcdefghijk", "", 400.0, "vod", "youtube", "abcdefghijk"),
        ("https://www.youtube.com/live/abcdefghijk", "", None, "live", "youtube", "abcdefghijk"),
        ("https://www.instagram.com/reel/XyZ_1/", "", None, "short", "instagram", "XyZ_1"),
        ("https://www.instagram.com/live/", "", None, "vod", "instagram", ""),
        ("https://www.instagram.com/tv/AbC/", "", None, "vod", "instagram", "AbC"),
        ("https://instagr.am/share/reels/q9", "", None, "short", "instagram", "q9"),
        ("https://youtube.com/embed/abcdefghijk", "", None, "vod", "youtube", "abcdefghijk"),
        ("https://example.org/livestream/x", "", None, "live", "other", ""),
        ("https://example.org/lively/p/x", "", None, "vod", "other", ""),
        ("/data/a.mp4", "live", 10.0, "live", "file", ""),
    ],
)
def test_kinds(spark, url, hint, dur, kind, platform, vid):
    df = spark.createDataFrame([(url, hint, dur)], "u string, h string, d double")
    assert df.select(U.kind("u", F.col("h"), F.col("d")), U.platform("u"), U.video_id("u")).first() == (kind, platform, vid)


#: Texts in which the classes' own words begin, end, meet letters or are cut off.
NEAR = ("", "Plumbing", "xplumbing", "repairs!", "REPAIRED", "20% OFF", "20 off", "5 %off", "Versailles sale", "buy nowhere", "Call Us", "since inc", "prince", "Rs 5", "rs\n\t5", "hours 5", "xrs 5", "inr  7", "INR 7", "₹ 9", "₹9", "12/-", "1,2 /-", "rs.4", "98765 4321", "9 8 7 6 5 4 3 2 1 0", "98765-43210", "İnc", "comedy", "Breaking news, call us", "episode ₹5", None)


def test_classes_looked_for_once_are_those_of_the_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(NEAR)], "i int, t string")
    shown = F.coalesce("t", F.lit(""))
    want = [*[shown.rlike(p) for _, p, _ in T.CLASSES], shown.rlike(T.EDITORIAL), F.size(T.phones("t")) > 0]
    for r in df.select("t", T.class_matches("t").alias("got"), F.array(*want).alias("want")).collect():
        assert r.got == r.want, r.t


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_banner_is_cleaned_once_a_row(spark):
    plan = planned(catalogue.overlay_parts(spark, f"{DATA}/sf0.001"))
    assert plan.count("catering|tutoring") == 1


def test_classes_are_looked_for_once_a_row(spark):
    plan = planned(catalogue.overlay_score(spark, f"{DATA}/sf0.001"))
    assert plan.count("discount|cashback") == 1 and plan.count("catering|tutoring") == 1


def test_spots_look_for_a_class_once_in_the_filter_and_once_in_what_stays(spark):
    plan = planned(catalogue.live_spots(spark, f"{DATA}/sf0.001"))
    assert plan.count("inr[") == 2


def test_speech_is_chosen_with_one_fold(spark):
    plan = catalogue.transcript_choice(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(x) for x in ("MapInPandas", "MapInArrow")) == 1
