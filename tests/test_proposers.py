import json

from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.functions import text as T
from spanforge.plans import proposers as P
from spanforge.streaming import live, ticks

TICK = "session_id string, now_s double, roi_name string, raw_text string, is_chrome boolean, is_brand boolean"


def test_brands_that_stay_are_proposed_and_clocks_never(spark):
    rows = [("s", float(t), "tr", "Acme Foods", False, True) for t in range(0, 12, 2)] + [("s", float(t), "bl", "10:30", True, False) for t in range(0, 12, 2)]
    got = P.lasting(spark.createDataFrame(rows, TICK), known={"acme": "Acme Foods"}).collect()
    assert P.lasting(spark.createDataFrame(rows, TICK)).count() == 0  # no mark and no host: nothing to key on
    assert [(r.start_s, r.end_s, r.source, r.signature) for r in got] == [(0.0, 10.0, "ocr_persist_tr", "acme foods")]
    now = P.spot(spark.createDataFrame(rows, TICK), strong_brands=["acme"]).collect()
    assert len(now) == 6 and {(r.start_s == r.end_s, r.score, r.roi) for r in now} == {(True, 2, "tr")}


def test_scene_breaks(spark):
    rows = [("s", 0.0, [4, 0], "x"), ("s", 1.0, [4, 0], "buy now Rs 500"), ("s", 2.0, [0, 4], "buy now Rs 500"), ("s", 3.0, [4, 0], "x")]
    got = P.scene_breaks(spark.createDataFrame(rows, "session_id string, now_s double, hist array<int>, text string")).collect()
    assert [(r.start_s, r.score, r.is_cut) for r in got] == [(2.0, 4, True)]


def test_intents_and_live_captions(spark):
    lines = [("v", i, 10.0 * i, 10.0 * i + 9, t) for i, t in enumerate(["news of the day", "more news", "x", "y", "z", "w", "a", "b", "buy this course", "buy the course now"])]
    c = spark.createDataFrame(lines, "video_id string, seq int, start_s double, end_s double, text string")
    got = P.intents(c, [{"buy": 1, "course": 1}], [{"news": 1}], ["buy"]).collect()
    assert got and min(r.win_start for r in got) >= 60 and all(r.reasons[0] == "buy" and r.reasons[1].startswith("promo_sim=") for r in got)
    live_rows = P.live_captions(c.withColumnRenamed("video_id", "session_id"), spark.createDataFrame([("v", 35.0)], "session_id string, now_s double")).orderBy("seq").collect()
    assert [(r.seq, r.end_s) for r in live_rows] == [(2, 29.0), (3, 35.0)]
    many = [("v", float(t)) for t in range(0, 110, 3)]
    got = {(r.now_s, r.seq) for r in P.live_captions(c.withColumnRenamed("video_id", "session_id"), spark.createDataFrame(many, "session_id string, now_s double")).collect()}
    assert got == {(t, i) for _, t in many for _, i, a, b, _ in lines if a < t and b > t - P.LOOK_BACK_S}
    seen = P.live_intents(c.withColumnRenamed("video_id", "session_id"), spark.createDataFrame([("v", 30.0), ("v", 99.0)], "session_id string, now_s double"), [{"buy": 1, "course": 1}], [{"news": 1}], ["buy"]).collect()
    assert seen and {r.now_s for r in seen} == {99.0} and all(r.end_s <= r.now_s for r in seen)


def test_statistics_and_projections(spark):
    rows = [("s", float(i), 1, 2) for i in range(1, 21)] + [("t", 5.0, 0, 0)]
    got = {r.session_id: (r.n, r.mean, r.p95, r.cost) for r in P.run_statistics(spark.createDataFrame(rows, "session_id string, tick_ms double, model_calls int, ocr_calls int")).collect()}
    assert got == {"s": (20, 10.5, 19.95, 0.04), "t": (1, 5.0, 5.0, 0.0)}
    import statistics

    for n in (19, 20, 21, 57, 100):
        values = [float((i * 37) % 23) for i in range(n)]
        want = statistics.quantiles(values, n=20)[18] if n >= 20 else max(values)
        assert P.quantile_95(spark.createDataFrame([("s", v) for v in values], "k string, v double"), ["k"], "v").first().p95 == want
    pauses = P.stalls(spark.createDataFrame([("s", float(t)) for t in (0, 2, 14, 15, 40)], "session_id string, arrived_s double")).collect()
    assert sorted(r.pause_s for r in pauses) == [12.0, 25.0]
    bar = P.seek_bar(spark.createDataFrame([(25.0, 50.0, 200.0)], "start_s double, end_s double, duration_s double")).first()
    assert (bar.left_pct, bar.width_pct) == (12.5, 12.5)
    opened = spark.createDataFrame([([(1.234, 2.0, "ocr", "x" * 100)],)], "o array<struct<start_s:double,end_s:double,source:string,text:string>>")
    row = opened.select(P.summary(F.col("o")).alias("o")).first().o[0]
    assert (row.start_s, len(row.text)) == (1.23, 80)


def test_signatures(spark):
    df = spark.createDataFrame([("noise BRIGHT xx plumbing 9876543210 Rs. 499 only",), ("hi",), ("the quiet little river bank",)], "t string")
    assert [r[0] for r in df.select(T.signature("t", {"quiet": "Quiet"})).collect()] == ["", "", "quiet"]


def test_json_source_and_sink(spark, tmp_path):
    cand = {"start_s": 4.0, "end_s": 99.0, "source": "ocr", "texts": ["acme"], "score_hint": 3}
    lines = [{"session_id": "s", "now_s": 8.0, "cands": [cand], "is_end": False}, {"session_id": "s", "now_s": 9.0, "cands": [], "is_end": True}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    query = ticks.write_events(live.stream(ticks.read_ticks(spark, str(tmp_path / "in")), stalls=False), str(tmp_path / "out"), str(tmp_path / "ck"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.schema(schemas.LIVE_EVENTS).json(str(tmp_path / "out")).where("event = 'emitted'").collect()
    assert [(r.start_s, r.end_s, r.now_s) for r in got] == [(4.0, 8.0, 9.0)]


def test_event_time_sessions_in_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 05:00:00", 2.0), (1, "2024-01-01 20:00:00", 4.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = ticks.session_counts(ticks.watermarked(stream), "user_id").writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted((r.n, r.value) for r in spark.table("sessions").collect()) == [(1, 4.0), (2, 3.0)]
