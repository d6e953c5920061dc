import json
import time

import pyarrow as pa
import pytest

from spanforge import schemas
from spanforge.streaming import live, machines
from tests.streams import drained, fed


def cand(start, end, text="acme", source="ocr_persist_tr", score=3, triggers=("persist_roi",)):
    return {"start_s": float(start), "end_s": float(end), "source": source, "raw_triggers": list(triggers), "texts": [text] if text is not None else None, "frame_timestamps": [float(start), float(end)], "score_hint": score}


def ticks(spark, rows, session="s"):
    return spark.createDataFrame([(session, float(now), cands, end) for now, cands, end in rows], schemas.LIVE_TICKS)


def emitted(events):
    return sorted((r.now_s, r.start_s, r.end_s) for r in events if r.event == "emitted")


CASES = {
    "silence": ([(8, [cand(4, 8)], False), (12, [], False), (14, [], False)], [(14.0, 4.0, 8.0)]),
    "flash": ([(2, [cand(1, 2)], False), (10, [], False), (12, [], True)], []),
    "flush": ([(18, [cand(5, 18)], False), (20, [], True)], [(20.0, 5.0, 18.0)]),
    "future": ([(10, [cand(400, 410), cand(5, 999)], False), (12, [], True)], [(12.0, 5.0, 10.0)]),
    "evidence at the closing tick extends": ([(8, [cand(4, 8)], False), (14, [cand(13, 14)], False), (16, [], True)], [(16.0, 4.0, 14.0)]),
    "weak": ([(8, [cand(4, 8, score=0)], False), (20, [], True)], []),
    "two regions of one text are one track": ([(10, [cand(2, 8), cand(4, 10, source="ocr_persist_br")], True)], [(10.0, 2.0, 10.0)]),
    "two texts that last are two tracks": ([(10, [cand(2, 8), cand(4, 10, "zed")], True)], [(10.0, 2.0, 8.0), (10.0, 4.0, 10.0)]),
    "nothing told": ([(10, [cand(2, 8, None, source="asr")], True)], [(10.0, 2.0, 8.0)]),
}


@pytest.mark.parametrize("name", CASES)
def test_replay(spark, name):
    rows, want = CASES[name]
    assert emitted(live.replay(ticks(spark, rows)).collect()) == want


def test_long_tracks_are_committed_and_open_ends_grow(spark):
    rows = [(t, [cand(0, t)], False) for t in range(2, 200, 2)]
    events = sorted(live.replay(ticks(spark, rows)).collect(), key=lambda r: r.seq)
    assert emitted(events)[0] == (180.0, 0.0, 180.0)
    ends = [r.end_s for r in events if r.event == "open" and r.track == 0]
    assert ends == sorted(ends) and all(r.end_s <= r.now_s for r in events)
    assert [r.status for r in events][:2] == ["EXTENDING", "EXTENDING"]
    assert [r.seq for r in events] == list(range(1, len(events) + 1))


def test_matching():
    track = {"start_s": 0.0, "end_s": 5.0, "signature": "", "source": "ocr"}
    c = lambda a, b, signature="", source="ocr": {"start_s": a, "end_s": b, "signature": signature, "source": source}
    assert live.meets(track, c(10, 12)) and not live.meets(track, c(20, 22))
    assert live.meets(track | {"signature": "acme cola"}, c(20, 22, "acme")) and live.meets(track | {"signature": "acme"}, c(20, 22, "acme cola"))
    assert not live.meets(track, c(5, 6, "", "ocr_persist_tr")) and not live.meets(track | {"source": "ocr_persist_br"}, c(5, 6))
    assert live.meets(track | {"signature": "acme", "source": "ocr_persist_br"}, c(50, 60, "acme", "asr"))  # one brand joins what lasts and what doesn't


def test_all_evidence_of_a_track_is_kept(spark):
    rows = [
        (4, [cand(1, 3, "buy", "ocr", 1, ("cta",))], False),
        (8, [cand(3, 9, "buy at acme.com now", "asr", 4, ("promo", "cta")), cand(6, 7, "buy", "intent", 2, ("intent",))], False),
        (10, [], True),
    ]
    (got,) = [r for r in live.replay(ticks(spark, rows)).collect() if r.event == "emitted"]
    assert (got.start_s, got.end_s, got.source, got.score) == (1.0, 8.0, "ocr+asr+intent", 4)
    assert got.triggers == ["cta", "promo", "intent"] and got.texts == ["buy", "buy at acme.com now", "buy"] and got.text == "buy at acme.com now"
    assert got.frame_timestamps == [1.0, 3.0, 3.0, 6.0, 7.0]  # a frame at 9 can't be seen at 8
    assert got.signature == "buy"


def test_an_empty_signature_is_filled(spark):
    rows = [(4, [cand(1, 3, "", "ocr")], False), (8, [cand(5, 8, "see acme.com", "ocr")], False), (10, [], True)]
    (got,) = [r for r in live.replay(ticks(spark, rows)).collect() if r.event == "emitted"]
    assert got.signature == "acme.com" and got.roi == ""


def test_a_session_tells_its_statistics_at_its_end(spark):
    (end,) = [r for r in live.replay(ticks(spark, CASES["flush"][0])).collect() if r.event == "session_end"]
    assert json.loads(end.text) == {"ticks": 2, "tracks": 1, "emitted": 1, "events": 3} and end.seq == 3


ROWS = [*CASES["silence"][0], (20, [cand(15, 20, "zed")], False), (21, [cand(15, 21, "zed x", "asr")], False), (22, [], True), (3, [cand(1, 3)], False), (5, [], True)]


@pytest.mark.parametrize("at_once", [1, 3, 100])
def test_stream_equals_replay(spark, tmp_path, at_once):
    """However ticks fall into micro-batches, in whatever order inside one; the second session of one id starts anew."""
    first, again = ROWS[:6], ROWS[6:]
    want = []
    for part in (first, again):
        want += map(tuple, live.replay(ticks(spark, part).unionAll(ticks(spark, [(t + 1, c, e) for t, c, e in part], "other"))).collect())
    rows = [ticks(spark, [r]).unionAll(ticks(spark, [(r[0] + 1, *r[1:])], "other")) for r in first]
    groups = [rows[i : i + at_once][::-1] for i in range(0, len(rows), at_once)] + [[ticks(spark, [r]).unionAll(ticks(spark, [(r[0] + 1, *r[1:])], "other"))] for r in again]
    source = fed(spark, tmp_path, groups, schemas.LIVE_TICKS)
    assert sorted(map(tuple, drained(live.stream(source, stalls=False), tmp_path, "live_events"))) == sorted(want)


def test_a_late_tick_counts_at_the_time_of_the_later_one():
    machine = live.Tracks("s")
    tick = lambda now, cands=(), end=False: {"now_s": float(now), "cands": list(cands), "is_end": end}
    seen = {"start_s": 1.0, "end_s": 4.0, "source": "asr", "roi": "", "signature": "x", "triggers": [], "texts": ["x"], "frame_timestamps": [], "score": 1}
    machine.row(tick(9))
    (event,) = machine.row(tick(5, [seen]))
    assert event[2] == 9.0 and event[3] == "open"


def test_a_silent_session_stalls_once_and_then_closes(spark, tmp_path):
    """Processing-time timers in a running query: one row a stall, then the closing of what is open."""
    source = fed(spark, tmp_path, [[ticks(spark, CASES["flush"][0][:1])]], schemas.LIVE_TICKS)
    query = live.stream(source, stall_s=1.0, expire_s=6.0).writeStream.format("memory").queryName("stalled").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    seen = lambda: [r.event for r in spark.sql("SELECT * FROM stalled ORDER BY seq").collect()]
    try:
        until = time.time() + 90
        while time.time() < until and "stalled" not in seen():
            time.sleep(0.3)
        assert seen()[:2] == ["open", "stalled"]
        while time.time() < until and "session_end" not in seen():
            time.sleep(0.3)
        assert seen() == ["open", "stalled", "emitted", "session_end"]
        time.sleep(3)
        assert seen() == ["open", "stalled", "emitted", "session_end"]  # state is gone: no further stall
    finally:
        query.stop()


def test_the_last_events_of_each_session(spark):
    rows = [(s, i) for s, n in (("a", 5), ("b", 2)) for i in range(1, n + 1)]
    numbered = spark.createDataFrame(rows, "session_id string, seq long")
    assert sorted(map(tuple, live.last_events(numbered, 2).collect())) == [("a", 4), ("a", 5), ("b", 1), ("b", 2)]
    assert [r.seq for r in live.since(numbered, "a", 1, 3).collect()] == [3, 4, 5]
    assert [r.seq for r in live.since(numbered, "a", 4).collect()] == [5] and live.since(numbered, "c", 0).count() == 0


def test_commits_are_judged_snapped_and_clamped(spark):
    base = ["s", 1, 20.0, "emitted", 0, 4.0, 30.0, "COMMITTED", "ocr_persist_tr", "tr", "", [], [], [4.0, 30.0], "", 3]
    names = [c.split(" ")[0] for c in schemas.LIVE_EVENTS.split(", ")]
    row = lambda **k: tuple((dict(zip(names, base)) | k)[n] for n in names)
    rows = [
        row(triggers=["cta", "brand_word"], texts=["Acme Foods buy now"]),
        row(track=1, end_s=19.004, source="asr", texts=["sponsored by zed, buy now"], triggers=["cta", "sponsor"]),
        row(track=2, end_s=9.0, source="ocr_spot", texts=["pay Rs 500"], triggers=["price"]),
        row(track=3, event="open", end_s=9.0, status="EXTENDING", texts=["Acme Foods buy now"]),
    ]
    events = spark.createDataFrame(rows, schemas.LIVE_EVENTS)
    told = lambda df: {r.track: (r.start_s, r.end_s, r.ad_type, r.brand, r.presentation) for r in df.collect()}
    assert told(live.committed(events)) == {0: (4.0, 20.0, "other", "Acme Foods", "overlay"), 1: (4.0, 19.0, "midroll_sponsor_read", "", None)}
    cuts = spark.createDataFrame([("s", 3.5, 1), ("s", 4.5, 0), ("s", 19.5, 2), ("s", 20.3, 3), ("t", 4.0, 0)], "session_id string, cut_s double, cut_seq int")
    assert {k: v[:2] for k, v in told(live.committed(events, cuts=cuts)).items()} == {0: (4.5, 20.0), 1: (4.5, 19.5)}  # the cut at 20.3 isn't known yet


def test_a_live_commit_has_its_evidence(spark):
    rows = [(4, [cand(1, 3, "buy now at acme foods", "ocr", 2, ("cta", "brand_word"))], False), (12, [cand(3, 12, "our discount", "asr", 4, ("promo",))], False), (20, [], True)]
    (got,) = live.committed(live.replay(ticks(spark, rows))).collect()
    assert (got.signals_used, got.transcript_span, got.frame_timestamps) == (["asr", "ocr"], "buy now at acme foods our discount", [1.0, 3.0, 3.0, 12.0])


def test_last_events_of_a_replay_come_without_a_second_pass(spark):
    """Also of a session that sends on after its end, whose numbers start anew."""
    rows = [(float(t), [cand(t - 1, t, score=2)] if t % 3 else [], t in (9, 15)) for t in range(1, 20)]
    t = ticks(spark, rows).unionAll(ticks(spark, rows[:7], "other"))
    columns = ["session_id", "seq", "now_s", "event", "track", "end_s"]
    for most in (1, 4, 50):
        got = live.replay(t, columns=columns, most=most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.last_events(live.replay(t), most).select(*columns).collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    chosen = live.replay(t, kinds=["emitted"]).collect()
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, live.replay(t).where("event = 'emitted'").collect())) and chosen
    assert [r.event for r in live.replay(t, columns=["event"], kinds=["session_end"]).collect()] == ["session_end"] * 2


def test_plain_values_are_those_of_arrow():
    kind = pa.struct([("a", pa.float64()), ("b", pa.list_(pa.string())), ("c", pa.int32())])
    rows = [None, [], [{"a": 1.5, "b": ["x", None], "c": 2}, {"a": None, "b": None, "c": None}], [None], [{"a": 2.0, "b": [], "c": 1}]]
    for array in (pa.array(rows, pa.list_(kind)), pa.array(rows, pa.list_(kind)).slice(2, 2), pa.array(rows[:3] + rows[4:], pa.list_(kind)).slice(1), pa.array([True, None]), pa.array([1, 2])):
        assert machines.plain(array) == array.to_pylist()
