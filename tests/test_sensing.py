import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.operators import folds, islands, sampling
from spanforge.streaming import live, sensing
from tests.conftest import DATA
from tests.streams import drained, fed


def frames_of_vectors(spark):
    """Vectors of a label as a session's ticks, one region each, histograms of their sizes."""
    e = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").where("vec_id < 200")
    thumb = F.col("embedding").cast("array<double>")
    roi = F.struct(F.lit("tr").alias("roi_name"), thumb.alias("thumb"), F.concat(F.lit("text "), F.col("vec_id")).alias("text"))
    return e.select(F.col("label").cast("string").alias("session_id"), F.col("vec_id").cast("double").alias("now_s"), F.array(roi).alias("rois"), F.transform(thumb, F.abs).alias("hist"), F.lit("").alias("text"), F.lit(False).alias("is_end")), e


def split(df, parts, order="now_s"):
    """Micro-batches of a frame by rising time, rows of each in any order."""
    n = df.count()
    numbered = df.withColumn("__n", F.expr(f"row_number() OVER (ORDER BY {order})"))
    step = -(-n // parts)
    return [[numbered.where((F.col("__n") > i * step) & (F.col("__n") <= (i + 1) * step)).drop("__n").orderBy(F.rand(3))] for i in range(parts)]


def test_sensing_streams_as_it_folds(spark, tmp_path):
    frames, e = frames_of_vectors(spark)
    batch = sorted(map(tuple, sensing.sense(frames, unchanged=1.1).select("session_id", "now_s", F.col("rois")[0]["source_s"], F.col("rois")[0]["sensed"], F.col("rois")[0]["raw_text"], F.round("distance", 9)).collect()))
    plan = folds.near_duplicate_plan(e, ["label"], order="vec_id", thumb="embedding", least=1.1)
    assert {(s, t): (at, not sensed) for s, t, at, sensed, _, _ in batch} == {(str(r.label), float(r.vec_id)): (float(r.source), r.reused) for r in plan.collect()}
    assert all(text == f"text {int(at)}" for _, _, at, _, text, _ in batch) and any(not s for *_, s, _, _ in batch)
    cuts = sampling.scene_cuts(e.select("label", "vec_id", F.transform("embedding", F.abs).alias("h")), ["label"], time="vec_id", hist="h", least=0.35, most=10_000)
    assert {(s, t): d for s, t, *_, d in batch if d is not None and d >= 0.35} == {(str(r.label), float(r.vec_id)): pytest.approx(r.distance, abs=1e-8) for r in cuts.collect()}
    stream = sensing.sense(fed(spark, tmp_path, split(frames, 4), schemas.FRAMES), unchanged=1.1)
    got = drained(stream.select("session_id", "now_s", F.col("rois")[0]["source_s"], F.col("rois")[0]["sensed"], F.col("rois")[0]["raw_text"], F.round("distance", 9)), tmp_path, "sensed")
    assert sorted(map(tuple, got)) == batch


def sightings(spark):
    e = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").withColumn("h", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("double"))
    mark = F.struct(F.lit("tr").alias("roi_name"), F.col("event_type").alias("signature"), F.concat("event_type", F.lit("!")).alias("text"))
    ticks = e.groupBy(F.col("user_id").cast("string").alias("session_id"), F.col("h").alias("now_s")).agg(F.collect_list(mark).alias("seen")).select("session_id", "now_s", "seen", F.expr(sensing._NO_CANDS).alias("cands"), F.lit(False).alias("is_end"))
    ends = ticks.groupBy("session_id").agg((F.max("now_s") + 1).alias("now_s")).select("session_id", "now_s", F.expr("CAST(array() AS array<struct<roi_name:string,signature:string,text:string>>)").alias("seen"), F.expr(sensing._NO_CANDS).alias("cands"), F.lit(True).alias("is_end"))
    return e, ticks, ticks.unionAll(ends)


@pytest.mark.parametrize("parts", [1, 7])
def test_lasting_marks_stream_as_they_group(spark, tmp_path, parts):
    """Closed marks on micro-batches, cut and shuffled anyhow, are the tracks that grouping by gaps gives."""
    e, _, rows = sightings(spark)
    want = islands.persistent(e, ["user_id", "event_type"], "h", ["h", "event_id"], forget=24.0, least=24.0)
    want = sorted((str(r.user_id), r.event_type, r.first_seen, r.last_seen, r.n_seen) for r in want.collect())
    closed = lambda rows: sorted((r.session_id, r.signature, r.first_seen, r.last_seen, r.n_seen) for r in rows if r.event == "closed")
    batch = sensing.lasting(rows, forget=24.0, least=24.0).collect()
    assert closed(batch) == want
    got = drained(sensing.lasting(fed(spark, tmp_path, split(rows, parts), schemas.SIGHTED), forget=24.0, least=24.0), tmp_path, f"marks{parts}")
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    assert any(r.event == "proposed" for r in batch)


def test_a_mark_is_proposed_while_it_stays():
    m = sensing.Marks("s", 6.0, 8.0)
    see = lambda now, *marks, end=False: m.row({"now_s": float(now), "seen": [{"roi_name": "tr", "signature": s, "text": s} for s in marks], "is_end": end})
    told = [r[2:7] for t in range(0, 10, 2) for r in see(t, "acme")]
    assert told == [("proposed", "tr", "acme", 0.0, 8.0)]
    assert [r[2:7] for r in see(10)] == [("proposed", "tr", "acme", 0.0, 8.0)] and see(14) == []
    assert m.marks  # a sighting exactly six seconds later, at this tick or in a later batch of it, extends it
    assert [r[6:8] for r in see(14, "acme")] == [(14.0, 6)]
    assert [r[2:8] for r in see(21)] == [("closed", "tr", "acme", 0.0, 14.0, 6)] and not m.marks
    see(22, "zed", "", None)
    assert [r[2:5] for r in see(23, end=True)] == [("closed", "tr", "zed")]


def test_unread_and_missing_pictures():
    s = sensing.Sense("s")
    row = lambda now, thumb, text, hist=None: s.row({"now_s": now, "rois": [{"roi_name": "tr", "thumb": thumb, "text": text}], "hist": hist, "text": None, "is_end": False})[0]
    assert row(0.0, [0.0, 0.0], "a", [4.0, 0.0])[2][0]["raw_text"] == "a"
    kept = row(2.0, [7.0, 7.0], "b")
    assert (kept[2][0]["raw_text"], kept[2][0]["mae"], kept[2][0]["sensed"], kept[3]) == ("a", 7.0, False, None)
    drift = row(4.0, [8.0, 8.0], "c", [0.0, 4.0])
    assert (drift[2][0]["raw_text"], drift[3]) == ("c", 1.0)  # against the picture last read; the histogram of the last tick that had one
    assert row(6.0, None, "d")[2][0]["raw_text"] == "d" and row(8.0, [8.0, 8.0], None)[2][0]["raw_text"] == ""
    assert sensing.moved([0.0], [0.0]) is None and sensing.moved([1.0], [1.0, 2.0]) is None
    assert s.row({"now_s": 9.0, "rois": None, "hist": None, "text": None, "is_end": None})[0][2] == []


def test_three_stateful_operators_run_as_one_append_query(spark, tmp_path):
    """Frames to events: a mark that stays becomes a track, a clock doesn't, and the stream gives what the table gives."""
    rng = random.Random(2)
    still, rows = [[float(rng.randrange(200)) for _ in range(4)] for _ in range(3)], []
    for session in ("s", "t"):
        for t in range(2, 60, 2):
            shown = 10 <= t < 34
            rois = [
                {"roi_name": "tr", "thumb": still[1 if shown else 0], "text": "visit acme-foods.com today" if shown else ""},
                {"roi_name": "bottom", "thumb": [float(t % 200)] * 4, "text": f"10:{t:02d}"},
            ]
            rows.append((session, float(t), rois, [float(t // 20 == i) * 9 for i in range(3)], "buy now Rs 500" if t == 40 else "", t == 58))
    frames = spark.createDataFrame(rows, schemas.FRAMES)
    batch = sensing.live_events(frames).collect()
    emitted = sorted((r.session_id, r.start_s, r.end_s, r.source, r.signature, r.triggers) for r in batch if r.event == "emitted")
    assert emitted == [(s, 10.0, 32.0, "ocr_persist_tr", "acme-foods.com", ["persist_roi", "live_overlay"]) for s in "st"]
    sighted = {(r.now_s): r for r in sensing.sighted(sensing.sense(frames)).where("session_id = 's'").collect()}
    assert [t for t, r in sighted.items() if r.is_cut] == [20.0, 40.0] and [c.source for c in sighted[40.0].cands] == ["ocr_break"]
    stream = sensing.live_events(fed(spark, tmp_path, split(frames, 5), schemas.FRAMES))
    assert sorted(map(tuple, drained(stream, tmp_path, "chained"))) == sorted(map(tuple, batch))


def test_distance_is_the_columns(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, 0.0, 1.0]
    col = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(sampling.bhattacharyya(F.col("a"), F.col("b"))).first()[0]
    assert sensing.moved(a, b) == pytest.approx(col) and np.isfinite(col) and live.SILENCE_S == 6
