import json

import pytest
from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.streaming import captions, growing, live, log, ticks
from tests.conftest import DATA
from tests.streams import drained, fed, resumed
from tests.test_live import ROWS, cand
from tests.test_live import ticks as tick_rows


def said(spark, d="sf0.001"):
    c = spark.read.parquet(f"{DATA}/{d}/conversations.parquet")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), "turn", (F.col("turn") * 10.0).alias("start_s"), (F.col("turn") * 10.0 + 8).alias("end_s"))


def test_look_back_streams_as_it_joins(spark, tmp_path):
    """Captions and ticks in micro-batches of media time equal a join by times."""
    c, clock = said(spark), said(spark).select("session_id", (F.col("turn") * 7.0 + 3).alias("now_s"))
    joined = c.join(clock, "session_id").where("start_s < now_s AND end_s > now_s - 16").select("session_id", "now_s", "turn", "start_s", F.least("end_s", "now_s").alias("end_s"))
    want = sorted(map(tuple, joined.collect()))
    assert sorted(map(tuple, captions.look_back(c, clock).collect())) == want
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    cuts = [(-1, 20), (20, 45), (45, 10_000)]
    first = fed(spark, a, [[c.where((F.col("start_s") > lo) & (F.col("start_s") <= hi)).orderBy(F.rand(1))] for lo, hi in cuts], c.schema)
    second = fed(spark, b, [[clock.where((F.col("now_s") > lo) & (F.col("now_s") <= hi)).orderBy(F.rand(2))] for lo, hi in cuts], clock.schema)
    assert sorted(map(tuple, drained(captions.look_back(first, second), tmp_path, "looked_back"))) == want


def test_look_back_holds_what_can_still_be_seen():
    m, most = captions.LookBack("s", 16.0), 0
    for t in range(1, 2001):
        m.row({"now_s": float(t), "c": {"seq": t, "start_s": float(t), "end_s": t + 3.0}, "is_end": False})
        if t % 2 == 0:
            seen = m.row({"now_s": float(t), "c": None, "is_end": False})
            assert [r[2] for r in seen] == [s for s in range(1, t + 1) if s < t and s + 3 > t - 16]
        most = max(most, len(m.held))
    assert most < 25
    m.row({"now_s": 2001.0, "c": None, "is_end": True})
    assert m.held == []


def test_state_of_a_running_look_back_is_bounded(spark, tmp_path):
    schema = "session_id string, seq long, start_s double, end_s double"
    lines = [spark.createDataFrame([("s", i, float(i), i + 2.0) for i in range(at, at + 250)], schema) for at in range(0, 1000, 250)]
    clocks = [spark.createDataFrame([("s", float(i)) for i in range(at, at + 250)], "session_id string, now_s double") for at in range(0, 1000, 250)]
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    stream = captions.look_back(fed(spark, a, [[x] for x in lines], schema), fed(spark, b, [[x] for x in clocks], clocks[0].schema))
    query = stream.writeStream.format("memory").queryName("bounded").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    assert len(held) >= 4 and max(held) <= 2  # one session's list, and its length counted


def test_growing_files_are_read_once_and_by_whole_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    file, other = folder / "a.jsonl", folder / "b.jsonl"
    (folder / "_hidden").write_text("no\n")

    def run():
        return [value for _, _, value in resumed(growing.read_lines(spark, str(folder), range_bytes=7), tmp_path)]

    file.write_text("one\ntwo two two two\nthr")
    assert sorted(run()) == ["one", "two two two two"]
    with file.open("a") as f:
        f.write("ee\r\n\nfour")
    other.write_text("é" * 40 + "\n")
    assert sorted(run()) == ["", "three", "é" * 40]
    assert run() == []
    with file.open("a") as f:
        f.write("\n")
    assert run() == ["four"]
    file.write_text("x\n")
    with pytest.raises(Exception, match="have been read"):
        run()


def test_ranges_cut_anywhere_give_each_line_once(tmp_path):
    data = b"".join(b"x" * (i % 5) + b"\n" for i in range(50))
    (tmp_path / "f").write_bytes(data + b"open")
    with (tmp_path / "f").open("rb") as f:
        end = growing.finished(f, len(data) + 4, 0)
        assert end == len(data) and growing.finished(f, len(data) + 4, end) == end
        for size in (1, 2, 3, 7, 1000):
            got = [x for at in range(0, end, size) for x in growing.lines_of(f, at, min(at + size, end), 0)]
            assert [line for _, line in got] == data.splitlines(keepends=True) and all(data[at : at + len(line)] == line for at, line in got)


def test_ticks_of_a_growing_file_become_events(spark, tmp_path):
    file = tmp_path / "ticks.jsonl"
    line = lambda now, cands, end: json.dumps({"session_id": "s", "now_s": now, "cands": cands, "is_end": end}) + "\n"
    file.write_text(line(8.0, [cand(4, 8)], False) + "no tick\n" + line(12.0, [], False)[:9])
    run = lambda: [e[3] for e in sorted(resumed(live.stream(growing.read_growing_ticks(spark, str(file)), stalls=False), tmp_path), key=lambda e: e[1])]
    assert run() == ["open"]
    with file.open("a") as f:
        f.write(line(12.0, [], False)[9:] + line(20.0, [], True))
    assert run() == ["open", "emitted", "session_end"]


def test_a_killed_log_goes_on_without_a_gap_or_a_repeat(spark, tmp_path, monkeypatch):
    rows, at = ROWS[:6], str(tmp_path / "log")
    want = sorted(map(tuple, ticks.clamp(live.replay(tick_rows(spark, rows))).collect()))
    source = fed(spark, tmp_path, [[tick_rows(spark, [r])] for r in rows], schemas.LIVE_TICKS)
    whole, tries = log.put_batch, []

    def dies(batch, number, path):
        tries.append(number)
        if tries.count(number) == 1 and number in (1, 3):
            batch.write.mode("overwrite").parquet(f"{path}/events/batch={number}")  # the events are there, the ledger isn't
            raise RuntimeError("killed")
        whole(batch, number, path)

    monkeypatch.setattr(log, "put_batch", dies)
    seen = []
    for _ in range(3):
        query = log.write_log(live.stream(source, stalls=False), at, str(tmp_path / "ck"))
        try:
            query.processAllAvailable()
        except Exception as e:
            assert "killed" in str(e)
        finally:
            query.stop()
        seen.append(log.read_log(spark, at).count())
    assert tries == [0, 1, 1, 2, 3, 3, 4, 5] and seen[0] < seen[1] < seen[2] == len(want)
    got = log.read_log(spark, at)
    assert sorted(map(tuple, got.select(*[c.split(" ")[0] for c in schemas.LIVE_EVENTS.split(", ")]).collect())) == want
    assert [r.seq for r in got.orderBy("seq").collect()] == list(range(1, len(want) + 1))
    assert [r.seq for r in log.recent(spark, at, 2).orderBy("seq").collect()] == [len(want) - 1, len(want)]
    (stats,) = log.statistics(got).collect()
    assert (stats.session_id, stats.ticks, stats.events) == ("s", 6, len(want))
    assert sum(r.n for r in log.ledger(spark, at).collect()) == len(want)


def test_events_are_clamped_to_their_ticks(spark):
    e = spark.createDataFrame([(10.0, 10.04), (10.0, 10.06), (10.0, 9.0)], "now_s double, end_s double")
    assert sorted(r.end_s for r in ticks.clamp(e).collect()) == [9.0, 10.0, 10.04]
