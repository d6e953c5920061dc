"""Live tracks: open intervals that grow, close after silence and commit, without looking ahead.

Time is the ticks' own: a row is one tick of a session with the candidates
sensed so far. Candidates are clipped to the tick; evidence meets the first open
track of the same signature, or a near one if neither lasts, and all of it is
kept: sources, triggers, texts, frames, a signature where there was none. A
track closes after SILENCE_S without evidence, or at LONGEST_S, and is emitted
if it lasted LEAST_S and scored. Matching comes before closing, so evidence that
arrives with the closing tick still extends a track. Each event has the next number
of its session. A session's end closes its tracks and tells its statistics.

In a stream the open tracks are a list state of their own schema beside a small
clock, so a tick reads and writes tracks and never an ever-growing value. A
session that sends nothing for STALL_S gives one "stalled" event by a
processing-time timer, and after EXPIRE_S more its tracks are closed and its
state is dropped. State also goes when a session ends; one that sends again
under the same id starts anew. A tick that comes after a later one counts at the later one's time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanforge import schemas
from spanforge.functions import text as T
from spanforge.operators.intervals import bucketed
from spanforge.plans import judge as J
from spanforge.streaming.machines import prepared, replayed

SILENCE_S, LONGEST_S, LEAST_S, NEAR_S, SNAP_S = 6.0, 180.0, 2.0, 6.0, 0.75
STALL_S, EXPIRE_S = 12.0, 3_600.0
SIGNALS = ("ocr", "asr", "intent")
REGIONS = ("left", "bottom", "tr", "br")
TRACK = "track int, start_s double, end_s double, source string, roi string, signature string, triggers array<string>, texts array<string>, frame_timestamps array<double>, score int"
CLOCK = "tracks int, seq long, now_s double, ticks long, emitted long, stalled boolean"
_TRACK = tuple(c.split(" ")[0] for c in TRACK.split(", "))
_EVENT = tuple(c.split(" ")[0] for c in schemas.LIVE_EVENTS.split(", "))


def longest_of(texts: Column) -> Column:
    """The longest text of an array, the first of equals; "" without one."""
    return F.coalesce(F.get(F.array_sort(F.transform(texts, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), F.lit(0))["t"], F.lit(""))


def region_of(source: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(source, F.lit(r)), r) for r in REGIONS], F.lit(""))


def clip(ticks: DataFrame, *, known: Mapping[str, str] | None = None) -> DataFrame:
    """Candidates as the tick can see them, with their region and signature.

    Those that start at or after the tick go, ends and frames are cut at it, so
    nothing later can reach the state. The signature is that of the longest text, else its first 40 normalised characters.
    """
    none = F.expr("CAST(array() AS array<string>)")
    now = F.col("now_s")

    def seen(c: Column) -> Column:
        texts = F.array_compact(F.coalesce(c["texts"], none))
        said, source = longest_of(texts), F.coalesce(c["source"], F.lit(""))
        # The longest text is looked for, and its signature made, once.
        named = T.once(said, lambda t: T.once(T.signature(t, known), lambda lasting: F.when(lasting != "", lasting).otherwise(F.substring(T.normalise(t), 1, 40))))
        return F.struct(
            F.greatest(F.lit(0.0), c["start_s"]).alias("start_s"),
            F.least(c["end_s"], now).alias("end_s"),
            source.alias("source"),
            region_of(source).alias("roi"),
            named.alias("signature"),
            F.array_compact(F.coalesce(c["raw_triggers"], none)).alias("triggers"),
            texts.alias("texts"),
            F.filter(F.coalesce(c["frame_timestamps"], F.expr("CAST(array() AS array<double>)")), lambda t: t <= now).alias("frame_timestamps"),
            F.coalesce(c["score_hint"], F.lit(0)).alias("score"),
        )

    held = F.coalesce("cands", F.expr(f"CAST(array() AS array<{schemas.CANDIDATE}>)"))
    return ticks.withColumn("cands", F.transform(F.filter(held, lambda c: c["start_s"] < now), seen))


def same_signature(a: str, b: str) -> bool:
    return bool(a) and bool(b) and (a in b or b in a)


def meets(track: dict, cand: dict) -> bool:
    """Whether evidence belongs to an open track."""
    if same_signature(track["signature"], cand["signature"]):
        return True
    near = cand["start_s"] <= track["end_s"] + NEAR_S and cand["end_s"] >= track["start_s"] - NEAR_S
    return near and "persist" not in track["source"] and "persist" not in cand["source"]


def extend(track: dict, cand: dict) -> None:
    """Add evidence to a track."""
    track["start_s"], track["end_s"] = min(track["start_s"], cand["start_s"]), max(track["end_s"], cand["end_s"])
    track["signature"] = track["signature"] or cand["signature"]
    track["score"] = max(track["score"], cand["score"])
    track["texts"] = [*track["texts"], *cand["texts"]]
    track["frame_timestamps"] = [*track["frame_timestamps"], *cand["frame_timestamps"]]
    track["triggers"] = list(dict.fromkeys([*track["triggers"], *cand["triggers"]]))
    for signal in SIGNALS:
        if signal in cand["source"] and signal not in track["source"]:
            track["source"] += f"+{signal}"


class Tracks:
    """The machine of one session."""

    ended = False

    def __init__(self, session: str, tracks: list[dict] | None = None, clock: tuple | None = None, told: tuple[str, ...] = _EVENT):
        self.session, self.open, self.told = session, tracks or [], told
        self.number, self.seq, self.now, self.ticks, self.emitted, self.stalled = clock or (0, 0, 0.0, 0, 0, False)

    def clock(self) -> tuple:
        return self.number, self.seq, self.now, self.ticks, self.emitted, self.stalled

    def tell(self, event: str, status: str, **what) -> tuple:
        self.seq += 1
        blank = {"track": -1, "start_s": 0.0, "end_s": self.now, "source": "", "roi": "", "signature": "", "triggers": [], "texts": [], "frame_timestamps": [], "text": "", "score": 0}
        row = blank | what | {"session_id": self.session, "seq": self.seq, "now_s": self.now, "event": event, "status": status}
        return tuple(row[c] for c in self.told)

    def row(self, tick: dict) -> list[tuple]:
        if self.ended:
            self.__init__(self.session, told=self.told)
            self.ended = False
        self.now, self.ticks, self.stalled = max(self.now, tick["now_s"]), self.ticks + 1, False
        for c in tick["cands"] or []:
            for t in self.open:
                if meets(t, c):
                    extend(t, c)
                    break
            else:
                self.open.append({"track": self.number} | c)
                self.number += 1
        return self.close(bool(tick["is_end"]))

    def close(self, ended: bool) -> list[tuple]:
        """Emit what is over, tell what is open."""
        events, still = [], []
        for t in self.open:
            length, told = t["end_s"] - t["start_s"], t | {"text": max(t["texts"], key=len, default="")} if "text" in self.told else t
            if ended or self.now - t["end_s"] >= SILENCE_S or length >= LONGEST_S:
                if length >= LEAST_S and t["score"] >= 1:
                    self.emitted += 1
                    events.append(self.tell("emitted", "COMMITTED", **told))
            else:
                still.append(t)
                if t["score"] >= 1:
                    events.append(self.tell("open", "EXTENDING" if length >= LEAST_S else "PROVISIONAL", **told))
        self.open, self.ended = still, ended
        if ended:
            events.append(self.tell("session_end", "ENDED", text=json.dumps({"ticks": self.ticks, "tracks": self.number, "emitted": self.emitted, "events": self.seq + 1})))
        return events


class Chosen:
    """A session's machine whose events are chosen by kind, or of which only the last ones are told at the end."""

    def __init__(self, machine: Tracks, kinds: frozenset[str] | None, most: int | None):
        self.machine, self.kinds, self.most = machine, kinds, most
        self.at_kind, self.at_seq = machine.told.index("event"), machine.told.index("seq")
        self.kept, self.top, self.bound = [], 0, 2 * (most or 0)

    def row(self, tick: dict) -> list[tuple]:
        events = self.machine.row(tick)
        if self.most is not None:
            self.top = max(self.top, self.machine.seq)
            self.kept += events
            if len(self.kept) > self.bound:
                self.cut()
                self.bound = 2 * max(self.most, len(self.kept))
            return []
        return [e for e in events if e[self.at_kind] in self.kinds] if self.kinds is not None else events

    def cut(self) -> None:
        self.kept = [e for e in self.kept if e[self.at_seq] > self.top - self.most]

    def end(self) -> list[tuple]:
        self.cut()
        return [e for e in self.kept if self.kinds is None or e[self.at_kind] in self.kinds]


def replay(ticks: DataFrame, *, known: Mapping[str, str] | None = None, columns: Sequence[str] | None = None, kinds: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """Events of finished sessions, from a table; ticks of a session are read in order of their time.

    ``columns`` are those that are told (with the evidence left out, an open
    track's events don't repeat it at each tick), ``kinds`` the kinds of events, and
    ``most`` tells only the last ones of each session, as last_events does, without a second pass.
    """
    if columns is None and kinds is None and most is None:
        return replayed(clip(ticks, known=known), "session_id", ["now_s"], Tracks, schemas.LIVE_EVENTS)
    asked = _EVENT if columns is None else tuple(columns)
    told = tuple(c for c in _EVENT if c in asked or c in ("event", "seq"))
    schema, wanted = ", ".join(c for c in schemas.LIVE_EVENTS.split(", ") if c.split(" ")[0] in told), None if kinds is None else frozenset(kinds)
    make = lambda s: Chosen(Tracks(s, told=told), wanted, most)
    return replayed(clip(ticks, known=known), "session_id", ["now_s"], make, schema).select(*asked)


class _Sessions(StatefulProcessor):
    """Tracks of running sessions."""

    def __init__(self, stalls: bool, stall_s: float, expire_s: float):
        self.stalls, self.after = stalls, {False: int(1000 * stall_s), True: int(1000 * expire_s)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open, self.clock = handle.getListState("open", TRACK), handle.getValueState("clock", CLOCK)

    def _loaded(self, session: str) -> Tracks:
        if not self.clock.exists():
            return Tracks(session)
        return Tracks(session, [dict(zip(_TRACK, t)) for t in self.open.get()], tuple(self.clock.get()))

    def _stored(self, machine: Tracks, timers) -> None:
        if self.stalls:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if machine.ended:
            self.open.clear()
            self.clock.clear()
            return
        self.clock.update(machine.clock())
        if machine.open:
            self.open.put([tuple(t[c] for c in _TRACK) for t in machine.open])
        else:
            self.open.clear()
        if self.stalls:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.after[machine.stalled])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        machine, out = self._loaded(key[0]), []
        for r in sorted((r.asDict(recursive=True) for r in rows if r.now_s is not None), key=lambda r: r["now_s"]):
            out += machine.row(r)
        self._stored(machine, timerValues)
        for e in out:
            yield Row(**dict(zip(_EVENT, e)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        machine = self._loaded(key[0])
        if machine.stalled:
            out = machine.close(True)
        else:
            out = [machine.tell("stalled", "STALLED", start_s=machine.now)]
            machine.stalled = True
        self._stored(machine, timerValues)
        for e in out:
            yield Row(**dict(zip(_EVENT, e)))

    def close(self) -> None:
        pass


def stream(ticks: DataFrame, *, stalls: bool = True, stall_s: float = STALL_S, expire_s: float = EXPIRE_S, known: Mapping[str, str] | None = None) -> DataFrame:
    """Events of running sessions. Without ``stalls`` nothing is timed: a query that must come to rest needs that, and a session's state then stays until its end comes."""
    prepared(ticks.sparkSession)
    rows = clip(ticks, known=known).where("session_id IS NOT NULL")
    return rows.groupBy("session_id").transformWithState(_Sessions(stalls, stall_s, expire_s), schemas.LIVE_EVENTS, "append", "processingTime" if stalls else "none")


def committed(events: DataFrame, *, cuts: DataFrame | None = None, known: Mapping[str, str] | None = None, named: Mapping[str, str] | None = None) -> DataFrame:
    """Closed tracks as segments: judged by the rules once they close, with all their evidence; rejected ones go.

    Ends are snapped to ``cuts`` (session_id, cut_s, cut_seq) no later than the
    tick that closed them, clamped to that tick and rounded.
    """
    e = events.where("event = 'emitted'").select(F.col("session_id").alias("video_id"), "now_s", F.col("track").alias("cand_seq"), "start_s", "end_s", "source", F.col("triggers").alias("raw_triggers"), "texts", "frame_timestamps", F.col("score").alias("score_hint"), F.lit("live").alias("kind"), F.col("now_s").alias("duration_s"))
    s = J.judge(e, known=known, named=named).where("reject_reason IS NULL")
    if cuts is not None:
        at = bucketed(s.select("video_id", "cand_seq", "now_s", "start_s", "end_s"), F.col("start_s") - SNAP_S, F.col("end_s") + SNAP_S, 60.0)
        seen = cuts.select(F.col("session_id").alias("video_id"), "cut_s", "cut_seq", F.floor(F.col("cut_s") / 60.0).cast("long").alias("__bucket")).join(at, ["video_id", "__bucket"]).where("cut_s <= now_s")
        nearest = lambda end: F.min_by(F.when(F.abs(F.col("cut_s") - F.col(end)) <= SNAP_S, F.col("cut_s")), F.when(F.abs(F.col("cut_s") - F.col(end)) <= SNAP_S, F.struct(F.abs(F.col("cut_s") - F.col(end)), F.col("cut_seq"))))
        to = seen.groupBy("video_id", "cand_seq").agg(nearest("start_s").alias("__start"), nearest("end_s").alias("__end"))
        s = s.join(to, ["video_id", "cand_seq"], "left").withColumn("start_s", F.coalesce("__start", "start_s")).withColumn("end_s", F.coalesce("__end", "end_s"))
    inside = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.col("now_s"))
    start = inside(F.col("start_s"))
    end = F.when(inside(F.col("end_s")) <= start, inside(start + 0.5)).otherwise(inside(F.col("end_s")))
    return s.select(F.col("video_id").alias("session_id"), "now_s", F.col("cand_seq").alias("track"), F.round(start, 2).alias("start_s"), F.round(end, 2).alias("end_s"), "ad_type", "confidence", "brand", "description", "presentation", "source", F.slice("frame_timestamps", 1, 12).alias("frame_timestamps"), "transcript_span", "ocr_text", "signals_used")


def since(events: DataFrame, session: str, after: int, most: int = 2000) -> DataFrame:
    """The replay cursor of a session: of its last ``most`` events those after a number, in order."""
    return last_events(events.where(F.col("session_id") == session), most).where(F.col("seq") > after).orderBy("seq")


def last_events(events: DataFrame, most: int = 2000) -> DataFrame:
    """The last ``most`` events of each session. Numbers have no gaps, so the greatest tells where they begin: no session is sorted."""
    top = events.groupBy("session_id").agg(F.max("seq").alias("__top"))
    return events.join(top, "session_id").where(F.col("seq") > F.col("__top") - most).drop("__top")
