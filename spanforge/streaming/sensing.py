"""Sensing and lasting marks of live sessions, tick by tick, over tables and streams alike.

``sense`` reads a region's text again only if its picture has changed since it
was last read, and tells how far the whole picture has moved since the tick
before. ``lasting`` follows each mark of each region and proposes those that
stay. ``live_events`` chains both with the live tracks in one append query:
three stateful operators, each keyed by the session.

Rows with a null session or time go. Null regions, pictures, histograms and
texts count as missing: a missing picture is always read, a missing histogram gives no distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanforge import schemas
from spanforge.functions import text as T
from spanforge.plans.proposers import FORGET_S, HARD_CUT, LASTING_S, SOFT_CUT
from spanforge.streaming import live
from spanforge.streaming.machines import by_time, named, prepared, replayed

UNCHANGED = 8.0
_SENSED, _LASTING, _TICKS = named(schemas.SENSED), named(schemas.LASTING), named(schemas.LIVE_TICKS)
_NO_CANDS = f"CAST(array() AS array<{schemas.CANDIDATE}>)"


def moved(before: list[float] | None, now: list[float] | None) -> float | None:
    """Bhattacharyya distance of two histograms."""
    if before is None or now is None or len(before) != len(now):
        return None
    a, b = np.asarray(before, float), np.asarray(now, float)
    whole = a.sum() * b.sum()
    return float(np.sqrt(max(0.0, 1 - np.sqrt(a * b).sum() / np.sqrt(whole)))) if whole > 0 else None


class Sense:
    """The machine of one session: for each region the tick, picture and text last read, and the last histogram."""

    def __init__(self, session: str, unchanged: float = UNCHANGED, regions: dict | None = None, hist: list[float] | None = None):
        self.session, self.unchanged, self.regions, self.hist = session, unchanged, regions or {}, hist
        self.changed: set[str] = set()

    def row(self, r: dict) -> list[tuple]:
        rois = []
        for roi in r["rois"] or []:
            name, held = roi["roi_name"] or "", self.regions.get(roi["roi_name"] or "")
            thumb, mae = roi["thumb"], 0.0
            if held and held[1] is not None and thumb is not None and len(held[1]) == len(thumb):
                mae = float(np.abs(np.asarray(held[1], float) - np.asarray(thumb, float)).mean())
            sensed = not (held and held[1] is not None and thumb is not None and len(held[1]) == len(thumb) and mae < self.unchanged)
            if sensed:
                held = self.regions[name] = (r["now_s"], thumb, roi["text"])
                self.changed.add(name)
            rois.append({"roi_name": name, "raw_text": held[2] or "", "source_s": held[0], "sensed": sensed, "mae": mae})
        distance, self.hist = moved(self.hist, r["hist"]), r["hist"] if r["hist"] is not None else self.hist
        return [(self.session, r["now_s"], rois, distance, r["text"], bool(r["is_end"]))]


class _Sensing(StatefulProcessor):
    def __init__(self, unchanged: float):
        self.unchanged = unchanged

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.regions = handle.getMapState("regions", "roi string", "at double, thumb array<double>, text string")
        self.hist = handle.getValueState("hist", "hist array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {k[0]: tuple(v) for k, v in self.regions.iterator()} if self.regions.exists() else {}
        machine, out = Sense(key[0], self.unchanged, held, self.hist.get()[0] if self.hist.exists() else None), []
        ended = False
        for r in by_time(rows):
            if ended:
                machine = Sense(key[0], self.unchanged)
            out += machine.row(r)
            ended = bool(r["is_end"])
        if ended:
            self.regions.clear()
            self.hist.clear()
        else:
            for name in sorted(machine.changed):
                self.regions.updateValue((name,), machine.regions[name])
            if machine.hist is not None:
                self.hist.update((machine.hist,))
        for e in out:
            yield Row(**dict(zip(_SENSED, e)))

    def close(self) -> None:
        pass


class _Again:
    """A machine that starts anew after a session's end."""

    def __init__(self, make):
        self.make, self.machine = make, make()

    def row(self, r: dict) -> list[tuple]:
        out = self.machine.row(r)
        if r["is_end"]:
            self.machine = self.make()
        return out


def sense(frames: DataFrame, *, unchanged: float = UNCHANGED) -> DataFrame:
    """Each tick's texts by region, read where the picture differs by ``unchanged`` or more from that last read, and the move of its histogram (schemas.SENSED)."""
    if frames.isStreaming:
        prepared(frames.sparkSession)
        return frames.where("session_id IS NOT NULL").groupBy("session_id").transformWithState(_Sensing(unchanged), schemas.SENSED, "append", "none")
    return replayed(frames, "session_id", ["now_s"], lambda s: _Again(lambda: Sense(s, unchanged)), schemas.SENSED)


class Marks:
    """The machine of one session: first and last sighting, count and longest text of each (region, signature)."""

    def __init__(self, session: str, forget: float, least: float, marks: dict | None = None):
        self.session, self.forget, self.least, self.marks = session, forget, least, marks or {}
        self.touched: set[tuple] = set()

    def _told(self, event: str, now: float, key: tuple) -> tuple:
        first, last, n, text = self.marks[key]
        return self.session, now, event, *key, first, min(last, now), n, text

    def _gone(self, now: float, over) -> list[tuple]:
        out = [self._told("closed", now, k) for k in sorted(self.marks) if over(self.marks[k][1])]
        for row in out:
            del self.marks[row[3:5]]
            self.touched.add(row[3:5])
        return out

    def row(self, r: dict) -> list[tuple]:
        """Marks unseen for longer than ``forget`` go before the tick's sightings, those unseen for as long after them."""
        now = r["now_s"]
        out = self._gone(now, lambda last: now - last > self.forget)
        for s in r["seen"] or []:
            if s["signature"]:
                key = (s["roi_name"] or "", s["signature"])
                first, _, n, text = self.marks.get(key, (now, now, 0, ""))
                self.marks[key] = (first, now, n + 1, max(text, s["text"] or "", key=len))
                self.touched.add(key)
        if r["is_end"]:
            return out + self.proposed(now) + self._gone(now, lambda last: True)
        return out + self.proposed(now)

    def proposed(self, now: float) -> list[tuple]:
        return [self._told("proposed", now, k) for k in sorted(self.marks) if now - self.marks[k][1] < self.forget and now - self.marks[k][0] >= self.least]


def proposals(rows: list[tuple]) -> list[dict]:
    """Candidates of lasting marks."""
    return [
        {"start_s": first, "end_s": last, "source": f"ocr_persist_{roi}", "raw_triggers": ["persist_roi", "live_overlay"], "texts": [text or signature], "frame_timestamps": [first, last], "score_hint": 3}
        for _, _, event, roi, signature, first, last, _, text in rows
        if event == "proposed"
    ]


class _MarkTicks:
    """Marks, as ticks of candidates."""

    def __init__(self, marks: Marks):
        self.marks = marks

    def row(self, r: dict) -> list[tuple]:
        return [(r["session_id"], r["now_s"], [*(r["cands"] or []), *proposals(self.marks.row(r))], bool(r["is_end"]))]


class _Lasting(StatefulProcessor):
    def __init__(self, forget: float, least: float, as_ticks: bool, idle_ms: int | None):
        self.forget, self.least, self.as_ticks, self.idle_ms = forget, least, as_ticks, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getMapState("marks", "roi string, signature string", "first double, last double, n long, text string", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        machine, out, ended = Marks(key[0], self.forget, self.least, {tuple(k): tuple(v) for k, v in self.marks.iterator()} if self.marks.exists() else {}), [], False
        run = _MarkTicks(machine) if self.as_ticks else machine
        for r in by_time(rows):
            out += run.row(r)
            ended = bool(r["is_end"])
        for k in sorted(machine.touched):
            if k in machine.marks:
                self.marks.updateValue(k, machine.marks[k])
            elif self.marks.containsKey(k):
                self.marks.removeKey(k)
        if ended:
            self.marks.clear()
        for e in out:
            yield Row(**dict(zip(_TICKS if self.as_ticks else _LASTING, e)))

    def close(self) -> None:
        pass


def lasting(ticks: DataFrame, *, forget: float = FORGET_S, least: float = LASTING_S, as_ticks: bool = False, idle_s: float | None = None) -> DataFrame:
    """Marks of a session's ticks (schemas.SIGHTED): "proposed" at each tick while they stay, from ``least`` on, and "closed" once, with their sightings.

    ``as_ticks`` gives ticks with the proposals among their candidates instead.
    In a stream each mark is an entry of a map state and goes by itself;
    ``idle_s`` also bounds the life of entries of sessions that send nothing any more.
    """
    if ticks.isStreaming:
        prepared(ticks.sparkSession)
        processor = _Lasting(forget, least, as_ticks, None if idle_s is None else int(1000 * idle_s))
        return ticks.where("session_id IS NOT NULL").groupBy("session_id").transformWithState(processor, schemas.LIVE_TICKS if as_ticks else schemas.LASTING, "append", "none" if idle_s is None else "processingTime")
    make = lambda s: _MarkTicks(Marks(s, forget, least)) if as_ticks else Marks(s, forget, least)
    return replayed(ticks, "session_id", ["now_s"], make, schemas.LIVE_TICKS if as_ticks else schemas.LASTING)


def sighted(sensed: DataFrame, *, strong_brands: Sequence[str] = (), known: Mapping[str, str] | None = None) -> DataFrame:
    """Sensed ticks as schemas.SIGHTED: brands by region for ``lasting``, and candidates of this tick alone (spots, and a scored text at a change of scene)."""
    now = F.col("now_s")

    def shown(source: Column, text: Column, score: Column) -> Column:
        triggers = T.class_triggers(text, T.LIVE_CLASSES, loose=False)
        return F.struct(now.alias("start_s"), now.alias("end_s"), source.alias("source"), F.when(F.size(triggers) > 0, triggers).otherwise(F.array(F.lit("brand_word"))).alias("raw_triggers"), F.array(text).alias("texts"), F.array(now).alias("frame_timestamps"), score.cast("int").alias("score_hint"))

    brands = F.filter(F.col("rois"), lambda r: T.is_brand_candidate(r["raw_text"]) & ~T.is_chrome(r["raw_text"]))
    seen = F.transform(brands, lambda r: F.struct(r["roi_name"].alias("roi_name"), T.signature(r["raw_text"], known).alias("signature"), r["raw_text"].alias("text")))
    spots = F.filter(F.col("rois"), lambda r: (r["raw_text"] != "") & ~T.is_chrome(r["raw_text"]) & (T.live_score(r["raw_text"], strong_brands) >= 2))
    spots = F.transform(spots, lambda r: shown(F.concat(F.lit("ocr_break_"), r["roi_name"]), r["raw_text"], T.live_score(r["raw_text"], strong_brands)))
    text = T.text("text")
    score = T.live_score(text, strong_brands)
    broken = F.when((F.col("distance") >= SOFT_CUT) & (score >= 2), F.array(shown(F.lit("ocr_break"), text, score))).otherwise(F.expr(_NO_CANDS))
    cut = F.coalesce(F.col("distance") >= HARD_CUT, F.lit(False))
    return sensed.select("session_id", "now_s", seen.alias("seen"), F.concat(spots, broken).alias("cands"), "is_end", cut.alias("is_cut"))


def live_events(frames: DataFrame, *, strong_brands: Sequence[str] = (), known: Mapping[str, str] | None = None, unchanged: float = UNCHANGED, stalls: bool = False) -> DataFrame:
    """From frames (schemas.FRAMES) to events of live tracks, in one query: sense, follow lasting marks, track."""
    ticks = lasting(sighted(sense(frames, unchanged=unchanged), strong_brands=strong_brands, known=known).drop("is_cut"), as_ticks=True)
    return live.stream(ticks, stalls=stalls, known=known) if frames.isStreaming else live.replay(ticks, known=known)
