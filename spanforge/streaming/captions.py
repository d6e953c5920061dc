"""What ticks can see of the captions before them, over tables and streams alike.

Captions and ticks of a session are read as one sequence by their times. Only
captions that a later tick may still see are held, so a session's state is
bounded by what is said in ``back`` seconds, however long it runs. In a stream a
tick sees the captions that came before it, in an earlier micro-batch or its own;
a caption that comes later is seen by later ticks. Captions without a start or an
end go, as do ticks without a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from spanforge.streaming.machines import prepared, replayed

LOOK_BACK_S = 16.0


class LookBack:
    """The machine of one session."""

    def __init__(self, session: str, back: float, held: list[dict] | None = None):
        self.session, self.back, self.held = session, back, held or []

    def row(self, r: dict) -> list[tuple]:
        if r["c"] is not None:
            self.held.append(r["c"])
            return []
        now = r["now_s"]
        self.held = [c for c in self.held if c["end_s"] > now - self.back]
        seen = [c for c in self.held if c["start_s"] < now]
        if r["is_end"]:
            self.held = []
        return [(self.session, now, *(c | {"end_s": min(c["end_s"], now)}).values()) for c in seen]


class _LookingBack(StatefulProcessor):
    def __init__(self, back: float, caption: StructType, names: list[str]):
        self.back, self.caption, self.names = back, caption, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("captions", self.caption)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fields = self.caption.names
        before = [dict(zip(fields, c)) for c in self.held.get()]
        machine, out = LookBack(key[0], self.back, before), []
        for r in sorted((r.asDict(recursive=True) for r in rows), key=lambda r: (r["now_s"], r["c"] is None)):
            out += machine.row(r)
        if machine.held:
            self.held.put([tuple(c[f] for f in fields) for c in machine.held])
        else:
            self.held.clear()
        for e in out:
            yield Row(**dict(zip(self.names, e)))

    def close(self) -> None:
        pass


def look_back(captions: DataFrame, ticks: DataFrame, *, back: float = LOOK_BACK_S) -> DataFrame:
    """Captions of the last ``back`` seconds of each tick, cut at it: session_id, now_s and the captions' columns. ``is_end`` of a tick, where there is one, lets go of its session's captions."""
    columns = [c for c in captions.columns if c != "session_id"]
    whole = F.struct(*[F.col(f"`{c}`").cast("double").alias(c) if c in ("start_s", "end_s") else F.col(f"`{c}`") for c in columns])
    said = captions.where("session_id IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL").select(F.col("session_id").cast("string").alias("session_id"), F.col("start_s").cast("double").alias("now_s"), F.lit(1).alias("part"), whole.alias("c"), F.lit(False).alias("is_end"))
    caption = said.schema["c"].dataType
    end = F.coalesce("is_end", F.lit(False)) if "is_end" in ticks.columns else F.lit(False)
    clock = ticks.where("session_id IS NOT NULL AND now_s IS NOT NULL").select(F.col("session_id").cast("string").alias("session_id"), F.col("now_s").cast("double").alias("now_s"), F.lit(2).alias("part"), F.lit(None).cast(caption).alias("c"), end.alias("is_end"))
    rows = said.unionAll(clock)
    schema = StructType([StructField("session_id", StringType()), StructField("now_s", DoubleType()), *caption.fields])
    if rows.isStreaming:
        prepared(rows.sparkSession)
        return rows.groupBy("session_id").transformWithState(_LookingBack(back, caption, schema.names), schema, "append", "none")
    return replayed(rows, "session_id", ["now_s", "part"], lambda s: LookBack(s, back), schema)
