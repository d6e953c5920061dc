"""Joins of intervals and instants of one key.

Every join carries the key as an equality, so that it shuffles on it. Where a
key's rows may be many, time is cut into buckets that are part of the equality,
and the condition on time is checked inside a bucket. What asks for one value
alone (does any overlap, which is the first) is swept in order and makes no pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over hull; 0 for an empty hull."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull <= 0, F.lit(0.0)).otherwise(F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0)) / hull)


def bucketed(df: DataFrame, start: Column, end: Column, width, name: str = "__bucket") -> DataFrame:
    """A row for each bucket of ``width`` that [start, end] touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))))


def swept_max(left: DataFrame, right: DataFrame, key: Sequence[str], at: Column, pos: Column, value: Column, width, *, inclusive: bool, name: str) -> DataFrame:
    """Left's rows with the largest ``value`` of right's rows of the key that lie before ``at`` (or at it, if ``inclusive``), else null.

    No pairs are made and no row is repeated: both sides are dealt by key and
    bucket of ``width``, a running maximum goes over each bucket, and the maxima
    of earlier buckets, one row a bucket, are carried in. Null keys meet nothing,
    nor do rows of right without a position or a value.
    """
    mine = left.select(*key, F.struct("*").alias("__row"), at.alias("__at"), F.lit(None).cast(right.select(value).schema[0].dataType).alias("__value"))
    theirs = right.select(*key, F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), pos.alias("__at"), value.alias("__value")).where("__at IS NOT NULL AND __value IS NOT NULL")
    both = mine.unionByName(theirs).withColumn("__bucket", F.floor(F.col("__at") / width).cast("long"))
    first = F.col("__row").isNotNull() if inclusive else F.col("__row").isNull()
    w = W.partitionBy(*key, "__bucket").orderBy("__at", first).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*key).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = both.groupBy(*key, "__bucket").agg(F.max("__value").alias("__value")).select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__bucket").alias("__at_bucket"), F.max("__value").over(before).alias("__carry"))
    same = reduce(and_, [F.col(k) == F.col(f"__{k}") for k in key], F.col("__bucket") == F.col("__at_bucket"))
    swept = both.withColumn("__best", F.max("__value").over(w)).where("__row IS NOT NULL").join(carry, same, "left")
    known = reduce(and_, [F.col(k).isNotNull() for k in key], F.col("__at").isNotNull())
    return swept.select("__row.*", F.when(known, F.greatest("__best", "__carry")).alias(name))


def overlap_flag(left: DataFrame, right: DataFrame, key: Sequence[str], width, *, start: str = "start", end: str = "end", pad=0, inclusive: bool = False, name: str = "overlaps") -> DataFrame:
    """Left's rows and whether they overlap a row of right: of right's intervals that start before a row's end, the last end lies behind its start."""
    swept = swept_max(left, right, key, F.col(end) + pad, F.col(start), F.col(end), width, inclusive=inclusive, name="__last")
    early = F.col(start) - pad
    return swept.withColumn(name, F.coalesce(early <= F.col("__last") if inclusive else early < F.col("__last"), F.lit(False))).drop("__last")


def overlap_semi(left: DataFrame, right: DataFrame, key: Sequence[str], width, *, start: str = "start", end: str = "end", anti: bool = False, pad=0, inclusive: bool = False) -> DataFrame:
    """Rows of left that overlap a row of right (or, with anti, none), widened by ``pad``; touching counts only if ``inclusive``.

    """
    flagged = overlap_flag(left, right, key, width, start=start, end=end, pad=pad, inclusive=inclusive, name="__hit")
    return flagged.where(~F.col("__hit") if anti else F.col("__hit")).drop("__hit")


def _neighbours(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, tolerance, seq: str | None) -> DataFrame:
    """Left's rows as ``__row`` and their time as ``__at``, with right's last instant at or before it (``__prev``) and its first
    at or after it (``__next``), as structs (instant or its negative, -seq); all those within ``tolerance`` are found.

    No pairs are made: an instant is dealt to its own bucket, each bucket's first and last ones to the buckets beside it
    too, and both sides are swept in one order. Buckets are twice as wide as the tolerance, so that rounding parts no
    neighbours. Right's rows with a null key or instant meet nothing.
    """
    none, width = F.lit(None), 2 * tolerance or 1
    theirs = right.select(*key, F.col(time).alias("__at"), (-F.col(seq) if seq else F.lit(0)).alias("__down"))
    theirs = theirs.where(reduce(and_, [F.col(k).isNotNull() for k in (*key, "__at")])).withColumn("__bucket", F.floor(F.col("__at") / width).cast("long"))
    before, after = F.struct(F.col("__at").alias("t"), F.col("__down").alias("d")), F.struct((-F.col("__at")).alias("t"), F.col("__down").alias("d"))
    edges = theirs.groupBy(*key, "__bucket").agg(F.max(before).alias("last"), F.max(after).alias("first"))
    beside = F.array(F.struct((F.col("__bucket") + 1).alias("b"), F.col("last.t").alias("t"), F.col("last.d").alias("d")), F.struct((F.col("__bucket") - 1).alias("b"), (-F.col("first.t")).alias("t"), F.col("first.d").alias("d")))
    edges = edges.select(*key, F.inline(beside).alias("__bucket", "__at", "__down"))
    mine = left.select(*key, F.struct("*").alias("__row"), F.col(time).alias("__at"), F.floor(F.col(time) / width).cast("long").alias("__bucket"))
    shown = lambda df: df.select(*key, none.cast(mine.schema["__row"].dataType).alias("__row"), "__at", "__bucket", "__down")
    both = mine.withColumn("__down", none.cast(theirs.schema["__down"].dataType)).unionByName(shown(theirs)).unionByName(shown(edges))
    w = W.partitionBy(*key, "__bucket")
    up, down = w.orderBy("__at"), w.orderBy(F.desc("__at"))  # a frame that runs to the end would be worked out anew at each row
    told = lambda v: F.when(F.col("__row").isNull(), v)
    swept = both.withColumn("__prev", F.max(told(before)).over(up.rangeBetween(W.unboundedPreceding, W.currentRow))).withColumn("__next", F.max(told(after)).over(down.rangeBetween(W.unboundedPreceding, W.currentRow)))
    return swept.where("__row IS NOT NULL")


def near_anti(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, tolerance) -> DataFrame:
    """Instants of left without an instant of right within ``tolerance`` (inclusive)."""
    near = (F.col("__at") - F.col("__prev.t") <= tolerance) | (-F.col("__next.t") - F.col("__at") <= tolerance)
    return _neighbours(left, right, key, time, tolerance, None).where(~F.coalesce(near, F.lit(False))).select("__row.*")


def snap_nearest(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, tolerance, *, seq: str, name: str = "snapped") -> DataFrame:
    """The nearest instant of right within ``tolerance``, the first by ``seq`` (a number) among equals; else the instant itself."""
    swept = _neighbours(left, right, key, time, tolerance, seq)
    at, prev, after = F.col("__at"), F.col("__prev.t"), -F.col("__next.t")
    back, ahead = F.when(at - prev <= tolerance, at - prev), F.when(after - at <= tolerance, after - at)
    earlier = ahead.isNull() | (back < ahead) | ((back == ahead) & (F.col("__prev.d") >= F.col("__next.d")))
    return swept.select("__row.*", F.when(back.isNotNull() & earlier, prev).when(ahead.isNotNull(), after).otherwise(at).alias(name))


def context_rows(spans: DataFrame, rows: DataFrame, key: Sequence[str], *, pad, before: int, inside: int, after: int, width, time: str = "start", end: str = "end", order: str = "seq", span_id: Sequence[str] = ()) -> DataFrame:
    """For each span its neighbouring rows by part: the last ones before it, the first inside and the first after, within ``pad``.

    A row that touches the span counts as inside; one before it has to start within ``pad``. ``width`` is the buckets'; a
    pair counts in the first bucket that both touch.
    """
    s = bucketed(spans.select(*key, *span_id, F.col("span_start"), F.col("span_end")), F.col("span_start") - pad, F.col("span_end") + pad, width)
    r = bucketed(rows, F.col(time), F.col(end), width)
    joined = r.join(s, [*key, "__bucket"]).where((F.col(end) >= F.col("span_start") - pad) & (F.col(time) <= F.col("span_end") + pad))
    joined = joined.where(F.col("__bucket") == F.floor(F.greatest(F.col(time), F.col("span_start") - pad) / width).cast("long")).drop("__bucket")
    part = F.when(F.col(end) < F.col("span_start"), "before").when(F.col(time) <= F.col("span_end"), "span").otherwise("after")
    parted = joined.withColumn("part", part).where((F.col("part") != "before") | (F.col(time) >= F.col("span_start") - pad))
    w = W.partitionBy(*key, *span_id, "part")
    rank = F.when(F.col("part") == "before", F.row_number().over(w.orderBy(F.desc(order)))).otherwise(F.row_number().over(w.orderBy(F.asc(order))))
    most = F.when(F.col("part") == "before", before).when(F.col("part") == "span", inside).otherwise(after)
    return parted.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def _instants_in(spans: DataFrame, instants: DataFrame, key: Sequence[str], time: str, start: Column, end: Column, width) -> DataFrame:
    """Instants with the spans [start, end] that hold them; an instant is in one bucket."""
    s = bucketed(spans, start, end, width)
    joined = instants.withColumn("__bucket", F.floor(F.col(time) / width).cast("long")).join(s, [*key, "__bucket"])
    return joined.where(F.col(time).between(start, end)).drop("__bucket")


def first_in_span(spans: DataFrame, hits: DataFrame, key: Sequence[str], time: str, pad, most: int, *, width, span_id: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``most`` hits inside each span, widened by ``pad`` (inclusive), with their rank."""
    s = spans.select(*key, *span_id, "span_start", "span_end")
    joined = _instants_in(s, hits, key, time, F.col("span_start") - pad, F.col("span_end") + pad, width)
    return joined.withColumn("rank", F.row_number().over(W.partitionBy(*key, *span_id).orderBy(*order))).where(F.col("rank") <= most)


def refined_start(spans: DataFrame, rows: DataFrame, key: Sequence[str], *, time: str, width, back=1.0) -> DataFrame:
    """Spans that start at their first hot row, looking ``back`` before their start."""
    at, t = -(F.col("span_start") - back), -F.col(time)
    swept = swept_max(spans, rows, key, at, t, t, width, inclusive=True, name="__next")
    return swept.withColumn("span_start", F.when(-F.col("__next") <= F.col("span_end"), -F.col("__next")).otherwise(F.col("span_start"))).drop("__next")
