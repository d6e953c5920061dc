"""Sampling plans and changes between neighbouring samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHORT_S, DENSE_S, DENSE_STEP, STEP, MOST, DENSE_KEPT = 180.0, 10.0, 0.5, 4.0, 200, 21


def sampling_points(duration: Column, kind: Column) -> Column:
    """Timestamps at which to sample a medium, as an array in rising order.

    Short ones every half second, live ones every second; others densely at
    first, then every four seconds, with the end, thinned evenly to MOST points.
    """
    half = F.transform(F.sequence(F.lit(0), F.floor(duration * 2).cast("int")), lambda i: F.least(duration, i / 2.0))
    each = F.transform(F.sequence(F.lit(0), F.floor(duration).cast("int")), lambda i: F.least(duration, i.cast("double")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(int(DENSE_S / DENSE_STEP) - 1)), lambda i: i * DENSE_STEP)
    sparse = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((duration - DENSE_S) / STEP)).cast("int")), lambda i: DENSE_S + i * STEP), lambda t: t < duration)
    full = F.sort_array(F.array_distinct(F.transform(F.concat(dense, sparse, F.array(F.lit(0.0), duration)), lambda t: F.round(t, 3))))
    points = lambda p: F.when(F.size(p) > MOST, _once(F.struct(F.filter(p, lambda t: t <= DENSE_S).alias("head"), F.filter(p, lambda t: t > DENSE_S).alias("body")), _thinned)).otherwise(p)
    return F.when((kind == "short") | (duration <= SHORT_S), half).when(kind == "live", each).otherwise(_once(full, points))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row, not once for each element of what uses it."""
    return F.get(F.transform(F.array(value), use), 0)


def _thinned(p: Column) -> Column:
    room = MOST - F.size(p["head"])
    return F.concat(p["head"], F.transform(F.sequence(F.lit(0), room - 1), lambda i: F.get(p["body"], F.floor(i * F.size(p["body"]) / room).cast("int"))))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms of non-negative counts, 0 to 1."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    overlap = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - overlap / F.sqrt(total(a) * total(b))))


def scene_cuts(df: DataFrame, key: Sequence[str], *, time: str, hist: str, least: float, most: int, distance=bhattacharyya) -> DataFrame:
    """Samples that differ from the one before by ``least`` or more, the first ``most`` of a key."""
    w = W.partitionBy(*key).orderBy(time)
    cuts = df.withColumn("distance", distance(F.lag(hist).over(w), F.col(hist))).where(F.col("distance") >= least)
    return cuts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def sensed(df: DataFrame, key: Sequence[str], *, order: str, thumb: str, text: str, least: float) -> DataFrame:
    """Text of each tick: that of the last sensed tick, unless the picture has changed by ``least`` since."""
    from spanforge.operators.folds import near_duplicate_plan

    plan = near_duplicate_plan(df, key, order=order, thumb=thumb, least=least)
    source = df.select(*key, F.col(order).alias("source"), F.col(text).alias("sensed_text"))
    return plan.join(source, [*key, "source"]).select(*key, order, "source", "reused", "sensed_text")
