"""Grouping of timestamped rows of a key: gaps and islands, unions and merges.

Each takes one shuffle on the key and window functions over it. Order is by the
columns named, which must tell rows of a key apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _numbered(df: DataFrame, starts: Column, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__starts", F.coalesce(starts.cast("int"), F.lit(1))).withColumn(name, F.sum("__starts").over(w)).drop("__starts")


def gap_groups(df: DataFrame, key: Sequence[str], start: str, end: str, order: Sequence[str], gap, *, tokens: str | None = None, name: str = "grp") -> DataFrame:
    """Number groups of a key: a row starts one if it begins more than ``gap`` after the previous row's end.

    With ``tokens`` (an array column) a row that shares one with the previous row joins it at any distance.
    """
    w = W.partitionBy(*key).orderBy(*order)
    apart = F.col(start) - F.lag(end).over(w) > gap
    if tokens:
        apart = apart & ~F.coalesce(F.arrays_overlap(F.col(tokens), F.lag(tokens).over(w)), F.lit(False))
    return _numbered(df, apart, key, order, name)


def two_level_groups(df: DataFrame, key: Sequence[str], start: str, end: str, order: Sequence[str], gap, wide_gap, related: Column, *, name: str = "grp") -> DataFrame:
    """As gap_groups, but two neighbours that are both ``related`` stay together up to ``wide_gap``."""
    w = W.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("__related", F.coalesce(related, F.lit(False)))
    distance = F.col(start) - F.lag(end).over(w)
    apart = (distance > gap) & ~(F.col("__related") & F.coalesce(F.lag("__related").over(w), F.lit(False)) & (distance <= wide_gap))
    return _numbered(rows, apart, key, order, name).drop("__related")


def interval_groups(df: DataFrame, key: Sequence[str], start: str, end: str, order: Sequence[str], gap, *, name: str = "grp") -> DataFrame:
    """Number unions of intervals: a row starts one if it begins more than ``gap`` after all before it have ended."""
    before = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return _numbered(df, F.col(start) - F.max(end).over(before) > gap, key, order, name)


def keyed_interval_groups(df: DataFrame, key: Sequence[str], same: Sequence[str], start: str, end: str, order: Sequence[str], gap, *, mergeable: Column | None = None, name: str = "grp") -> DataFrame:
    """Unions of neighbours that agree in ``same`` (and are mergeable): contiguous runs first, then gaps inside a run."""
    w = W.partitionBy(*key).orderBy(*order)
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if mergeable is not None:
        differs = differs | ~F.coalesce(mergeable, F.lit(False))
    runs = _numbered(df, differs | (F.row_number().over(w) == 1), key, order, "__run")
    grouped = interval_groups(runs, [*key, "__run"], start, end, order, gap, name="__part")
    number = F.dense_rank().over(W.partitionBy(*key).orderBy("__run", "__part"))
    return grouped.withColumn(name, number).drop("__run", "__part")


def persistent(df: DataFrame, key: Sequence[str], time: str, order: Sequence[str], *, forget, least) -> DataFrame:
    """Sightings of a signature as tracks: a pause of over ``forget`` starts a new one; proposed from ``least`` on."""
    tracks = gap_groups(df, key, time, time, order, forget, name="track")
    out = tracks.groupBy(*key, "track").agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n_seen"))
    return out.withColumn("proposed", F.col("last_seen") - F.col("first_seen") >= least)
