"""Folds: rows that depend on what was kept before them.

Rows are dealt by key and sorted in their partitions; a task then reads each key
once, in Arrow batches, and holds the last kept row alone. Where keys are few, a
fold can be split: keys are cut into ranges that tasks fold apart, as if the first
row of each were kept; then ranges whose true last kept row is another one
are folded again from it, until none is. Mostly a range agrees with its first fold
after some rows, so that what it hands on stays as it was and one repair is enough.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spanforge.shared import checkpoint
from spanforge.shipping import ship

#: Rows that are compared with the last kept one at a time.
LOOK_AHEAD = 64
#: A fold of consecutive rows of one key (columns after the key): what is kept before them (None at a key's start)
#: and the rows give the rows put out and what is kept after them. At a key's end rows are None.
Fold = Callable[[Any, "pd.DataFrame | None"], tuple[list[tuple], Any]]


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _blocks(batches: Iterator[pd.DataFrame], n_key: int) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of one key within a batch, with the key."""
    for batch in batches:
        if len(batch):
            keys = batch.iloc[:, :n_key]
            edges = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
            for a, b in zip(edges, [*edges[1:], len(batch)]):
                yield tuple(keys.iloc[a]), batch.iloc[a:b, n_key:]


def _put(key: tuple, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *r) for r in rows], columns=names)


def _folded(df: DataFrame, n_key: int, order: str, fold: Fold, schema: StructType) -> DataFrame:
    """Rows put out by ``fold`` over each key's rows in order, a task a key."""
    ship(df.sparkSession)
    key, names = df.columns[:n_key], [f.name for f in schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, None
        for batch in batches:
            # Rows of all of a batch's keys are put out together: a frame for each key costs more than its fold where keys are many and short.
            put = []
            for block_key, block in _blocks([batch], n_key):
                if block_key != now:
                    if now is not None:
                        put += [(*now, *r) for r in fold(kept, None)[0]]
                    now, kept = block_key, None
                out, kept = fold(kept, block)
                put += [(*block_key, *r) for r in out]
            yield pd.DataFrame(put, columns=names)
        if now is not None:
            yield _put(now, fold(kept, None)[0], names)

    return df.repartition(*key).sortWithinPartitions(*key, order).mapInPandas(run, schema)


def _split(df: DataFrame, n_key: int, order: str, fold: Fold, schema: StructType, ranges: int) -> DataFrame:
    """As _folded, with keys cut into ranges; ``fold`` puts out a row for each row, and nothing at a key's end.

    What ranges hand on is one kept row each, so the driver holds as many as there
    are ranges. Rows are written once, so that ranges stay what they are when tasks are run again.
    """
    ship(df.sparkSession)
    spark, key, names = df.sparkSession, df.columns[:n_key], [f.name for f in schema]
    sorted_ = df.repartitionByRange(ranges, *key, order).sortWithinPartitions(*key, order)
    rows = checkpoint(sorted_.withColumn("__range", F.spark_partition_id()))

    def folded(sent: dict[int, tuple[tuple, Any]], put: bool):
        """A range's rows, from what the one before it hands on where that is of the same key; or what it hands on itself."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, kept, first, part = None, None, None, None
            for block_key, block in _blocks(batches, n_key):
                if part is None:
                    part, first = int(block["__range"].iloc[0]), block_key
                    before = sent.get(part)
                    now, kept = block_key, before[1] if before and before[0] == block_key else None
                if block_key != now:
                    now, kept = block_key, None
                out, kept = fold(kept, block.drop(columns="__range"))
                if put:
                    yield _put(now, out, names)
            if part is not None and not put:
                yield pd.DataFrame({"part": [part], "state": [pickle.dumps((first, now, kept))]})

        return run

    def hand_on(sent: dict, parts: list[int] | None) -> dict[int, tuple]:
        held = rows if parts is None else rows.where(F.col("__range").isin(parts))
        return {r["part"]: pickle.loads(r["state"]) for r in held.mapInPandas(folded(sent, False), "part int, state binary").collect()}

    sent: dict[int, tuple[tuple, Any]] = {}
    last = hand_on(sent, None)
    while True:
        parts = sorted(last)
        meant = {b: (last[a][1], last[a][2]) for a, b in zip(parts, parts[1:]) if last[a][1] == last[b][0]}
        changed = [p for p, state in meant.items() if p not in sent or not _same(sent[p][1], state[1])]
        if not changed:
            break
        sent = sent | {p: meant[p] for p in changed}
        last |= hand_on(sent, changed)
    return rows.mapInPandas(folded(sent, True), schema)


def _same(a: Any, b: Any) -> bool:
    """Whether two kept rows are the same one, by their place in the order."""
    return a[0] == b[0]


def near_duplicate_plan(df: DataFrame, key: Sequence[str], *, order: str, thumb: str, least: float, ranges: int | None = None) -> DataFrame:
    """For each row the last kept row's order if it differs by less than ``least`` from it, else its own.

    A kept row is the one later rows are held against, so slow drift is kept too.
    Rows with a null key, order or picture go. With ``ranges`` keys are split over so many tasks.
    """
    rows = df.where(F.concat(*[F.col(k).cast("string") for k in key], F.col(order).cast("string")).isNotNull() & F.col(thumb).isNotNull()).select(*key, F.col(order).alias(order), F.col(thumb).cast("array<double>").alias("__thumb"))
    plan = StructType([*(rows.schema[k] for k in key), rows.schema[order]]).add("source", rows.schema[order].dataType)

    def fold(kept, block):
        """Rows ahead are compared with the kept one together, up to the first that differs."""
        if block is None:
            return [], None
        at, thumbs = block.iloc[:, 0].tolist(), np.stack([np.asarray(v, float) for v in block.iloc[:, 1]])
        out, i = [], 0
        while i < len(at):
            if kept is None:
                kept = (at[i], thumbs[i])
            ahead = np.abs(thumbs[i : i + LOOK_AHEAD] - kept[1]).mean(axis=1)
            new = np.flatnonzero(~(ahead < least))
            n = int(new[0]) if len(new) else len(ahead)
            out += [(a, kept[0]) for a in at[i : i + n]]
            i += n
            if len(new):
                kept = (at[i], thumbs[i])
                out.append((at[i], at[i]))
                i += 1
        return out, kept

    found = _folded(rows, len(key), order, fold, plan) if ranges is None else _split(rows, len(key), order, fold, plan, ranges)
    return found.withColumn("reused", F.col(order) != F.col("source"))


def rolling_dedupe(df: DataFrame, key: Sequence[str], *, order: str, start: str, end: str, text: str, within: float) -> DataFrame:
    """Captions that roll: one contained in the last kept is dropped; one that contains it, starting less than ``within`` after it, replaces its text and end."""
    rows = df.where(F.trim(F.col(text)) != "").select(*key, F.col(order).alias(order), F.col(start).cast("double").alias(start), F.col(end).cast("double").alias(end), F.trim(F.col(text)).alias(text))

    ship(df.sparkSession)
    schema, n_key = to_arrow_schema(rows.schema), len(key)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows one by one, as lists of plain values: keys are many, and most have a few rows."""
        now, kept = None, None
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                k, (o, s, e, t) = row[:n_key], row[n_key:]
                if kept is None or k != now:
                    if kept is not None:
                        out.append((*now, *kept))
                    now, kept = k, (o, s, e, t)
                elif t in kept[3]:
                    continue
                elif kept[3] in t and s - kept[1] < within:
                    kept = (kept[0], kept[1], e, t)
                else:
                    out.append((*now, *kept))
                    kept = (o, s, e, t)
            if out:
                yield _record(out, schema)
        if kept is not None:
            yield _record([(*now, *kept)], schema)

    return rows.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(folded, rows.schema)


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def first_texts(df: DataFrame, key: Sequence[str], *, order: str, text: str, head: int = 80, most: int = 10) -> DataFrame:
    """The first ``most`` texts of a key that differ in their first ``head`` characters, in order."""
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("rows"))
    texts = F.transform("rows", lambda r: r["t"])
    fresh = lambda acc, t: F.when((F.size(acc) < most) & ~F.exists(acc, lambda k: F.substring(k, 1, head) == F.substring(t, 1, head)), F.array_append(acc, t)).otherwise(acc)
    return rows.select(*key, F.aggregate(texts, F.array().cast("array<string>"), fresh).alias("texts"))
