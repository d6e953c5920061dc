"""Machines: a key's rows in order, with the state that its next row needs and no more.

A machine is made anew for each key. ``row(r)`` takes a row (a dict) and gives
output rows (tuples of the output schema); ``end()``, where a machine has it, gives
what is left once a table's rows of the key are over. In a stream a stateful processor
loads a machine's state, feeds it a micro-batch's rows in order and writes the
state back; ``replayed`` runs the same machine over finished tables, a sorted
partition at a time, holding one key's state. So streams and tables give equal rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spanforge.shipping import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are Python objects at a time.
ROWS_AT_ONCE = 256


class Machine(Protocol):
    def row(self, r: dict) -> list[tuple]: ...


def prepared(spark: SparkSession) -> None:
    """Ship the package, and let state be kept by RocksDB where the session has chosen no provider (state variables need it); the setting stays."""
    ship(spark)
    if _PROVIDER not in spark.conf.getAll:
        spark.conf.set(_PROVIDER, _ROCKS)


def replayed(df: DataFrame, key: str, order: Sequence[str], make: Callable[[object], Machine], schema: str | StructType) -> DataFrame:
    """Outputs of ``make(key)`` over each key's rows by ``order``. Rows with a null key or a null first of the order go."""
    ship(df.sparkSession)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow, names = to_arrow_schema(kind), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine = None, None
        left = lambda: machine.end() if hasattr(machine, "end") else []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                out: list[tuple] = []
                part = batch.slice(at, ROWS_AT_ONCE)
                for values in zip(*[plain(c) for c in part.columns]):
                    r = dict(zip(names, values))
                    if machine is None or r[key] != now:
                        out += left()
                        now, machine = r[key], make(r[key])
                    out += machine.row(r)
                if out:
                    yield record(out)
        if out := left():
            yield record(out)

    def record(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    rows = df.where(F.col(key).isNotNull() & F.col(order[0]).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kind)


def plain(c: pa.Array) -> list:
    """As to_pylist, with lists' and structs' parts taken together: a scalar for each value is dear where most lists are empty."""
    if pa.types.is_list(c.type):
        flat, at, out = plain(c.flatten()), 0, []
        for n in c.value_lengths().to_pylist():
            out.append(None if n is None else flat[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(c.type) and not c.null_count:
        names = [f.name for f in c.type]
        return [dict(zip(names, v)) for v in zip(*map(plain, c.flatten()))]
    if not c.null_count and (pa.types.is_floating(c.type) or pa.types.is_integer(c.type)):
        return c.to_numpy(zero_copy_only=False).tolist()
    return c.to_pylist()


def by_time(rows: Iterator, keep: Callable[[dict], bool] = lambda r: r["now_s"] is not None) -> list[dict]:
    """A micro-batch's rows of one session, in order of their ticks."""
    return sorted((r for r in (r.asDict(recursive=True) for r in rows) if keep(r)), key=lambda r: r["now_s"])


def named(schema: str) -> tuple[str, ...]:
    """Column names of one of the package's schemas (", " stands between columns alone)."""
    return tuple(c.split(" ")[0] for c in schema.split(", "))
