"""Cosine joins of bags of words at a threshold, complete and without all pairs.

All terms have one order, rare ones first. Of a bag, only a prefix in this order
is indexed: what is left out has a share of its length below the threshold, so two
bags as similar as the threshold have their first common term in both prefixes
(the dot product over what is left out of either can't reach the threshold).
Frequent terms come last and are seldom indexed. Pairs that meet are compared once, in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from spanforge.shipping import ship

#: A term is frequent if so large a share of bags holds it: at most (terms a bag / FREQUENT) terms are, whatever the data's size.
FREQUENT = 0.01
#: Against rounding of the lengths: prefixes are cut a little later than they could be.
SLACK = 1e-9


def prefix_of(counts: dict[str, int], frequent: dict[str, int], least: float) -> list[str]:
    """Terms in order until those left have less than ``least`` of the bag's length."""
    order = sorted(counts, key=lambda t: (frequent.get(t, 0), t))
    rest, bound = sum(n * n for n in counts.values()), least * least * sum(n * n for n in counts.values()) * (1 - SLACK)
    for i, t in enumerate(order):
        if rest < bound:
            return order[:i]
        rest -= counts[t] ** 2
    return order


def _frequent(sides: list[DataFrame], tokens: str, share: float) -> dict[str, int]:
    bags = sides[0].select(tokens).unionAll(sides[1].select(tokens)).where(F.size(tokens) > 0)
    n = bags.count()
    counted = bags.select(F.explode(F.array_distinct(tokens)).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return {r.t: r.n for r in counted.where(F.col("n") >= max(2, share * n)).collect()}


def _prepared(df: DataFrame, id_col: str, tokens: str, frequent: dict[str, int], least: float) -> DataFrame:
    """id, sorted terms, their counts, the bag's squared length and prefix. Empty bags go."""
    shipped = df.sparkSession.sparkContext.broadcast(frequent)
    rows = df.where(F.size(tokens) > 0).select(F.col(id_col).alias("id"), F.col(tokens).alias("tokens"))
    schema = StructType([rows.schema["id"], *StructType.fromDDL("terms array<string>, counts array<long>, length double, prefix array<string>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for bag in batch.column(1).to_pylist():
                counts = Counter(t for t in bag if t is not None)
                terms = sorted(counts)
                for column, value in zip(out, (terms, [counts[t] for t in terms], float(sum(n * n for n in counts.values())), prefix_of(counts, shipped.value, least))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(arrow)[1:]))], schema=arrow)

    return rows.mapInArrow(run, schema)


@F.pandas_udf(LongType())
def _dot(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
    def one(x, nx, y, ny):
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        return int((np.asarray(nx)[i] * np.asarray(ny)[j]).sum())

    return pd.Series([one(*r) for r in zip(a, na, b, nb)], dtype="int64")


def similar(left: DataFrame, right: DataFrame, left_id: str, right_id: str, *, least: float, tokens: str = "tokens", share: float = FREQUENT) -> DataFrame:
    """Pairs of ids whose bags have a cosine of ``least`` (above 0) or more, with it: the same as all pairs, filtered. Null and empty bags meet nothing."""
    assert least > 0, "a cosine of zero is no similarity"
    ship(left.sparkSession)
    frequent = _frequent([left, right], tokens, share)
    a, b = _prepared(left, left_id, tokens, frequent, least), _prepared(right, right_id, tokens, frequent, least)
    met = a.select(F.col("id").alias("__a"), F.explode("prefix").alias("t")).join(b.select(F.col("id").alias("__b"), F.explode("prefix").alias("t")), "t").select("__a", "__b").distinct()
    x = a.select(F.col("id").alias("__a"), F.col("terms").alias("ta"), F.col("counts").alias("na"), F.col("length").alias("la"))
    y = b.select(F.col("id").alias("__b"), F.col("terms").alias("tb"), F.col("counts").alias("nb"), F.col("length").alias("lb"))
    both = met.join(x, "__a").join(y, "__b").withColumn("cosine", _dot("ta", "na", "tb", "nb") / (F.sqrt("la") * F.sqrt("lb")))
    return both.where(F.col("cosine") >= least).select(F.col("__a").alias(left_id), F.col("__b").alias(right_id), "cosine")
