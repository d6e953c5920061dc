"""Centroid clustering: plain Lloyd over integer vectors.

Vectors of exactly ``dim`` components, none null, NaN or infinite, are kept and
turned into integers floor(scale * x). The first centroids are the ``k`` kept
vectors whose id hashes lowest; each round broadcasts the centroids (k x dim
integers, whatever the data's size), assigns every vector to the nearest by
squared differences in numpy, and moves each centroid to the exact floor of its
vectors' mean. A task sums its own vectors per centroid, so a round shuffles k
rows a task and brings k sums to the driver. All arithmetic is on integers, so
results don't depend on how rows are dealt, and a lost task is simply run again.

Ties go to the lower centroid number. Empty centroids stay where they are. With
fewer than ``k`` kept vectors there are as many centroids. Repeated rows count
each, those with one id may be several first centroids; a null id is assigned
like any other but comes last among first centroids. Vectors that are null, empty
or of another length give no row; an empty table gives an empty result. Only the
id and the vector are read, so other columns can't clash. A component whose
integer passes LARGEST can't keep a squared distance in 64 bits: the job fails
and names it, as does a sum of distances that passes 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.shipping import ship

#: Largest integer component: dim squared differences of twice this fit in 63 bits.
LARGEST = 1 << 27
_LOW = np.int64((1 << 31) - 1)


def integers(vectors: pd.Series, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that are kept, and their integers."""
    sized = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
    if not sized:
        return np.zeros(0, int), np.zeros((0, dim), np.int64)
    x = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in sized])
    finite = np.isfinite(x).all(axis=1)
    scaled = np.floor(x[finite] * scale)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"an integer component passes {LARGEST}")
    return np.array(sized)[finite], scaled.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroid and squared distance."""
    squares = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids])
    cluster = squares.argmin(axis=0)
    return cluster, squares[cluster, np.arange(len(x))]


def exact_sum(values: np.ndarray) -> int:
    """Of non-negative 64-bit integers, beyond 64 bits too."""
    return (int((values >> 31).sum()) << 31) + int((values & _LOW).sum())


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))


def first_centroids(rows: DataFrame, k: int, dim: int, scale: int, seed: str) -> np.ndarray:
    """The k kept vectors whose ``seed:id`` hashes lowest, equal ids by their vectors."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, x = integers(batch["vector"], dim, scale)
            if len(at):
                yield pd.DataFrame({"vec_id": batch["vec_id"].iloc[at].astype("Int64").array, "vector": list(x)})

    drawn = rows.mapInPandas(kept, "vec_id long, vector array<long>").withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    found = drawn.orderBy(F.col("draw").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([r.vector for r in found], np.int64).reshape(len(found), dim)


def _totals(rows: DataFrame, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, int, list[int]]]:
    """For each centroid with vectors their number, summed distance and summed components."""
    k, dim = centroids.shape
    shipped = rows.sparkSession.sparkContext.broadcast(centroids)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, inertia, sums = [0] * k, [0] * k, np.zeros((k, dim), object)
        for batch in batches:
            _, x = integers(batch["vector"], dim, scale)
            cluster, distance = nearest(x, shipped.value)
            for c in np.unique(cluster).tolist():
                mine = cluster == c
                n[c] += int(mine.sum())
                inertia[c] += exact_sum(distance[mine])
                sums[c] += x[mine].sum(axis=0).astype(object)
        found = [c for c in range(k) if n[c]]
        if found:
            yield pd.DataFrame({"cluster": found, "sums": [[Decimal(int(s)) for s in (n[c], inertia[c], *sums[c])] for c in found]})

    parts = rows.mapInPandas(summed, "cluster int, sums array<decimal(28,0)>").select("cluster", F.posexplode("sums").alias("i", "s"))
    whole = {(r["cluster"], r["i"]): int(r["s"]) for r in parts.groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect()}
    shipped.unpersist()
    return {c: (whole[c, 0], whole[c, 1], [whole[c, 2 + i] for i in range(dim)]) for c, i in whole if i == 0}


def fit(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Centroids (at most k x dim integers) after ``rounds`` rounds."""
    rows = _rows(vectors, id_col, vector_col)
    centroids = first_centroids(rows, k, dim, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, _, sums) in _totals(rows, centroids, scale).items():
            centroids[c] = [s // n for s in sums]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, *, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a kept vector: vec_id, cluster, distance (squared) and the integer vector."""
    shipped, dim = vectors.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, x = integers(batch["vector"], dim, scale)
            if len(at):
                cluster, distance = nearest(x, shipped.value)
                yield pd.DataFrame({"vec_id": batch["vec_id"].iloc[at].astype("Int64").array, "cluster": cluster, "distance": distance, "vector": list(x)})

    return _rows(vectors, id_col, vector_col).mapInPandas(run, "vec_id long, cluster int, distance long, vector array<long>")


def inertias(vectors: DataFrame, centroids: np.ndarray, *, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, int]:
    """Summed distances of each centroid's vectors; none for an empty one."""
    return {c: inertia for c, (_, inertia, _) in _totals(_rows(vectors, id_col, vector_col), centroids, scale).items()} if len(centroids) else {}


def digests(vectors: DataFrame, centroids: np.ndarray, **columns: str) -> DataFrame:
    """assign() with the sums of distances and a digest of the centroid: at most k values, held in the plan."""
    found = inertias(vectors, centroids, **columns)
    per = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster")) if len(centroids) else F.lit(None)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return assign(vectors, centroids, **columns).select(
        "vec_id",
        "cluster",
        "distance",
        per([found.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(found.values())).cast("long").alias("inertia"),
        per(names).cast("string").alias("centroid_sha256"),
    )


def _oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """The same in SQL, a table expression a round."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT)))"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('{seed}:', vec_id)), x) - 1 AS c, x FROM v ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, any_value(v.x) AS x, arg_min(c, struct_pack(d := {distance}, c := c)) AS c, min({distance}) AS d FROM v, c{i} AS c GROUP BY ALL)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT c, i, sum(CAST(x[i] AS HUGEINT)) AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) t(i) GROUP BY c, i))")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM s{i} GROUP BY c) n USING (c))")
    last = f"a{rounds}"
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM {last} a JOIN c{rounds} c ON c.c = a.c"


ORACLE = _oracle()
