import hashlib
import random

import numpy as np
import pytest

from spanforge.llm import centroids as ce
from spanforge.llm import queries as q
from tests.compare import assert_same, oracle
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, vector int"


def brute(rows, k=8, rounds=10):
    """Lloyd with Python's own integers: (vec_id, cluster, distance, cluster's inertia, inertia, digest)."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in seeds[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            cents[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *near(v)) for i, v in kept]
    per = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    return sorted(((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def run(df):
    return sorted(map(tuple, ce.digests(df, ce.fit(df)).collect()), key=str)


def test_op11_equals_its_sql_and_brute_force(spark):
    got = q.op11_centroids(spark, f"{DATA}/sf0.001").toPandas()
    assert_same(got, oracle(ce.ORACLE, "sf0.001"))
    rows = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()
    assert sorted((tuple(r) for r in got.itertuples(index=False)), key=str) == brute([(r.vec_id, r.embedding) for r in rows])


def test_odd_vectors_ties_and_repeats(spark):
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) for _ in range(64)]
    rows = [(i, vector()) for i in range(30)]
    rows += [(3, rows[3][1])] * 4 + [(7, vector()), (None, vector()), (None, rows[0][1])]  # repeats, shared and missing ids
    rows += [(40, None), (41, []), (42, vector()[:63]), (43, [*vector()[:63], None]), (44, [*vector()[:63], float("nan")]), (45, [*vector()[:63], float("-inf")])]
    df = spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA).repartition(5)
    assert run(df) == brute(rows)
    same = [(i, [0.5] * 64) for i in range(12)]  # all ties: the lowest centroid takes all, the others stay
    got = run(spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in same], SCHEMA))
    assert got == brute(same) and {r[1:5] for r in got} == {(0, 0, 0, 0)}


def test_few_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert run(spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in few], SCHEMA)) == brute(few)
    empty = spark.createDataFrame([], SCHEMA)
    assert run(empty) == [] and ce.digests(empty, ce.fit(empty)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert run(spark.createDataFrame([(1, [1.0], 1, "x", "y", 2)], SCHEMA)) == []


def test_sums_are_exact_and_large_components_are_refused(spark):
    values = np.array([(1 << 62) + 5, (1 << 62) + 7, 3, 0])
    assert ce.exact_sum(values) == sum(map(int, values)) > 1 << 63
    with pytest.raises(Exception, match="passes"):
        run(spark.createDataFrame([(1, [1e30] * 64, 1, "x", "y", 2)], SCHEMA))
