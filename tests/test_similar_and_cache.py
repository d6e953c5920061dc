import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge import schemas
from spanforge.operators import similar
from spanforge.sources import cache


def cosine(a, b):
    a, b = Counter(a), Counter(b)
    return sum(a[t] * b[t] for t in a) / (sum(n * n for n in a.values()) ** 0.5 * sum(n * n for n in b.values()) ** 0.5)


def bags(rng, n):
    """Two words in every bag, a few in many, most in few, and near copies."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            base = list(rng.choice(out))
            base[rng.randrange(len(base))] = f"w{rng.randrange(60)}"
            out.append(base)
        else:
            out.append(["the", "of", *(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 12)))] * rng.randrange(1, 3))
    return out


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_pairs_are_those_of_all_pairs(spark, least):
    rng = random.Random(7)
    left, right = bags(rng, 60), bags(rng, 50)
    right[:10] = left[:10]
    frame = lambda rows, name: spark.createDataFrame([*enumerate(rows), (900, []), (901, None)], f"{name} long, tokens array<string>")
    got = {(r.a, r.b): r.cosine for r in similar.similar(frame(left, "a"), frame(right, "b"), "a", "b", least=least).collect()}
    want = {(i, j): c for i, x in enumerate(left) for j, y in enumerate(right) if (c := cosine(x, y)) >= least}
    close = lambda pairs: {p for p, c in pairs.items() if abs(c - least) > 1e-12}
    assert close(got) == close(want) and all(abs(got[p] - want[p]) < 1e-12 for p in close(got))
    assert len(got) >= 10 * (least < 1)


def test_what_a_prefix_leaves_out_cannot_reach_the_threshold():
    rng = random.Random(1)
    for _ in range(300):
        counts = Counter(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 40)))
        frequent = {f"w{i}": 100 - i for i in range(1, 8)}
        least = rng.choice([0.1, 0.3, 0.6, 0.9])
        prefix = similar.prefix_of(counts, frequent, least)
        rest = sum(n * n for t, n in counts.items() if t not in prefix)
        assert rest < least**2 * sum(n * n for n in counts.values()) or len(prefix) == len(counts)
        assert similar.prefix_of(counts, frequent, 1e-9) == sorted(counts, key=lambda t: (frequent.get(t, 0), t))


def test_a_term_in_every_bag_is_seldom_indexed(spark):
    """Rows that the join of prefixes reads don't grow with a frequent term."""
    rng = random.Random(3)
    rows = [["the"] * 3 + [f"x{rng.randrange(10_000)}" for _ in range(6)] for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "a long, tokens array<string>")
    frequent = similar._frequent([df, df.withColumnRenamed("a", "b")], "tokens", 0.01)
    assert set(frequent) >= {"the"} and len(frequent) < 50
    held = similar._prepared(df, "a", "tokens", frequent, 0.8).select(F.explode("prefix").alias("t")).groupBy("t").count()
    assert held.where("t = 'the'").count() == 0 and held.agg(F.max("count")).first()[0] < 40


CANDIDATE = f"{schemas.CANDIDATES}, kind string"


def candidates(spark, rows):
    return spark.createDataFrame([(v, i, float(s), float(s) + 9, source, [], [f"text {v} {i}"], [], 3, "vod") for v, i, s, source in rows], CANDIDATE)


@pytest.fixture
def store(spark, tmp_path):
    name = f"judgments_{uuid.uuid4().hex[:8]}"
    cache.create(spark, name, buckets=4, path=f"file://{tmp_path}/cache")
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_only_a_whole_hit_spares_the_model(spark, store):
    c = candidates(spark, [("whole", 0, 5, "asr"), ("whole", 1, 50, "ocr"), ("part", 0, 5, "asr"), ("part", 1, 50, "ocr"), ("none", 0, 40, "asr"), ("rules", 0, 3, "ocr")])
    keyed = c.withColumn("cache_key", cache.candidate_key())
    known = keyed.where("video_id IN ('whole', 'rules') OR (video_id = 'part' AND cand_seq = 0)").select("cache_key", F.concat(F.lit('{"v": "'), "video_id", F.lit('"}')).alias("judgment"))
    cache.store(known, store, stored_us=1)
    got = {(r.video_id, r.cand_seq): (r.outcome, r.judgment) for r in cache.planned(c, store).collect()}
    assert got == {
        ("whole", 0): ("cache", '{"v": "whole"}'),
        ("whole", 1): ("cache", '{"v": "whole"}'),
        ("part", 0): ("ask", None),
        ("part", 1): ("ask", None),
        ("none", 0): ("ask", None),
        ("rules", 0): ("skipped", None),
    }
    assert cache.planned(candidates(spark, []), store).count() == 0


def test_the_latest_judgment_counts_before_and_after_compaction(spark, store):
    put = lambda at, *rows: cache.store(spark.createDataFrame(rows, "cache_key string, judgment string"), store, stored_us=at)
    put(1, ("a", "old"), ("b", "b1"), (None, "x"), ("c", None))
    put(2, ("a", "new"), ("a", "newer"))
    put(2, ("a", "new"), ("a", "newer"))  # a retry
    put(1, ("b", "b0"))
    want = [("a", "newer"), ("b", "b1")]
    assert sorted(map(tuple, cache.latest(spark, store).collect())) == want
    assert spark.table(store).count() == 5
    cache.compact(spark, store)
    assert sorted(map(tuple, cache.latest(spark, store).collect())) == want and spark.table(store).count() == 2
    put(3, ("b", "b2"))
    assert sorted(map(tuple, cache.latest(spark, store).collect())) == [("a", "newer"), ("b", "b2")]


def test_the_stores_side_is_not_shuffled(spark, store):
    cache.store(spark.createDataFrame([(str(i), "j") for i in range(50)], "cache_key string, judgment string"), store, stored_us=1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        c = candidates(spark, [("v", 0, 5, "asr")]).withColumn("cache_key", cache.candidate_key())
        plan = c.join(cache.latest(spark, store), "cache_key", "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SelectedBucketsCount" in plan
        assert "Exchange" not in cache.latest(spark, store)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
