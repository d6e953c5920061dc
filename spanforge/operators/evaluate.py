"""Evaluation of predicted intervals against gold ones, and of flags against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.intervals import iou


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def flag_scores(df: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of a flag; counts combine map-side."""
    n = lambda c: F.sum(c.cast("int").cast("long"))
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counts = df.groupBy(*by).agg(n(p & a).alias("tp"), n(p & ~a).alias("fp"), n(~p & a).alias("fn"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    nothing = (tp + fp + fn) == 0
    rate = lambda part: F.when(nothing, 1.0).otherwise(ratio(tp, tp + part))
    return counts.withColumn("precision", F.round(rate(fp), 4)).withColumn("recall", F.round(rate(fn), 4)).withColumn("f1", F.round(F.when(nothing, 1.0).otherwise(ratio(2.0 * tp, 2 * tp + fp + fn)), 4))


def matched(gold: DataFrame, predicted: DataFrame, key: str, *, start: str = "start_s", end: str = "end_s", seq: str = "seq", least: float = 0.5) -> DataFrame:
    """Greedy one-to-one matches: each gold interval in turn takes the free prediction of the best IoU, if ``least`` or more.

    A row for each key of either side: tp, fp, fn and the matches. A key's
    intervals are few (those of one medium), so the fold runs over arrays.
    """
    packed = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")))).alias(name))
    none = F.expr("CAST(array() AS array<struct<seq:bigint,s:double,e:double>>)")
    both = packed(gold, "gold").join(packed(predicted, "pred"), key, "full").withColumns({"gold": F.coalesce(F.col("gold").cast("array<struct<seq:bigint,s:double,e:double>>"), none), "pred": F.coalesce(F.col("pred").cast("array<struct<seq:bigint,s:double,e:double>>"), none)})
    kind = "array<struct<gold:bigint,pred:bigint,iou:double,start_error:double,end_error:double>>"

    def take(acc: Column, g: Column) -> Column:
        free = F.filter(F.col("pred"), lambda p: ~F.exists(acc, lambda m: m["pred"] == p["seq"]))
        scored = F.transform(free, lambda p: F.struct(iou(g["s"], g["e"], p["s"], p["e"]).alias("iou"), (-p["seq"]).alias("down"), p["s"].alias("s"), p["e"].alias("e")))
        best = F.array_max(scored)
        match = F.struct(g["seq"].alias("gold"), (-best["down"]).alias("pred"), best["iou"].cast("double").alias("iou"), F.abs(best["s"] - g["s"]).alias("start_error"), F.abs(best["e"] - g["e"]).alias("end_error"))
        return F.when(best["iou"] >= least, F.array_append(acc, match)).otherwise(acc)

    found = both.withColumn("matches", F.aggregate("gold", F.expr(f"CAST(array() AS {kind})"), take))
    mean = lambda f: F.when(F.size("matches") > 0, F.aggregate("matches", F.lit(0.0), lambda a, m: a + m[f]) / F.size("matches"))
    counts = found.select(
        key,
        F.size("matches").cast("long").alias("tp"),
        (F.size("pred") - F.size("matches")).cast("long").alias("fp"),
        (F.size("gold") - F.size("matches")).cast("long").alias("fn"),
        mean("iou").alias("mean_iou"),
        mean("start_error").alias("mean_start_error"),
        mean("end_error").alias("mean_end_error"),
        "matches",
    )
    return with_rates(counts)


def micro(per_key: DataFrame) -> DataFrame:
    """Totals over keys, with the mean of matches' IoUs (rounded to 4 places each)."""
    iou_sum = F.aggregate("matches", F.lit(0.0), lambda a, m: a + F.round(m["iou"], 4))
    totals = per_key.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum(iou_sum).alias("__iou"))
    return with_rates(totals.withColumn("mean_iou", F.round(ratio(F.col("__iou"), F.col("tp")), 4)).drop("__iou"))
