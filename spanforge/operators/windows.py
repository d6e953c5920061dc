"""Hopping windows of text, bag-of-words similarity and greedy top-k with suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hopping_text(df: DataFrame, key: Sequence[str], *, start: str, end: str, text: str, order: str, width: float, hop: float, until: str | None = None, short: float = 1.0) -> DataFrame:
    """Text of each window [t, t + width) for t = 0, hop, ... while t < end of the key - ``short``; blank windows are dropped.

    A row is dealt to the windows it overlaps (strictly) by number, so there is
    no join on time. ``until`` is a column with the key's end; by default the last row's.
    """
    rows = df.select(*key, F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), F.col(text).alias("t"), F.col(order).alias("o"), *([F.col(until).cast("double").alias("u")] if until else []))
    if until is None:
        rows = rows.withColumn("u", F.max("e").over(W.partitionBy(*key)))
    first, last = F.greatest(F.floor((F.col("s") - width) / hop) + 1, F.lit(0)), F.ceil(F.col("e") / hop) - 1
    dealt = rows.where(first <= last).withColumn("win", F.explode(F.sequence(first.cast("long"), last.cast("long")))).where(F.col("win") * hop < F.col("u") - short)
    out = dealt.groupBy(*key, "win").agg(F.first("u").alias("u"), F.array_sort(F.collect_list(F.struct("o", "t"))).alias("rows"))
    return (
        out.withColumn("text", F.trim(F.array_join(F.transform("rows", lambda r: F.trim(r["t"])), " ")))
        .where("text <> ''")
        .select(*key, "win", (F.col("win") * hop).alias("win_start"), F.least(F.col("win") * hop + width, F.col("u")).alias("win_end"), "text")
    )


def squared_length(tokens: Column) -> Column:
    """Sum of the squared counts of a token array's terms, in one pass over the sorted tokens: the r-th of a run adds 2r - 1."""
    start = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("run"), F.lit(0.0).alias("total"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(a["term"] == w, a["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(w.alias("term"), run.alias("run"), (a["total"] + (2 * run - 1)).alias("total"))

    return F.aggregate(F.sort_array(tokens), start, step, lambda a: a["total"])


def cosine_to(tokens: Column, prototype: dict[str, int]) -> Column:
    """Cosine between a token array's counts and a fixed bag of words; 0 if either is empty.

    The prototype is a literal map, so nothing is joined or shipped.
    """
    if not prototype:
        return F.lit(0.0)
    weights = F.create_map(*[x for w, n in sorted(prototype.items()) for x in (F.lit(w), F.lit(float(n)))])
    dot = F.aggregate(tokens, F.lit(0.0), lambda a, w: a + F.coalesce(weights[w], F.lit(0.0)))
    norm = F.sqrt(squared_length(tokens))
    own = float(sum(n * n for n in prototype.values())) ** 0.5
    return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(dot / (norm * own))


def pairwise_cosine(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str = "tokens") -> DataFrame:
    """Cosine of each pair of bags that share a term: an equi-join on terms, summed map-side."""
    terms = lambda df, i: df.select(i, F.explode(tokens).alias("term")).groupBy(i, "term").agg(F.count("*").alias("n"))
    a, b = terms(left, left_id), terms(right, right_id)
    norm = lambda df, i, name: df.groupBy(i).agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias(name))
    dots = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), "term").groupBy(left_id, right_id).agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    return dots.join(norm(a, left_id, "la"), left_id).join(norm(b, right_id, "lb"), right_id).select(left_id, right_id, (F.col("dot") / (F.col("la") * F.col("lb"))).alias("cosine"))


def best_cosine(tokens: Column, bags: Sequence[dict[str, int]]) -> Column:
    return F.greatest(F.lit(0.0), F.lit(0.0), *[cosine_to(tokens, b) for b in bags])


def intent_score(hits: Column, tokens: Column, promo: Sequence[dict[str, int]], anti: Sequence[dict[str, int]], *, per_hit: float = 0.22, against: float = 0.7) -> Column:
    """min(1, per_hit x hits) + best promotional cosine - against x best other cosine, 0 at least."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), hits * per_hit) + best_cosine(tokens, promo) - against * best_cosine(tokens, anti))


def intent_reasons(hits: Column, tokens: Column, promo: Sequence[dict[str, int]], anti: Sequence[dict[str, int]], *, promo_from: float = 0.08, anti_from: float = 0.12) -> Column:
    """The first six phrases, and how like the prototypes a text is where that is telling."""
    like = lambda name, bags, least: F.get(F.transform(F.array(best_cosine(tokens, bags)), lambda x: F.when(x >= least, F.concat(F.lit(f"{name}="), F.format_string("%.2f", x)))), F.lit(0))
    return F.concat(F.slice(hits, 1, 6), F.array_compact(F.array(like("promo_sim", promo, promo_from), like("anti_sim", anti, anti_from))))


def suppressed_top(df: DataFrame, key: Sequence[str], *, score: str, start: str, seq: str, apart, k: int) -> DataFrame:
    """Greedy picks by falling score (then seq): none starts within ``apart`` of one picked before, k at most, by start.

    The fold needs what it picked before, so it runs over the key's sorted array.
    """
    ranked = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("down"), F.col(seq).alias("seq"), F.col(start).alias("start")))).alias("rows"))
    none = F.expr("filter(rows, r -> false)")
    pick = lambda acc, r: F.when((F.size(acc) < k) & ~F.exists(acc, lambda p: F.abs(p["start"] - r["start"]) < apart), F.array_append(acc, r)).otherwise(acc)
    picked = ranked.select(*key, F.explode(F.aggregate("rows", none, pick)).alias("p"))
    return picked.select(*key, F.col("p.seq").alias(seq), F.col("p.start").alias(start), (-F.col("p.down")).alias(score))


def all_windows(df: DataFrame, key: Sequence[str], *, start: str, end: str, text: str, order: str, width: float, hop: float) -> DataFrame:
    """As hopping_text, with blank windows too (their text is empty), and up to the very end: while t < end of the key."""
    ends = df.groupBy(*key).agg(F.max(F.col(end).cast("double")).alias("u")).where("u > 0")
    every = ends.withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("u") / hop) - 1).cast("long"))))
    held = hopping_text(df, key, start=start, end=end, text=text, order=order, width=width, hop=hop, short=0.0).select(*key, "win", "text")
    out = every.join(held, [*key, "win"], "left")
    return out.select(*key, "win", (F.col("win") * hop).alias("win_start"), F.least(F.col("win") * hop + width, F.col("u")).alias("win_end"), F.coalesce("text", F.lit("")).alias("text"))
