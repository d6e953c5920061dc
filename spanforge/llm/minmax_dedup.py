"""Near-duplicate components by min-max hashing.

1. Each text becomes a set of word shingles and a min-max sketch cut into bands.
   Texts with equal sets are one class; its smallest id stands for it.
2. Classes that share a band with others are candidates. Each is held against
   the smallest id of its bucket on the full sets, which links most groups.
3. Buckets that still hold several components are compared in full, in blocks:
   a group task takes two blocks of bounded size, counts all intersections by a
   matrix product and returns a spanning set of links between components. So no
   link between candidates is lost, and no bucket is gathered in one task.

With the standing 40 bands of 6 rows, two texts at the threshold of 0.8 share a
band with probability 1 - 5e-6, and ones of 0.05 with under 1e-6.

Null, empty and wordless texts have the empty set: linked with nothing, kept.
Rows with a null id are not linked and are kept, with a null component. Repeated
rows give repeated rows; an empty table gives an empty result. Texts of any length
are compared in whole. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, map_rows, text_of
from spanforge.llm.components import connected
from spanforge.llm.minmax_sketch import MinMax, WordHashes, set_key, shingles
from spanforge.shipping import ship

#: Bounds of a block of a bucket: rows, shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 4_000_000


def sketches(docs: DataFrame, words: int, minmax: MinMax) -> DataFrame:
    """doc_id, n_shingles, set_key and bands of each row."""

    def make():
        memo = WordHashes()

        def work(cols):
            out = {"doc_id": cols["doc_id"], "n_shingles": [], "set_key": [], "bands": []}
            for text in cols["text"]:
                s = shingles(text, memo, words)
                out["n_shingles"].append(len(s))
                out["set_key"].append(set_key(s) if len(s) else None)
                out["bands"].append(minmax.sketch(s).view(np.int64) if len(s) else None)
            return out

        return work

    return map_rows(docs, make, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the sorted set of shingle hashes."""

    def make():
        memo = WordHashes()
        return lambda cols: {"doc_id": cols["doc_id"], "shingles": [shingles(t, memo, words).view(np.int64) for t in cols["text"]]}

    return map_rows(docs, make, "doc_id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    near = pairs.join(right, "b").join(left, "a").where(100 * small >= percent * large)
    return near.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def links_between(ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between rows marked left and rows marked right, of different groups, enough to join all groups that links join."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), sizes), counts[where] > 1
    column = np.cumsum(counts > 1)[where[shared]] - 1
    owner, n_columns = owner[shared], int((counts > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((int(left.sum()), int(right.sum())), np.float32)
    for at in range(0, n_columns, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        table = np.zeros((len(sets), min(4096, n_columns - at)), np.float32)
        table[owner[a:b], column[a:b] - at] = 1
        common += table[left] @ table[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    hits = (100 * common >= percent * union) & (groups[left][:, None] != groups[right][None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(hits)):
        a, b = root(int(groups[left][i])), root(int(groups[right][j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield int(ids[left][i]), int(ids[right][j])


def _between_components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components inside buckets; members has band, doc_id and component."""
    ship(members.sparkSession)
    sized = members.join(sets.select("doc_id", "shingles"), "doc_id")
    size = checkpoint(sized.groupBy("band").agg(F.count("*").alias("rows"), F.sum(F.size("shingles")).alias("held")))
    blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("held") / BLOCK_SHINGLES)).cast("int")
    blocked = sized.join(size.select("band", blocks.alias("blocks")), "band").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id").drop_duplicates("doc_id")
        mine, x, y = rows["mine"].to_numpy(), rows["x"].iloc[0], rows["y"].iloc[0]
        found = list(links_between(rows["doc_id"].to_numpy(), rows["component"].to_numpy(), [np.asarray(s) for s in rows["shingles"]], mine == x, mine == y, percent))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    keyed = dealt.select("band", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "doc_id", "component", "shingles")
    return keyed.groupBy("band", "x", "y").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 2, percent: int = 80, bands: int = 40, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (smallest id of an equal set), component_id, kept."""
    texts = text_of(docs, id_col, text_col)
    sketched = checkpoint(sketches(texts, words, MinMax(bands, rows)))
    classes = checkpoint(sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    placed = classes.select("rep", F.explode("bands").alias("band"))
    # Written, as are other sums by bucket, so that both sides of a join are plain shuffles and a full bucket's rows can be dealt out.
    buckets = checkpoint(placed.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"))
    members = checkpoint(placed.join(buckets, "band").select("band", F.col("rep").alias("doc_id"), "pivot"))

    candidates = members.select("doc_id").distinct()
    sets = checkpoint(shingle_sets(texts.join(candidates, "doc_id", "left_semi"), words))
    stars = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    linked = checkpoint(_confirmed(stars, sets, percent))
    first = connected(linked)
    labelled = members.select("band", "doc_id").join(first.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = checkpoint(labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band"))
    more = checkpoint(_between_components(labelled.join(split, "band"), sets, percent))
    found = first if more.isEmpty() else connected(linked.union(more))
    grouped = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_key", "rep", F.coalesce("component", "rep").alias("component"))
    rows_ = sketched.select("doc_id", "n_shingles", "set_key")
    alone = "set_key IS NULL OR doc_id IS NULL"  # kept out of the join, where they would all meet in one task
    out = rows_.where(f"NOT ({alone})").join(grouped, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("component", "doc_id").alias("component_id"),
    ).unionAll(rows_.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
