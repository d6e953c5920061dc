"""Connected components of a links table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint
from spanforge.shipping import ship

def joined(links: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Each node's component by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); component is the smallest node reachable.

    Each task first joins the links it holds by union-find and passes on a star
    for each tree, at most one link a node, whatever the number of links.
    """
    ship(links.sparkSession)

    def stars(batches: Iterable[pd.DataFrame]):
        found = joined((a, b) for pdf in batches for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()))
        far = [(c, x) for x, c in found.items() if x != c]
        yield pd.DataFrame(far, columns=["a", "b"], dtype="int64")

    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    return spread(checkpoint(ends.mapInPandas(stars, "a long, b long").distinct()))


def spread(links: DataFrame) -> DataFrame:
    """connected() without the local joins. Labels spread along links and jump to their label's label, so the rounds grow
    with the logarithm of a chain. Minima combine before each shuffle; joins on
    hubs are dealt out by size. Each round's labels are written to the shared folder.
    An empty table gives an empty one; null ends and loops are ignored.
    """
    both = checkpoint(links.union(links.select("b", "a")))
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("onward"))
        moved = checkpoint(spread.join(target, "component").select("node", "was", F.least("component", "onward").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            return labels
