"""Near-duplicate components by SimHash, searched by meet-in-the-middle ball hashing.

1. A text's fingerprint has a bit set where over half of its word shingles'
   hashes (XXH64, repeats included) have it set. A-Z is lower-cased; with fewer
   words the whole sequence is the one shingle, and a text without words has the
   fingerprint zero. Documents with one fingerprint are one class, so copies
   are compared once.
2. Every fingerprint emits all variants within half the radius of it. Two
   fingerprints within the radius have a variant in common: the point midway.
   Fingerprints are shuffled on variants; those that meet at one are within the
   radius of each other (for an even radius), and at most as many as a ball has
   points (65 of 64 bits at half a radius of 1), whatever the data.
3. Those that meet are linked in a chain by their order, each pair verified by
   its differing bits and kept once. As all that meet are linked with one
   another, chains join the same components that all pairs would.

Null, empty and wordless texts have the fingerprint zero, linked like any other.
Rows with a null id link nothing; they keep their fingerprint, and have a null
component. Repeated rows give repeated rows, texts of any length are hashed in
whole, an empty table gives an empty result. Only the id and the text are read,
so other columns can't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, map_rows, text_of
from spanforge.llm.components import connected

BITS = 64
#: Shingles whose bits are counted at a time.
SHINGLES_AT_ONCE = 65_536

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """Unsigned hashes of all word shingles, in order."""
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line, width = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as an unsigned integer."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        raw = hashes[at : at + SHINGLES_AT_ONCE].astype(">u8").view(np.uint8)
        counts += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def make():
        def work(cols):
            found = [fingerprint(shingle_hashes(t, words, seed)) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "fp": np.array(found, np.uint64).view(np.int64)}

        return work

    return map_rows(text_of(docs, id_col, text_col), make, "doc_id long, fp long")


def masks(most: int) -> list[int]:
    """All 64-bit masks of ``most`` bits or fewer, as signed longs."""
    found = [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(classes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of representatives whose fingerprints are within the radius: each once, enough to join what all links join.

    classes has fp and rep, one row a fingerprint.
    """
    assert radius % 2 == 0, "fingerprints that meet are within the radius only if it is even"
    variants = F.explode(F.array(*[F.lit(m) for m in masks(radius // 2)]))
    emitted = classes.select("fp", "rep", variants.alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", "rep")
    meeting = W.partitionBy("variant").orderBy("fp")
    pairs = emitted.select(F.lag("rep").over(meeting).alias("a"), F.lag("fp").over(meeting).alias("other"), F.col("rep").alias("b"), "fp").where("a IS NOT NULL")
    return pairs.where(differing(F.col("fp"), F.col("other")) <= radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fp, class_id (smallest id of an equal fingerprint), component_id, kept."""
    hashed = checkpoint(fingerprints(docs, words=words, seed=seed, id_col=id_col, text_col=text_col))
    known = hashed.where("doc_id IS NOT NULL")
    classes = checkpoint(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected(links(classes, radius)).select(F.col("node").alias("rep"), "component")
    # Written, so that both sides of the join are plain shuffles and a frequent fingerprint's rows can be dealt out.
    grouped = checkpoint(classes.join(found, "rep", "left").select("fp", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id")))
    nothing = F.lit(None).cast("long")
    out = known.join(grouped, "fp", "left").select("doc_id", "fp", "class_id", "component_id").unionAll(hashed.where("doc_id IS NULL").select("doc_id", "fp", nothing.alias("class_id"), nothing.alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
