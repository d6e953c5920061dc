"""Removal of long repeated byte strings by run-length indexes.

Texts are taken as UTF-8 bytes. Equal texts form one class and are indexed once.

1. Each window of ``width`` bytes belongs, by content alone, to a key (its least
   gram hash); neighbouring windows with one key form a run. Equal windows have
   equal keys, wherever they are.
2. Runs whose key occurs once, at one place, can't repeat. The bytes of the others' windows go
   to groups by key, many keys a group. A frequent key's runs are dealt out in
   blocks, and each pair of blocks is a group, so none grows with the data.
3. A group builds a run-compressed Burrows-Wheeler transform with sampled run
   ends over its distinct strings, streams matching statistics and marks windows
   that start elsewhere too.
4. Marked windows of each text are merged into spans; with ``least_words`` only
   spans of so many words are removed.

Null and empty texts, and texts under ``width`` bytes, keep all bytes. Repeated
rows are repeats of one another: texts of at least ``width`` bytes (and
``least_words`` words) that occur twice lose every byte. Texts of any length are
cut into runs and groups of bounded size. Only the id and the text are read, so
other columns can't clash. An empty table gives an empty result.

``shared_passages`` is a screen beside it, by words: whether another text holds
one of a text's passages of ``words`` words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.anchors import Powers, runs, sliding_minima
from spanforge.llm.common import checkpoint, map_rows, text_of
from spanforge.llm.minmax_sketch import WordHashes, mixed
from spanforge.llm.rindex import MOST_BYTES, repeated_windows
from spanforge.shipping import ship

#: Runs in a group at most (of one frequent key, in two blocks), and runs that groups of other keys have on average.
KEY_RUNS, GROUP_RUNS = 1_400, 2_500
#: Bytes that one index takes (of more keys than one).
INDEX_BYTES = 600_000
_SPANS = "array<struct<start:long,end:long>>"


def _key(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:16]


def key_column(text: Column) -> Column:
    """``_key`` of a text's bytes."""
    return F.substring(F.unhex(F.sha2(F.encode(text, "utf-8"), 256)), 1, 16)


def _summaries(texts: DataFrame, width: int, count_words: bool) -> DataFrame:
    """For each row the text's key, length and digest, and the runs of its windows."""

    def make():
        powers = Powers()

        def work(cols):
            out = {"doc_id": cols["doc_id"], "text_key": [], "n_bytes": [], "n_words": [], "sha256": [], "keys": [], "firsts": [], "lasts": [], "insides": []}
            for text in cols["text"]:
                raw = (text or "").encode()
                keys, firsts, lasts, insides = runs(np.frombuffer(raw, np.uint8), width, powers)
                for name, value in (("text_key", _key(raw)), ("n_bytes", len(raw)), ("n_words", len(raw.split()) if count_words else 0), ("sha256", hashlib.sha256(raw).hexdigest()), ("keys", keys.view(np.int64)), ("firsts", firsts), ("lasts", lasts), ("insides", insides)):
                    out[name].append(value)
            return out

        return work

    return map_rows(texts, make, "doc_id long, text_key binary, n_bytes long, n_words long, sha256 string, keys array<long>, firsts array<long>, lasts array<long>, insides array<boolean>")


def _packed(texts: DataFrame, width: int) -> DataFrame:
    """Texts long enough to lose bytes, compressed for the way through a shuffle."""

    def make():
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress

        def work(cols):
            raw = [t.encode() for t in cols["text"]]
            return {"rep": cols["rep"], "text_key": [_key(r) for r in raw], "packed": [pack(r) for r in raw]}

        return work

    return map_rows(texts.where(F.octet_length("text") >= width).withColumn("rep", F.coalesce("doc_id", F.lit(-(1 << 63)))).select("rep", "text"), make, "rep long, text_key binary, packed binary")


def _cuttings(docs: DataFrame, width: int) -> DataFrame:
    """The bytes of each run's windows."""

    def make():
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def work(cols):
            out = {"text_key": [], "run_key": [], "n_runs": [], "first": [], "bytes": []}
            for text_key, packed, found in zip(cols["text_key"], cols["packed"], cols["runs"]):
                raw = unpack(packed)
                for r in found:
                    for name, value in (("text_key", text_key), ("run_key", r["run_key"]), ("n_runs", r["n_runs"]), ("first", r["first"]), ("bytes", raw[r["first"] : r["last"] + width])):
                        out[name].append(value)
            return out

        return work

    return map_rows(docs, make, "text_key binary, run_key long, n_runs long, first long, bytes binary")


def _marked(cuttings: DataFrame, groups: int, width: int) -> DataFrame:
    """Byte spans (text_key, start, end) of repeated windows."""
    ship(cuttings.sparkSession)
    blocks = F.when(F.col("n_runs") <= KEY_RUNS, 1).otherwise(F.ceil(2 * F.col("n_runs") / KEY_RUNS)).cast("int")
    dealt = cuttings.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("text_key", "first"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = dealt.select(
        F.when(F.col("blocks") > 1, F.col("run_key")).otherwise(F.pmod(F.xxhash64("run_key"), F.lit(groups))).alias("bin"),
        F.least("mine", "other").alias("x"),
        F.greatest("mine", "other").alias("y"),
        (F.col("blocks") > 1).alias("hot"),
        "text_key", "run_key", "first", "bytes",
    )

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run_key", kind="stable")
        keys, firsts, strings = rows["text_key"].tolist(), rows["first"].to_numpy(), rows["bytes"].tolist()
        sizes = np.cumsum(np.fromiter(map(len, strings), np.int64) + 1)
        edges = np.flatnonzero(np.diff(rows["run_key"].to_numpy(), append=0, prepend=0) != 0).tolist()
        edges = sorted({0, *edges[1:-1], len(rows)}) if len(rows) > 1 else [0, len(rows)]
        out: list[tuple[bytes, int, int]] = []
        at = 0
        for i, edge in enumerate(edges[1:], 1):
            ahead = edges[i + 1] if i + 1 < len(edges) else None
            if ahead is not None and sizes[ahead - 1] - (sizes[at - 1] if at else 0) <= INDEX_BYTES:
                continue
            for key, first, flags in zip(keys[at:edge], firsts[at:edge], repeated_windows(strings[at:edge], width)):
                turns = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
                out += [(key, int(first + a), int(first + b - 1 + width)) for a, b in zip(turns[::2], turns[1::2])]
            at = edge
        return pd.DataFrame(out, columns=["text_key", "start", "end"]).astype({"start": "int64", "end": "int64"})

    return keyed.groupBy("hot", "bin", "x", "y").applyInPandas(mark, "text_key binary, start long, end long")


def _kept(docs: DataFrame, least_words: int) -> DataFrame:
    """Spans and what they leave of each text: text_key, spans, n_removed, kept (compressed), kept_sha256."""

    def make():
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress

        def work(cols):
            out = {"text_key": cols["text_key"], "spans": [], "n_removed": [], "kept": [], "kept_sha256": []}
            for packed, found in zip(cols["packed"], cols["found"]):
                raw, spans, rest, at = unpack(packed), merged([(s["start"], s["end"]) for s in found]), [], 0
                if least_words:
                    spans = [(a, b) for a, b in spans if len(raw[a:b].split()) >= least_words]
                for a, b in spans:
                    rest.append(raw[at:a])
                    at = b
                kept = b"".join([*rest, raw[at:]])
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out["n_removed"].append(len(raw) - len(kept))
                out["kept"].append(pack(kept))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            return out

        return work

    return map_rows(docs, make, f"text_key binary, spans {_SPANS}, n_removed long, kept binary, kept_sha256 string")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, *, width: int = 400, least_words: int = 0, passage_words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_key, n_bytes, n_removed, spans (of bytes, end excluded), kept_sha256.

    With ``passage_words`` also n_shared_passages and shares_passage, by ``shared_passages``.
    """
    assert 64 < width and 2 * KEY_RUNS * width < 2 * MOST_BYTES
    texts = text_of(docs, id_col, text_col)
    rows = checkpoint(_summaries(texts, width, least_words > 0))
    classes = checkpoint(rows.where(F.col("n_bytes") >= width).groupBy("text_key").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("rep"), F.count("*").alias("copies")))
    # A class's runs are taken from its representative's row, or from one of several such rows.
    own = rows.withColumn("rep", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(classes.select("text_key", "rep"), ["text_key", "rep"], "left_semi").dropDuplicates(["text_key", "rep"])
    run_rows = checkpoint(own.select("text_key", "rep", F.explode(F.arrays_zip("keys", "firsts", "lasts", "insides")).alias("r")).select("text_key", "rep", F.col("r.keys").alias("run_key"), F.col("r.firsts").alias("first"), F.col("r.lasts").alias("last"), F.col("r.insides").alias("inside")))
    # Written, so that both sides of the join are plain shuffles and a frequent key's rows can be dealt out.
    often = checkpoint(run_rows.groupBy("run_key").agg(F.count("*").alias("n_runs"), F.max("inside").alias("inside")).where("n_runs > 1 OR inside").drop("inside"))
    shared = run_rows.join(often, "run_key").groupBy("text_key", "rep").agg(F.collect_list(F.struct("run_key", "n_runs", "first", "last")).alias("runs"), F.count("*").alias("n"))
    chosen = checkpoint(_packed(texts, width).join(shared, ["text_key", "rep"]).dropDuplicates(["text_key", "rep"]))
    n_shared = chosen.agg(F.sum("n")).first()[0] or 0
    spans = checkpoint(_marked(_cuttings(chosen.select("text_key", "packed", "runs"), width), max(1, n_shared // GROUP_RUNS), width))
    found = spans.groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    results = _kept(chosen.select("text_key", "packed").join(found, "text_key"), least_words).drop("kept")
    known = classes.select("text_key", "copies").join(results, "text_key", "left")
    if passage_words:
        known = known.join(shared_passages(docs, words=passage_words, text_col=text_col), "text_key", "full")
    # One row a text, written, so that both sides of the join are plain shuffles and a frequent text's rows can be dealt out.
    out = rows.drop("keys", "firsts", "lasts", "insides").join(checkpoint(known), "text_key", "left")
    gone = F.coalesce(F.col("copies") > 1, F.lit(False)) & (F.col("n_words") >= least_words)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    passages = [F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared_passages"), F.col("n_shared").isNotNull().alias("shares_passage")] if passage_words else []
    return out.select(
        "doc_id",
        "text_key",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, whole).otherwise(F.coalesce("spans", F.expr(f"CAST(array() AS {_SPANS})"))).alias("spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        *passages,
    )


#: Words of the gram by which passages are compared.
PASSAGE_GRAM = 20


def passage_keys(raw: bytes, words: int, gram: int, memo: WordHashes) -> np.ndarray:
    """The least gram hash of each ``words`` consecutive words, distinct: alike for two texts where such passages are."""
    tokens = raw.split()
    if len(tokens) < words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - gram + 1 + i]
    return np.unique(sliding_minima(mixed(grams), words - gram + 1))


def shared_passages(docs: DataFrame, *, words: int = 51, gram: int = PASSAGE_GRAM, text_col: str = "text") -> DataFrame:
    """One row for each distinct text that shares a key with another text: text_key and n_shared (keys shared).

    Two texts with ``words`` consecutive words in common share a key, so none is
    missed; a stretch of ``gram`` words or more in common may give one too.
    Copies of a text count once. Null and short texts share nothing.
    """

    def make():
        memo = WordHashes()

        def work(cols):
            raw = [t.encode() for t in cols["text"]]
            return {"text_key": [_key(r) for r in raw], "keys": [passage_keys(r, words, gram, memo).view(np.int64) for r in raw]}

        return work

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= 2 * words - 1)
    keyed = map_rows(texts, make, "text_key binary, keys array<long>").where(F.size("keys") > 0)
    once = checkpoint(keyed.groupBy("text_key").agg(F.first("keys").alias("keys")))  # a text's keys follow from the text
    pairs = once.select("text_key", F.explode("keys").alias("key"))
    # Counted first and written, so that both sides of the join are plain shuffles and a frequent key's rows can be dealt out.
    often = checkpoint(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    return pairs.join(often, "key").groupBy("text_key").agg(F.count("*").alias("n_shared"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", *[c for c in ("n_shared_passages", "shares_passage") if c in found.columns])


def cut(docs: DataFrame, found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with the found spans removed from their texts, all columns kept.

    Spans follow from the text, so they are joined by it: rows with a null or a
    shared id are cut as any others. Bytes of a character that a span cuts
    through are dropped with it. Null texts stay null.
    """
    spans = found.where("n_removed > 0").groupBy(F.col("text_key").alias("__key")).agg(F.first("spans").alias("__spans"))
    joined = docs.where(F.col(text_col).isNotNull()).withColumn("__key", key_column(F.col(text_col).cast("string"))).join(spans, "__key", "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, spans):
            raw, rest, at = text.encode(), [], 0
            for s in spans:
                rest.append(raw[at : s["start"]])
                at = s["end"]
            return b"".join([*rest, raw[at:]]).decode("utf-8", "ignore")

        return pd.Series([t if s is None else one(t, s) for t, s in zip(texts, spans)], dtype=object)

    new = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col("__spans")))
    whole = joined.withColumn(text_col, new).select(*[F.col(f"`{c}`") for c in docs.columns])
    return whole.unionAll(docs.where(F.col(text_col).isNull()))
