"""Training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the
columns of documents; the last returns tokens. Stages are written as Parquet and
read again, so a lost executor costs one stage's lost partitions; a stage's files go
when the next one is written, and those of the last stay for the caller.

Every stage takes nulls in any column, empty and very long texts, repeated rows,
empty tables and further columns: rows with a null or an empty text are clean
and pass to the end with no tokens; rows that share an id stay or go together
where a stage decides by id (near_dedup), and by their own text elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe_automaton, decontamination, minmax_dedup, rindex_dedup, toxicity
from spanforge.llm.common import remove, shared_dir, table
from spanforge.llm.queries import held_in_labels, vocabulary

#: Passages of over 50 words are rarely shorter than this (README has figures).
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, fitted to labelled rows, scores 0.5 or more go."""
    stems, weights = toxicity.fit(toxicity.training_sample(docs, held_in_labels(spark, sf_dir)))
    return docs.where(toxicity.score_column(spark, F.col("text"), stems, weights) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles) the document with the smallest id stays (its repeated rows with it)."""
    found = minmax_dedup.near_duplicates(docs, words=5).where("NOT kept").select(F.col("doc_id").alias("__id"))
    return docs.join(found, F.col("doc_id").cast("long") == F.col("__id"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of PASSAGE_BYTES, where they run over PASSAGE_WORDS words or more, are cut out of the texts; no document goes."""
    cut = rindex_dedup.cut(docs, rindex_dedup.repeats(docs, width=PASSAGE_BYTES, least_words=PASSAGE_WORDS))
    return cut.withColumn("n_chars", F.length("text").cast(cut.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: doc_id, n_tokens, digests of the ids and of the text decoded from them, ids (packed)."""
    encoded = bpe_automaton.encode_decode(docs, vocabulary("byte_bpe_50k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("tokens", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
        docs = spark.read.parquet(before)
    return docs
