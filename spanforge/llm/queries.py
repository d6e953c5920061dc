"""Queries over the driver's tables, one an operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from spanforge.llm import bpe_automaton, centroids, decontamination, language_id, license_scan, merkle, minmax_dedup, quality_rules, rindex_dedup, simhash, token_count, toxicity, warc
from spanforge.llm.common import table
from spanforge.llm.oracles import ORACLES as ORACLES


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(quality_rules.evaluate(table(spark, sf_dir, "documents")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def held_in_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned from."""
    return table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    stems, weights = toxicity.fit(toxicity.training_sample(docs, held_in_labels(spark, sf_dir)))
    return toxicity.predict(docs, stems, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    langs, model = language_id.fit(language_id.training_sample(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)))
    return language_id.predict(docs, langs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_rindex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex_dedup.digests(rindex_dedup.repeats(table(spark, sf_dir, "documents"), passage_words=51))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(bpe_automaton.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return centroids.digests(vectors, centroids.fit(vectors))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_minmax_dedup": op5_minmax_dedup,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_rindex_dedup": op9_rindex_dedup,
    "op10_bpe": op10_bpe,
    "op11_centroids": op11_centroids,
    "op12_simhash": op12_simhash,
    "op13_merkle": op13_merkle,
}
