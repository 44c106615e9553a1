"""The named queries of this subpackage, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    bpe,
    clustering,
    hard_negatives,
    kneser_ney,
    language,
    licenses,
    minhash,
    mixing,
    oracles,
    pii,
    quality_rules,
    repeats,
    sharding,
    simhash,
)
from ledgerloom.llm.words import documents, embeddings

Query = Callable[[SparkSession, str], DataFrame]


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, folder), size=3, radius=2)
    return rows.withColumn("fingerprint", simhash.hexadecimal("fingerprint"))


def quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.ruled(documents(spark, folder))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_stop_words",
        "n_upper",
    )


def mixture(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mixed(documents(spark, folder))
    return rows.select("doc_id", "source", "copy", "n_copies", "shuffle_key", "text")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.sharded(documents(spark, folder))
    return rows.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def bpe_digests(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder).select("doc_id", "text"))


def pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    rows = pii.pseudonymised(documents(spark, folder))
    return rows.select("doc_id", "text", F.size("pii").alias("n_pii"), F.col("pii").alias("kinds"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.compared_with_next(documents(spark, folder))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder)
    model = language.learn(rows.where(~language.held_out()))
    return language.identified(rows.select("doc_id", "text"), model).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score"
    )


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(documents(spark, folder))


def quality_model(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    trusted = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0))
    return kneser_ney.judged(documents(spark, folder), trusted)


def without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digests(documents(spark, folder))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.digests(embeddings(spark, folder))


def negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = embeddings(spark, folder)
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mined(vectors.withColumn("label", changed), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_simhash": near_duplicates,
    "op2_quality_rules": quality,
    "op3_mixing": mixture,
    "op4_pii": pseudonyms,
    "op5_kneser_ney": quality_model,
    "op6_minhash": fingerprints,
    "op7_sharding": shards,
    "op8_bpe": bpe_digests,
    "op9_licenses": license_scan,
    "op10_language": languages,
    "op11_repeats": without_repeats,
    "op12_clustering": clusters,
    "op13_hard_negatives": negatives,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
