"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontamination, erasure, mixing, packing, quality_classifier, quality_rules, secret_scan, sharding, simhash, substring_dedup, token_counts, weighted_sampling, whitening
from tidewell.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    places = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(places, ",").alias("spans"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2, words64=1)
    digits = F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(table(spark, sf_dir, "documents"), n_shards=24)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, weights)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.sha2(F.concat_ws(",", "items"), 256)).withColumnRenamed("items", "items_sha256")


def op13_cascading_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erasure.cascade(*[table(spark, sf_dir, name) for name in ("clients", "clicks", "sales", "sale_lines")])


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_secret_scan, op3_simhash_near_dedup, op4_sharding, op5_mixing,
        op6_weighted_fingerprints, op7_token_counts, op8_quality_classifier, op9_best_fit_packing, op10_substring_dedup,
        op11_embedding_whitening, op12_decontamination, op13_cascading_erasure,
    )
}
