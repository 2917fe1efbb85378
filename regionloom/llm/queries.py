"""One query per operator: the operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, mixing, pii, quality, rules, secrets, sharding, simhash, token_counts
from .oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=16)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(_table(spark, sf_dir, "documents")).drop("cleaned")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_personal_data(_table(spark, sf_dir, "documents"))


# What SQL can decide of the queries above; the rest of their columns is held against brute force by tests.


def sharding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of `op2_sharding`: each row's size and law."""
    return op2_sharding(spark, sf_dir).select("doc_id", "size", "law")


def sharding_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of `op2_sharding`, by shard: whether its slots are gapless from 0, and its bytes within a largest row of the mean."""
    slots = op2_sharding(spark, sf_dir).groupBy("shard", "slot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    shards = slots.groupBy("shard").agg(
        ((F.min("slot") == 0) & (F.max("slot") + 1 == F.count("*")) & (F.max("n") == 1)).alias("gapless"), F.sum("bytes").alias("bytes"), F.max("largest").alias("largest")
    )
    whole = shards.agg(F.avg("bytes").alias("mean"), F.max("largest").alias("row"))
    return shards.crossJoin(whole).select("shard", "gapless", (F.abs(F.col("bytes") - F.col("mean")) <= F.col("row")).alias("near"))  # beside one row


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of `op8_source_mixing`, by source: size, target, whether what is taken is within 1 % of it, and no document over three times."""
    over = F.sum(F.when((F.col("taken") > 3 * F.col("size")) | (F.col("taken") < 0), 1).otherwise(0))
    sums = op8_source_mixing(spark, sf_dir).groupBy("source", "source_size", "target").agg(F.count("*").alias("n_docs"), F.sum("taken").alias("taken"), over.alias("n_over"))
    near = F.abs(F.col("taken") - F.col("target")) <= F.greatest(F.col("target") * 0.01, F.lit(1.0))
    return sums.select("source", "source_size", F.round("target", 6).alias("target"), "n_docs", "n_over", near.alias("near"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of `op10_pii`: the counts of the fixed patterns."""
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_sharding,
        op3_quality_classifier,
        op4_secret_scans,
        op5_quality_rules,
        op6_simhash_near_dedup,
        op7_license_scans,
        op8_source_mixing,
        op9_benchmark_decontamination,
        op10_pii,
        sharding_sizes,
        sharding_shards,
        mixing_targets,
        pii_base_counts,
    )
}
