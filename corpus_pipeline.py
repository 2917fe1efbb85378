"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps, with
the columns of ``documents``; the last returns the shards.  Every stage's rows are
written as Parquet in the shared folder and read back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regionloom.llm import decontaminate, mixing, quality, sharding, simhash, store


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged like any text, and every row on its own: null ids,
    repeated rows and ids that several rows share change nothing.  Without usable
    labels nothing is rejected.  Columns of any name come back as they were; an empty
    table gives an empty one.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest id.

    Exact copies are a group whatever their ids: rows that share an id, or have none,
    included; rows without an id come last.  Null, empty and blank texts are one
    group.  Columns of any name come back as they were; an empty table gives an empty one.
    """
    return simhash.keep_one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Texts are searched whole; null and empty ones hold nothing.  Every row is judged
    on its own.  Null, empty and very short items (`keep_clean`) convict no text,
    repeated items count once.  Columns of any name come back as they were; an empty
    table on either side leaves the documents as they are.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents go, stay or repeat.

    Documents without a word, null texts too, are no part of a mix and go.  The null
    source is a source.  Rows that share id and text are rounded alike; null ids are
    told apart by their text.  Columns of any name come back as they were; an empty
    table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get their shard and place, by the law ``bytes``; the columns are those of `shard_documents`.

    Every row gets a place: null texts, null ids and repeated rows too.  An empty
    table gives an empty one.
    """
    return sharding.shard_documents(docs, n_shards=16)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", shards),
]

#: SQL expresses neither the classifier nor the near-duplicate stage; tests hold `run` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = store.mark()
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        store.drop_since(written, but=1)  # what the stage wrote on its way, and its input
    return docs
