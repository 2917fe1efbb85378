"""Statistics brought to regions: sizes and times from files, transfer costs from blocks, load from latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.regions import block_transfer
from ..schema import NO_TIME


def merge_stats(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``left`` with each statistic taken from ``left`` if known there, else from ``right``."""
    r = right.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in columns if c in right.columns])
    joined = left.join(r, keys, "left")
    return joined.select(
        *[c for c in left.columns if c not in columns],
        *[
            (F.coalesce(c, f"__r_{c}") if c in left.columns and c in right.columns else F.col(c if c in left.columns else f"__r_{c}")).alias(c)
            for c in columns
        ],
    )


def file_stats(regions: DataFrame, files: DataFrame) -> DataFrame:
    """``region_path, size, modification_time`` of every region: bytes of visible files, newest of all files.

    A region without files has size 0 and the time `NO_TIME`.
    """
    listed = files.groupBy("region_path").agg(
        F.sum(F.when(F.col("visible"), F.col("length")).otherwise(F.lit(0))).alias("size"), F.max("modification_time").alias("modification_time")
    )
    return regions.select("region_path").join(listed, "region_path", "left").select(
        "region_path",
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.coalesce("modification_time", F.lit(NO_TIME)).cast("bigint").alias("modification_time"),
    )


def transfer_costs(blocks: DataFrame, placement: DataFrame) -> DataFrame:
    """``region_id, server_id, transfer``: bytes not local if each region lay where ``placement`` says.

    The join is on the region alone, so blocks are summed per region right after it.
    """
    p = placement.select("region_id", "server_id")
    return (
        blocks.join(p, "region_id")
        .groupBy("region_id", "server_id")
        .agg(F.sum(block_transfer(F.col("size"), F.col("replicas"), F.col("server_id"))).alias("transfer"))
    )


def with_transfer(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """``regions`` with the transfer cost on its own server, 0 for regions without blocks."""
    t = transfer_costs(blocks, regions).select("region_id", "transfer")
    return regions.join(t, "region_id", "left").withColumn("transfer", F.coalesce("transfer", F.lit(0)).cast("bigint"))


def load_weights(regions: DataFrame, metrics: DataFrame) -> DataFrame:
    """``regions`` with ``load``: the server's read latency spread over its regions by size; 0 without size."""
    on_server = F.sum("size").over(Window.partitionBy("server_id"))
    latency = metrics.select("server_id", "p75_read_latency")
    share = F.col("p75_read_latency") / F.nullif(F.col("__total"), F.lit(0)) * F.col("size")
    return (
        regions.withColumn("__total", on_server)
        .join(latency, "server_id")
        .withColumn("load", F.when(F.col("size") > 0, share).otherwise(F.lit(0.0)))
        .drop("__total", "p75_read_latency")
    )


def totals(regions: DataFrame, servers: DataFrame) -> DataFrame:
    """One row ``n_servers, n_empty_servers, n_regions``."""
    used = regions.groupBy("server_id").agg(F.count("*").alias("n"))
    return servers.select("server_id").join(used, "server_id", "left").agg(
        F.count("*").alias("n_servers"),
        F.sum(F.when(F.col("n").isNull(), F.lit(1)).otherwise(F.lit(0))).alias("n_empty_servers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_regions"),
    )
