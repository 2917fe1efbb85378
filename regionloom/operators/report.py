"""The region report, and its rendering as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.regions import pretty_bytes


def index_percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, p50, p95``: the values at index ``n div 2`` and ``n * 95 div 100`` of each key's ascending values.

    Equal values are counted before they are ordered, so the ordered part is as
    small as the number of different values.
    """
    counted = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("cum", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    return ranked.groupBy(key).agg(
        F.min(F.when(F.col("cum") > F.expr("n div 2"), F.col(value))).alias("p50"),
        F.min(F.when(F.col("cum") > F.expr("n * 95 div 100"), F.col(value))).alias("p95"),
    )


def region_report(regions: DataFrame, key: str) -> DataFrame:
    """``key, n_regions, load_share, total_size, p50, p95, locality`` by a column of ``regions``.

    ``regions`` has ``size, load, transfer``; an unknown size counts as 0.  The
    load share is of all regions' load, 0 if there is none; locality is 1 where
    there are no bytes.
    """
    r = regions.select(F.col(key).alias("key"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("load", F.lit(0.0)).alias("load"), "transfer")
    groups = r.groupBy("key").agg(F.count("*").alias("n_regions"), F.sum("load").alias("load"), F.sum("size").alias("total_size"), F.sum("transfer").alias("transfer"))
    everything = r.agg(F.sum("load")).scalar()
    shared = groups.withColumn("load_share", F.when(everything > 0, F.col("load") / everything).otherwise(F.lit(0.0)))
    return (
        shared.join(index_percentiles(r, "key", "size"), "key")
        .select(
            "key",
            "n_regions",
            "load_share",
            "total_size",
            "p50",
            "p95",
            F.when(F.col("total_size") > 0, 1 - F.col("transfer") / F.col("total_size")).otherwise(F.lit(1.0)).alias("locality"),
        )
        .orderBy("key")
    )


def rendered(report: DataFrame, width: int = 40) -> DataFrame:
    """The report as lines of fixed width: ``key, line``."""
    size = [pretty_bytes(F.col(c)) for c in ("total_size", "p50", "p95")]
    line = F.format_string(
        f"%-{width}s %8d %7.3f %10s %10s %10s %7.3f", F.col("key").cast("string"), F.col("n_regions"), F.col("load_share"), *size, F.col("locality")
    )
    return report.select("key", line.alias("line"))
