"""Compaction plans: what is compacted, in which order, server by server."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compaction_plan(regions: DataFrame, *, table: str | None = None, servers: Sequence | None = None, threshold: float | None = None, reverse_locality: bool = False) -> DataFrame:
    """``server_id, position, region_id, transfer`` of the regions to compact.

    ``regions`` has ``transfer`` and ``hfiles``.  Within a server, regions with most
    bytes to fetch come first; ties by most files, or with ``reverse_locality`` by
    age.  A region whose locality is above the threshold is left out (equal is
    not).  The table is matched without regard to case.
    """
    chosen = regions
    if table is not None:
        chosen = chosen.where(F.lower("table_name") == table.lower())
    if servers is not None:
        chosen = chosen.where(F.col("server_id").isin(*servers))
    if threshold is not None:
        share = F.when(F.col("size") == 0, F.lit(1.0)).otherwise((F.col("size") - F.col("transfer")) / F.col("size"))
        chosen = chosen.where(share <= threshold)
    ties = F.asc_nulls_first("mtime") if reverse_locality else F.desc("hfiles")
    queue = Window.partitionBy("server_id").orderBy(F.desc("transfer"), ties, "region_id")
    return chosen.select("server_id", F.row_number().over(queue).alias("position"), "region_id", "transfer")


def throttled(plan: DataFrame, *, queue_size: int = 2, quiet_seconds: int = 5, kind: str = "major") -> DataFrame:
    """The plan with ``kind``, ``after_completions`` and ``earliest_second`` of each request.

    A server takes a request once so many of its earlier ones have ended, which keeps
    its queue below ``queue_size``, and rests for ``quiet_seconds`` before each.  A
    kind other than major, whatever its case, asks for a minor compaction.
    """
    return plan.withColumns(
        {
            "kind": F.lit("major" if kind.lower() == "major" else "minor"),
            "after_completions": F.greatest(F.col("position") - queue_size, F.lit(0)).cast("bigint"),
            "earliest_second": (F.col("position") * quiet_seconds).cast("bigint"),
        }
    )


def not_listed(regions: DataFrame, listed: DataFrame) -> DataFrame:
    """Regions that a list does not name."""
    return regions.join(listed.select("region_id").distinct(), "region_id", "left_anti")


def listed_regions(regions: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions that a list names, and the names that no region has."""
    names = listed.select("region_id").distinct()
    return regions.join(names, "region_id", "left_semi"), names.join(regions.select("region_id"), "region_id", "left_anti")


def flush_plan(tables: DataFrame, comma_list: str) -> DataFrame:
    """Tables to flush: those in a comma-separated list, case and blanks counting."""
    return tables.where(F.col("table_name").isin(*comma_list.split(",")))


def snapshot_names(tables: DataFrame, millis: int) -> DataFrame:
    """``table_name, snapshot``: the name of each table's snapshot at a time."""
    return tables.select("table_name", F.format_string("snapshot-%d-%s", F.lit(millis), F.col("table_name")).alias("snapshot"))
