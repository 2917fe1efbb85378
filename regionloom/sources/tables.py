"""Scans of the catalog and the server list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog(regions: DataFrame, *, excluded: DataFrame | None = None, table: str | None = None, skip_disabled: bool = False) -> DataFrame:
    """Regions of the catalog, without an excluded set of tables (``table_name``) or disabled ones, or of one table.

    A table's name is matched without regard to case.
    """
    out = regions
    if excluded is not None:
        out = out.join(excluded.select("table_name").distinct(), "table_name", "left_anti")
    if skip_disabled:
        out = out.where(~F.coalesce("table_disabled", F.lit(False)))
    if table is not None:
        out = out.where(F.lower("table_name") == table.lower())
    return out


def tables_by_state(regions: DataFrame, disabled: bool) -> DataFrame:
    """``table_name`` of the tables that are disabled, or of those that aren't."""
    return regions.where(F.coalesce("table_disabled", F.lit(False)) == disabled).select("table_name").distinct()


def servers_by_host(servers: DataFrame) -> DataFrame:
    """One server per host name: of several, the last by identity."""
    return servers.groupBy("hostname").agg(F.max("server").alias("server"))
