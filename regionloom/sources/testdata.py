"""The star-schema test tables seen as a cluster.

Suppliers are servers, parts are regions, line items are file blocks with two
replicas each, orders give row keys and events give requests and gauges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import KEY_SPACE_END


class Cluster:
    """DataFrames over one data directory; each property is a plan, nothing is computed until used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def n_servers(self) -> int:
        return self.table("supplier").count()

    @property
    def servers(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(F.col("s_suppkey").alias("server_id"), F.col("s_name").alias("hostname"))

    @property
    def metrics(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(F.col("s_suppkey").alias("server_id"), (F.lit(5.0) + F.col("s_suppkey") % 7).alias("p75_read_latency"))

    @property
    def blocks(self) -> DataFrame:
        """``region_id, file_id, size, replicas``; a replica that is no server is dropped."""
        item, n = self.table("lineitem"), self.n_servers
        two = F.array("l_suppkey", F.col("l_suppkey") + 1)
        return item.select(
            F.col("l_partkey").alias("region_id"),
            F.col("l_orderkey").alias("file_id"),
            (F.col("l_quantity").cast("bigint") * 1048576).alias("size"),
            F.filter(two, lambda r: r < n).alias("replicas"),
        )

    @property
    def regions(self) -> DataFrame:
        """``region_id, table_name, server_id, size, hfiles, mtime``."""
        item = self.table("lineitem")
        stored = item.groupBy("l_partkey").agg(
            F.min("l_suppkey").alias("server_id"),
            F.sum(F.col("l_quantity").cast("bigint") * 1048576).alias("size"),
            F.countDistinct("l_orderkey").alias("hfiles"),
            F.max("l_shipdate").alias("mtime"),
        )
        part = self.table("part").select(F.col("p_partkey").alias("region_id"), F.col("p_brand").alias("table_name"))
        return part.join(stored, part.region_id == stored.l_partkey, "left").select(
            "region_id",
            "table_name",
            F.coalesce("server_id", F.lit(1)).cast("bigint").alias("server_id"),
            F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
            F.coalesce("hfiles", F.lit(0)).cast("bigint").alias("hfiles"),
            "mtime",
        )

    @property
    def ranges(self) -> DataFrame:
        """``region_id, table_name, start_pos, end_pos``: contiguous key ranges of each table."""
        part = self.table("part")
        w = Window.partitionBy("p_brand").orderBy("p_partkey")
        wide = "decimal(21,0)"
        return part.select(
            F.col("p_partkey").alias("region_id"),
            F.col("p_brand").alias("table_name"),
            F.when(F.row_number().over(w) == 1, F.lit(0).cast(wide)).otherwise(F.col("p_partkey").cast(wide)).alias("start_pos"),
            F.coalesce(F.lead("p_partkey").over(w).cast(wide), F.lit(KEY_SPACE_END).cast(wide)).alias("end_pos"),
        )

    @property
    def assignments(self) -> DataFrame:
        """``region_id, table_name, size, old_server, server_id``: a tenth of the regions moved on by one server."""
        n = self.n_servers
        moved = F.when(F.col("region_id") % 10 == 0, F.lit(1)).otherwise(F.lit(0))
        return self.regions.select(
            "region_id",
            "table_name",
            "size",
            F.col("server_id").alias("old_server"),
            ((F.col("server_id") + moved) % n).cast("bigint").alias("server_id"),
        )

    @property
    def row_keys(self) -> DataFrame:
        """``row`` as binary ``yyyy-MM-dd``: one cell a row."""
        return self.table("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").cast("binary").alias("row"))

    @property
    def requests(self) -> DataFrame:
        """``server, ts, ok``."""
        e = self.table("events")
        return e.select((F.col("user_id") % 10).alias("server"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))


#: The same tables as common table expressions for the SQL that queries are compared with.
CLUSTER_SQL = """
n AS (SELECT count(*) AS n FROM supplier),
servers AS (SELECT s_suppkey AS server_id, s_name AS hostname FROM supplier),
metrics AS (SELECT s_suppkey AS server_id, 5.0 + s_suppkey % 7 AS p75_read_latency FROM supplier),
blocks AS (
  SELECT l_partkey AS region_id, l_orderkey AS file_id, CAST(trunc(l_quantity) AS BIGINT) * 1048576 AS size, l_suppkey AS r1, l_suppkey + 1 AS r2
  FROM lineitem
),
stored AS (
  SELECT region_id, CAST(sum(size) AS BIGINT) AS size, count(DISTINCT file_id) AS hfiles, min(r1) AS server_id FROM blocks GROUP BY region_id
),
times AS (SELECT l_partkey AS region_id, max(l_shipdate) AS mtime FROM lineitem GROUP BY l_partkey),
regions AS (
  SELECT p_partkey AS region_id, p_brand AS table_name, coalesce(stored.server_id, 1) AS server_id, coalesce(stored.size, 0) AS size,
         coalesce(stored.hfiles, 0) AS hfiles, mtime
  FROM part LEFT JOIN stored ON stored.region_id = p_partkey LEFT JOIN times ON times.region_id = p_partkey
),
assignments AS (
  SELECT region_id, table_name, size, server_id AS old_server,
         (server_id + CASE WHEN region_id % 10 = 0 THEN 1 ELSE 0 END) % (SELECT n FROM n) AS server_id
  FROM regions
),
ranges AS (
  SELECT p_partkey AS region_id, p_brand AS table_name,
         CAST(CASE WHEN row_number() OVER w = 1 THEN 0 ELSE p_partkey END AS DECIMAL(21,0)) AS start_pos,
         coalesce(CAST(lead(p_partkey) OVER w AS DECIMAL(21,0)), CAST('18446744073709551615' AS DECIMAL(21,0))) AS end_pos
  FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)
)"""
