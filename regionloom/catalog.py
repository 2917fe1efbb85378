"""The queries that the library registers, with the SQL they are compared with.

Doubles are rounded to nine digits on both sides, since the engines add in
different orders.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import keys as K
from .functions import regions as R
from .operators import annotate, cost, keycount, report, sketches
from .plans import balance as search
from .plans import compaction, merge, moves
from .sources import files, tables
from .sources.testdata import CLUSTER_SQL, Cluster
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its name, with the SQL it is compared with."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def cluster_sql(body: str, more: str = "") -> str:
    """SQL over the cluster's tables."""
    return f"WITH {CLUSTER_SQL}{more}\n{body}"


def rounded(c: str | Column) -> Column:
    return F.round(c, 9)


# -- masked key counts and key ranges ---------------------------------------------------------------------------------

_ROW_KEY = "strftime(o_orderdate, '%Y-%m-%d')"


def _key_count(spark: SparkSession, sf_dir: str, mask: bytes, start: bytes = b"", stop: bytes = b"") -> DataFrame:
    counts = keycount.group_key_count(Cluster(spark, sf_dir).row_keys, mask, start=start, stop=stop, one_cell_a_row=True)
    return counts.select(F.decode("row_key", "UTF-8").alias("row_key"), "n_rows")


@query(f"SELECT substr({_ROW_KEY}, 1, 4) AS row_key, count(*) AS n_rows FROM orders GROUP BY 1")
def group_key_count_year(spark, sf_dir):
    return _key_count(spark, sf_dir, b"\xff" * 4)


@query(f"SELECT substr({_ROW_KEY}, 1, 7) AS row_key, count(*) AS n_rows FROM orders GROUP BY 1")
def group_key_count_month(spark, sf_dir):
    return _key_count(spark, sf_dir, b"\xff" * 7)


@query(f"SELECT hex(encode(substr({_ROW_KEY}, 1, 2))) || '00' || hex(encode(substr({_ROW_KEY}, 4, 1))) AS row_key, count(*) AS n_rows FROM orders GROUP BY 1")
def group_key_count_masked(spark, sf_dir):
    counts = keycount.group_key_count(Cluster(spark, sf_dir).row_keys, b"\xff\xff\x00\xff", one_cell_a_row=True)
    return counts.select(F.hex("row_key").alias("row_key"), "n_rows")


@query(f"SELECT substr({_ROW_KEY}, 1, 7) AS row_key, count(*) AS n_rows FROM orders WHERE {_ROW_KEY} >= '1996-03' AND {_ROW_KEY} < '1998' GROUP BY 1")
def key_range_scan(spark, sf_dir):
    return _key_count(spark, sf_dir, b"\xff" * 7, b"1996-03", b"1998")


@query(f"SELECT {_ROW_KEY} AS row_key, count(*) AS n_rows FROM (SELECT DISTINCT o_orderdate FROM orders) GROUP BY 1")
def group_key_count_distinct_rows(spark, sf_dir):
    counts = keycount.group_key_count(Cluster(spark, sf_dir).row_keys, b"\xff" * 10)
    return counts.select(F.decode("row_key", "UTF-8").alias("row_key"), "n_rows")


@query(cluster_sql("SELECT region_id, CAST(start_pos AS VARCHAR) AS start_pos, CAST(end_pos AS VARCHAR) AS end_pos FROM ranges"))
def key_positions(spark, sf_dir):
    """Range ends by way of eight-byte keys: encoded to binary and read back as unsigned numbers."""
    r = Cluster(spark, sf_dir).ranges

    def key(pos: str, is_open: Column) -> Column:
        eight = F.unhex(F.lpad(F.hex(F.col(pos).cast("bigint")), 16, "0"))
        return F.when(is_open, F.lit(b"")).otherwise(eight)

    last = F.col("end_pos") == F.lit(K.KEY_SPACE_END).cast("decimal(21,0)")
    bounded = r.withColumn("e", F.when(last, F.lit(0).cast("decimal(21,0)")).otherwise(F.col("end_pos")))
    return bounded.select(
        "region_id",
        K.range_start(key("start_pos", F.col("start_pos") == 0)).cast("string").alias("start_pos"),
        K.range_end(key("e", last)).cast("string").alias("end_pos"),
    )


# -- reports ----------------------------------------------------------------------------------------------------------

_ANNOTATED_SQL = """,
transfers AS (
  SELECT b.region_id, r.server_id, sum(CASE WHEN r.server_id = r1 OR (r.server_id = r2 AND r2 < (SELECT n FROM n)) THEN 0 ELSE b.size END) AS transfer
  FROM blocks b JOIN regions r ON r.region_id = b.region_id GROUP BY ALL
),
annotated AS (
  SELECT r.*, coalesce(t.transfer, 0) AS transfer,
         CASE WHEN r.size > 0 THEN p75_read_latency / sum(r.size) OVER (PARTITION BY r.server_id) * r.size ELSE 0 END AS load
  FROM regions r LEFT JOIN transfers t USING (region_id) JOIN metrics m ON m.server_id = r.server_id
)"""


def annotated(c: Cluster) -> DataFrame:
    return annotate.load_weights(annotate.with_transfer(c.regions, c.blocks), c.metrics)


def _report_sql(key: str) -> str:
    return cluster_sql(
        """
        SELECT key, n_regions, round(load_share, 9) AS load_share, total_size, p50, p95, round(locality, 9) AS locality FROM (
          SELECT key, count(*) AS n_regions, sum(load) / (SELECT sum(load) FROM keyed) AS load_share, CAST(sum(size) AS BIGINT) AS total_size,
                 max(CASE WHEN i = n // 2 THEN size END) AS p50, max(CASE WHEN i = n * 95 // 100 THEN size END) AS p95,
                 CASE WHEN sum(size) > 0 THEN 1 - sum(transfer) / sum(size) ELSE 1 END AS locality
          FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM keyed) GROUP BY key
        )""",
        _ANNOTATED_SQL + f",\nkeyed AS (SELECT {key} AS key, * FROM annotated)",
    )


def _report(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    rows = annotated(Cluster(spark, sf_dir)).withColumn("k", key)
    return report.region_report(rows, "k").withColumn("load_share", rounded("load_share")).withColumn("locality", rounded("locality"))


@query(_report_sql("table_name"))
def region_report_by_table(spark, sf_dir):
    return _report(spark, sf_dir, F.col("table_name"))


@query(_report_sql("server_id"))
def region_report_by_server(spark, sf_dir):
    return _report(spark, sf_dir, F.col("server_id"))


@query(_report_sql("region_id"))
def region_report_by_region(spark, sf_dir):
    return _report(spark, sf_dir, F.col("region_id"))


@query(_report_sql("table_name || ', ' || region_id"))
def region_report_by_table_region(spark, sf_dir):
    return _report(spark, sf_dir, F.concat_ws(", ", "table_name", F.col("region_id").cast("string")))


@query(
    cluster_sql("""
    SELECT table_name AS key, CASE WHEN s < 2048 THEN CAST(s AS VARCHAR) WHEN s < 1048576 THEN (s // 1024) || ' KB' WHEN s < 1073741824 THEN (s // 1048576) || ' MB'
      WHEN s < 1099511627776 THEN (s // 1073741824) || ' GB' ELSE (s // 1099511627776) || ' TB' END AS shown
    FROM (SELECT table_name, CAST(sum(size) AS BIGINT) AS s FROM regions GROUP BY 1)""")
)
def report_sizes_rendered(spark, sf_dir):
    sums = Cluster(spark, sf_dir).regions.groupBy("table_name").agg(F.sum("size").alias("s"))
    return sums.select(F.col("table_name").alias("key"), R.pretty_bytes(F.col("s")).alias("shown"))


def _pretty_sql(c: str) -> str:
    units = "".join(f" WHEN {c} < {1 << power + 10} THEN ({c} // {1 << power}) || ' {unit}'" for power, unit in ((10, "KB"), (20, "MB"), (30, "GB")))
    return f"CASE WHEN {c} < 2048 THEN CAST({c} AS VARCHAR){units} ELSE ({c} // {1 << 40}) || ' TB' END"


@query(
    f"""SELECT key, printf('%-40s %8d %7.3f %10s %10s %10s %7.3f', key, n_regions, load_share, {_pretty_sql("total_size")}, {_pretty_sql("p50")}, {_pretty_sql("p95")}, locality) AS line
    FROM ({_report_sql("table_name")})"""
)
def report_rendered(spark, sf_dir):
    """The report's lines of fixed width."""
    return report.rendered(report.region_report(annotated(Cluster(spark, sf_dir)), "table_name"))


@query(cluster_sql("SELECT region_id, round(load, 9) AS load FROM annotated", _ANNOTATED_SQL))
def region_load_weight(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return annotate.load_weights(c.regions, c.metrics).select("region_id", rounded("load").alias("load"))


@query(cluster_sql("SELECT region_id, round(CASE WHEN size = 0 THEN 1 ELSE (size - transfer) / size END, 9) AS locality, CAST(transfer AS BIGINT) AS transfer FROM annotated", _ANNOTATED_SQL))
def region_locality(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    r = annotate.with_transfer(c.regions, c.blocks)
    return r.select("region_id", rounded(R.locality(F.col("size"), F.col("transfer"))).alias("locality"), "transfer")


@query(cluster_sql("SELECT region_id, round(CASE WHEN size = 0 THEN 1 ELSE (size - transfer) / size END, 9) AS locality FROM annotated", _ANNOTATED_SQL))
def region_locality_nested(spark, sf_dir):
    """The same from nested storage: an array of files of blocks per region."""
    c = Cluster(spark, sf_dir)
    nested = (
        c.blocks.groupBy("region_id", "file_id")
        .agg(F.collect_list(F.struct("size", "replicas")).alias("hdfsBlockInfos"))
        .groupBy("region_id")
        .agg(F.collect_list(F.struct("hdfsBlockInfos")).alias("storage"))
    )
    r = c.regions.join(nested, "region_id", "left")
    return r.select("region_id", rounded(R.locality(F.col("size"), R.storage_transfer(F.col("storage"), F.col("server_id")))).alias("locality"))


@query(cluster_sql("SELECT region_id, hfiles FROM regions"))
def hfile_count(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    nested = c.blocks.groupBy("region_id").agg(F.collect_set("file_id").alias("storage"))
    return c.regions.select("region_id").join(nested, "region_id", "left").select("region_id", R.file_count(F.col("storage")).cast("bigint").alias("hfiles"))


@query(cluster_sql("SELECT count(*) AS n_servers, count(*) FILTER (WHERE s.server_id NOT IN (SELECT server_id FROM regions)) AS n_empty_servers, (SELECT count(*) FROM regions) AS n_regions FROM servers s"))
def cluster_totals(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return annotate.totals(c.regions, c.servers)


@query(
    "SELECT o_custkey AS region_path, CAST(sum(CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderkey ELSE 0 END) AS BIGINT) AS size, max(o_orderkey) AS modification_time "
    "FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 0, -9223372036854775808 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"
)
def file_size_and_time(spark, sf_dir):
    """Orders as files below their customer's directory."""
    c = Cluster(spark, sf_dir)
    listing = c.table("orders").select(
        F.col("o_custkey").alias("region_path"), F.col("o_orderkey").alias("length"), F.col("o_orderkey").alias("modification_time"), (~F.col("o_orderpriority").startswith("5")).alias("visible")
    )
    known = c.table("customer").select(F.col("c_custkey").alias("region_path")).unionByName(listing.select("region_path")).distinct()
    return annotate.file_stats(known, listing)


# -- costs ------------------------------------------------------------------------------------------------------------


def placement(c: Cluster, **options) -> cost.Placement:
    a = c.assignments
    load = annotate.load_weights(c.regions, c.metrics).select("region_id", "load")
    return cost.Placement(a.join(load, "region_id"), c.servers, c.blocks, c.ranges, **options)


_UNEVEN = "CASE WHEN count(*) = 0 OR avg(v) = 0 THEN 0 ELSE 1 - exp(-stddev_pop(v) / avg(v)) END"

_COST_SQL = _ANNOTATED_SQL + """,
placed AS (SELECT a.*, n.load FROM assignments a JOIN annotated n USING (region_id)),
moved_bytes AS (
  SELECT sum(CASE WHEN a.server_id = r1 OR (a.server_id = r2 AND r2 < (SELECT n FROM n)) THEN 0 ELSE b.size END) AS t FROM blocks b JOIN assignments a USING (region_id)
),
ends AS (
  SELECT server_id, table_name, unnest([start_pos, end_pos]) AS k FROM assignments a JOIN ranges r USING (region_id, table_name)
),
gaps AS (
  SELECT server_id, table_name, CASE WHEN count(*) < 4 THEN 0 ELSE coalesce(sum(g), 0) END AS gaps FROM (
    SELECT server_id, table_name,
           CASE WHEN row_number() OVER w >= 3 THEN 1 / (1 + CAST(abs(k - lag(k) OVER w) AS DOUBLE)) END AS g
    FROM ends WINDOW w AS (PARTITION BY server_id, table_name ORDER BY k)) GROUP BY ALL
),
server_gaps AS (
  SELECT server_id, CASE WHEN count(*) < 4 THEN 0 ELSE coalesce(sum(g), 0) END AS gaps FROM (
    SELECT server_id, CASE WHEN row_number() OVER w >= 3 THEN 1 / (1 + CAST(abs(k - lag(k) OVER w) AS DOUBLE)) END AS g
    FROM ends WINDOW w AS (PARTITION BY server_id ORDER BY k)) GROUP BY ALL
),
per_server AS (
  SELECT s.server_id, coalesce(sum(size), 0) AS size, coalesce(sum(load), 0) AS load, count(region_id) AS n
  FROM servers s LEFT JOIN placed p ON p.server_id = s.server_id GROUP BY 1
),
size_cost AS (SELECT %(u)s AS c FROM (SELECT CAST(size AS DOUBLE) AS v FROM per_server)),
load_cost AS (SELECT %(u)s AS c FROM (SELECT load AS v FROM per_server)),
count_cost AS (SELECT %(u)s AS c FROM (SELECT CAST(n AS DOUBLE) AS v FROM per_server)),
locality_cost AS (SELECT (SELECT t FROM moved_bytes) / sum(size) AS c FROM assignments),
table_cost AS (SELECT avg(u) AS c FROM (SELECT table_name, %(u)s AS u FROM (SELECT table_name, server_id, CAST(sum(size) AS DOUBLE) AS v FROM assignments GROUP BY ALL) GROUP BY 1)),
key_cost AS (SELECT pow((SELECT sum(gaps) FROM gaps) / count(*), 0.3) AS c FROM assignments),
transition_cost AS (
  SELECT CASE WHEN sum(m) < 750 THEN 0.001 ELSE 1 END * sqrt(sum(m) / count(*)) AS c FROM (SELECT CASE WHEN old_server <> server_id THEN 1 ELSE 0 END AS m FROM assignments)
),
migration_cost AS (SELECT CAST(count(*) FILTER (WHERE server_id NOT IN (0, 1, 2)) AS DOUBLE) AS c FROM assignments),
breakdown AS (
  SELECT 'DataSizeCost' AS function, CAST(1000 AS DOUBLE) AS weight, c FROM size_cost UNION ALL SELECT 'ProximateRegionKeyCost', 5.0, c FROM key_cost
  UNION ALL SELECT 'LocalityCost', 75.0, c FROM locality_cost UNION ALL SELECT 'TransitionCost', 2000.0, c FROM transition_cost
),
server_cost AS (
  SELECT p.server_id, (1000.0 + 75.0) * p.size / (SELECT avg(size) FROM per_server) + 5.0 * CASE WHEN p.n = 0 THEN 0 ELSE pow(coalesce(g.gaps, 0) / p.n, 0.3) END AS c
  FROM per_server p LEFT JOIN server_gaps g USING (server_id)
)""" % {"u": _UNEVEN}  # fmt: skip


def _cost_query(name: str, function: str, table: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cost.COSTS[function](placement(Cluster(spark, sf_dir), **options)).select(rounded("cost").alias("cost"))

    run.__name__ = name
    query(cluster_sql(f"SELECT round(c, 9) AS cost FROM {table}", _COST_SQL))(run)


_cost_query("cost_data_size", "DataSizeCost", "size_cost")
_cost_query("cost_load", "LoadCost", "load_cost")
_cost_query("cost_region_count", "RegionCountCost", "count_cost")
_cost_query("cost_locality", "LocalityCost", "locality_cost")
_cost_query("cost_table_balance", "TableDataBalanceCost", "table_cost")
_cost_query("cost_key_proximity", "ProximateRegionKeyCost", "key_cost")
_cost_query("cost_transition", "TransitionCost", "transition_cost")
_cost_query("cost_migration", "MigrationCost", "migration_cost", targets=(0, 1, 2))


@query(cluster_sql("SELECT function, CAST(weight AS DOUBLE) AS weight, round(c, 9) AS cost, round(weight * c, 6) AS weighted_cost FROM breakdown", _COST_SQL))
def cost_breakdown(spark, sf_dir):
    return cost.cost_breakdown(placement(Cluster(spark, sf_dir))).select("function", "weight", rounded("cost").alias("cost"), F.round("weighted_cost", 6).alias("weighted_cost"))


@query(cluster_sql("SELECT round(sum(weight * c), 6) AS cost FROM breakdown", _COST_SQL))
def cost_combined(spark, sf_dir):
    return cost.combined_cost(placement(Cluster(spark, sf_dir))).select(F.round("cost", 6).alias("cost"))


@query(cluster_sql("SELECT server_id, round(c, 6) AS cost FROM server_cost", _COST_SQL))
def server_cost_combined(spark, sf_dir):
    return cost.combined_server_cost(placement(Cluster(spark, sf_dir))).select("server_id", F.round("cost", 6).alias("cost"))


@query(
    cluster_sql(
        """
    SELECT s.server_id, round(coalesce(avg(h.b / m.mean), 0), 9) AS cost
    FROM servers s LEFT JOIN (SELECT table_name, server_id, sum(size) AS b FROM assignments GROUP BY ALL) h ON h.server_id = s.server_id
    LEFT JOIN (SELECT table_name, sum(size) / (SELECT n FROM n) AS mean FROM assignments GROUP BY 1) m ON m.table_name = h.table_name AND m.mean > 0 GROUP BY 1"""
    )
)
def server_cost_table_balance(spark, sf_dir):
    return cost.server_table_cost(placement(Cluster(spark, sf_dir))).select("server_id", rounded("cost").alias("cost"))


def _server_cost_query(name: str, function: str, expression: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cost.SERVER_COSTS[function](placement(Cluster(spark, sf_dir), **options)).select("server_id", rounded("cost").alias("cost"))

    run.__name__ = name
    query(cluster_sql(f"SELECT p.server_id, round(CAST({expression} AS DOUBLE), 9) AS cost FROM per_server p LEFT JOIN server_gaps g USING (server_id)", _COST_SQL))(run)


_server_cost_query("server_cost_data_size", "DataSizeCost", "p.size / (SELECT avg(size) FROM per_server)")
_server_cost_query("server_cost_load", "LoadCost", "p.load / (SELECT avg(load) FROM per_server)")
_server_cost_query("server_cost_region_count", "RegionCountCost", "p.n / (SELECT avg(n) FROM per_server)")
_server_cost_query("server_cost_locality", "LocalityCost", "p.size / (SELECT avg(size) FROM per_server)")
_server_cost_query("server_cost_key_proximity", "ProximateRegionKeyCost", "CASE WHEN p.n = 0 THEN 0 ELSE pow(coalesce(g.gaps, 0) / p.n, 0.3) END")
_server_cost_query("server_cost_transition", "TransitionCost", "0")
_server_cost_query("server_cost_migration", "MigrationCost", "CASE WHEN server_id IN (0, 1, 2) THEN 0 ELSE p.n END", targets=(0, 1, 2))


@query(cluster_sql("SELECT server_id, round(CASE WHEN server_id NOT IN (0, 1, 2) THEN c + (SELECT max(c) FROM server_cost) + 1 ELSE c END, 6) AS cost FROM server_cost", _COST_SQL))
def migration_elevated_cost(spark, sf_dir):
    return cost.elevated_server_cost(placement(Cluster(spark, sf_dir), targets=(0, 1, 2))).select("server_id", F.round("cost", 6).alias("cost"))


@query(
    cluster_sql(
        "SELECT (SELECT server_id FROM server_cost ORDER BY c DESC, server_id LIMIT 1) AS from_server, (SELECT server_id FROM server_cost ORDER BY c, server_id LIMIT 1) AS to_server", _COST_SQL
    )
)
def greedy_move_servers(spark, sf_dir):
    return moves.heaviest_to_lightest(cost.combined_server_cost(placement(Cluster(spark, sf_dir))))


# -- move plans -------------------------------------------------------------------------------------------------------

_MOVED = "SELECT region_id, old_server AS from_server, server_id AS to_server FROM assignments WHERE old_server <> server_id"


@query(cluster_sql(_MOVED))
def transition_diff(spark, sf_dir):
    return moves.transitions(Cluster(spark, sf_dir).assignments)


@query(cluster_sql("SELECT region_id, table_name, old_server AS from_server, server_id AS to_server, size FROM assignments WHERE old_server <> server_id"))
def transition_report(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return moves.transition_report(moves.transitions(c.assignments), c.regions)


@query(cluster_sql(f"SELECT * EXCLUDE (n), n // 75 AS minute, greatest(n - 4, 0) AS after_completions FROM (SELECT *, row_number() OVER (ORDER BY region_id) - 1 AS n FROM ({_MOVED}))"))
def move_schedule(spark, sf_dir):
    return moves.schedule(moves.transitions(Cluster(spark, sf_dir).assignments), 75, 5)


@query(cluster_sql(f"SELECT count(*) AS in_flight, count(*) < 5 AS room FROM (SELECT region_id FROM ({_MOVED}) INTERSECT SELECT region_id FROM regions WHERE region_id % 20 = 0)"))
def transition_room(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return moves.transition_room(moves.transitions(c.assignments), c.regions.where("region_id % 20 = 0"), 5)


@query(
    cluster_sql(
        f"""
    SELECT m.region_id, from_server, to_server, CASE WHEN a.size = 0 THEN 1 ELSE 1 - t.away / a.size END <= 0.3 AS compact
    FROM ({_MOVED}) m JOIN regions a USING (region_id) LEFT JOIN (
      SELECT b.region_id, sum(CASE WHEN to_server = r1 OR (to_server = r2 AND r2 < (SELECT n FROM n)) THEN 0 ELSE b.size END) AS away
      FROM blocks b JOIN ({_MOVED}) k USING (region_id) GROUP BY 1) t ON t.region_id = m.region_id"""
    )
)
def compaction_after_moves(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return moves.compacted_after(moves.transitions(c.assignments), c.regions, c.blocks, 0.3)


@query("SELECT CAST(600000 * 75 // 60000 AS BIGINT) AS budget, CAST(600000 * 10 // 60000 AS BIGINT) AS slow_budget")
def transition_budgets(spark, sf_dir):
    return spark.range(1).select(F.lit(moves.transition_budget()).cast("bigint").alias("budget"), F.lit(moves.transition_budget(per_minute=10)).cast("bigint").alias("slow_budget"))


@query(cluster_sql(f"SELECT region_id FROM ({_MOVED}) INTERSECT SELECT region_id FROM regions WHERE region_id % 20 = 0"))
def moves_in_transition(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return moves.moves_in_transition(moves.transitions(c.assignments), c.regions.where("region_id % 20 = 0"))


@query(cluster_sql("SELECT server_id, count(*) AS n_regions, CAST(1 AS BIGINT) AS n_picked, CAST(1 AS BIGINT) AS n_own, true AS same_again, count(*) = 1 AS only_one FROM regions GROUP BY 1"))
def random_region_per_server(spark, sf_dir):
    """Seeded picks of a region per server: one for each, its own, the same again; over 40 seeds a server of several shows several."""
    r = Cluster(spark, sf_dir).regions
    held = r.groupBy("server_id").agg(F.count("*").alias("n_regions"))
    picked, again = (moves.pick_one(r, ["server_id"], "region_id", seed=3) for _ in range(2))
    own = r.select("region_id", F.col("server_id").alias("on"))
    back = picked.join(own, "region_id").join(again.select("server_id", F.col("region_id").alias("again")), "server_id")
    told = back.groupBy("server_id").agg(
        F.count("*").alias("n_picked"), F.count_if(F.col("on") == F.col("server_id")).alias("n_own"), F.bool_and(F.col("again") == F.col("region_id")).alias("same_again")
    )
    drawn = moves.pick_one(r, ["server_id"], "region_id", seed=0)
    for seed in range(1, 40):
        drawn = drawn.unionByName(moves.pick_one(r, ["server_id"], "region_id", seed=seed))
    drawn = drawn.groupBy("server_id").agg((F.countDistinct("region_id") == 1).alias("only_one"))
    return told.join(held, "server_id").join(drawn, "server_id")


@query(
    cluster_sql("""
    SELECT l.region_id, l.from_server, o.to_server FROM (
      SELECT region_id, server_id AS from_server, (row_number() OVER (ORDER BY region_id) - 1) % (SELECT n - 3 FROM n) AS turn FROM regions WHERE server_id IN (0, 1, 2)) l
    JOIN (SELECT server_id AS to_server, row_number() OVER (ORDER BY server_id) - 1 AS turn FROM servers WHERE server_id NOT IN (0, 1, 2)) o USING (turn)""")
)
def plan_graceful_shutdown(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return moves.drain(c.regions, c.servers, (0, 1, 2))


_LOAD_SQL = """,
target AS (SELECT CAST(5 AS BIGINT) AS t),
localities AS (
  SELECT b.region_id,
         sum(CASE WHEN r.server_id = r1 OR (r.server_id = r2 AND r2 < (SELECT n FROM n)) THEN 0 ELSE b.size END) AS here,
         sum(CASE WHEN 5 = r1 OR (5 = r2 AND r2 < (SELECT n FROM n)) THEN 0 ELSE b.size END) AS there
  FROM blocks b JOIN regions r USING (region_id) GROUP BY 1
),
ranked AS (
  SELECT r.*, CASE WHEN size = 0 THEN 1 ELSE (size - coalesce(there, 0)) / size END AS tl, CASE WHEN size = 0 THEN 1 ELSE (size - coalesce(here, 0)) / size END AS cl
  FROM regions r LEFT JOIN localities USING (region_id) WHERE server_id <> 5
),
even AS (SELECT (SELECT count(*) FROM regions) // (SELECT n FROM n) AS e)"""

_LOAD_ORDER = "tl DESC, cl, mtime NULLS FIRST, region_id"


@query(
    cluster_sql(
        f"""
    SELECT region_id, server_id AS from_server, (SELECT t FROM target) AS to_server FROM (
      SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY {_LOAD_ORDER}) AS k, count(*) OVER (PARTITION BY server_id) AS held FROM ranked)
    WHERE k <= held - (SELECT e FROM even) ORDER BY {_LOAD_ORDER} LIMIT (SELECT e FROM even)""",
        _LOAD_SQL,
    )
)
def plan_graceful_load(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return moves.load(c.regions, c.servers, c.blocks, 5)


@query(cluster_sql(f"SELECT region_id, server_id AS from_server, (SELECT t FROM target) AS to_server FROM ranked ORDER BY {_LOAD_ORDER} LIMIT (SELECT e FROM even)", _LOAD_SQL))
def plan_graceful_load_most_local(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return moves.load(c.regions, c.servers, c.blocks, 5, most_local=True)


@query(cluster_sql("SELECT region_id, server_id AS from_server, CAST(5 AS BIGINT) AS to_server FROM regions WHERE server_id = 3"))
def plan_graceful_load_source(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return moves.load(c.regions, c.servers, c.blocks, 5, source=3)


@query(cluster_sql("SELECT region_id, server_id AS from_server, CAST(5 AS BIGINT) AS to_server FROM regions WHERE region_id % 7 = 0 AND server_id <> 5"))
def plan_graceful_load_listed(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    return moves.load(c.regions, c.servers, c.blocks, 5, listed=c.regions.where("region_id % 7 = 0").select("region_id"))


# -- compaction -------------------------------------------------------------------------------------------------------


def _compaction_sql(where: str, ties: str) -> str:
    return cluster_sql(
        f"SELECT server_id, row_number() OVER (PARTITION BY server_id ORDER BY transfer DESC, {ties}, region_id) AS position, region_id, CAST(transfer AS BIGINT) AS transfer FROM annotated WHERE {where}",
        _ANNOTATED_SQL,
    )


_LOCAL = "CASE WHEN size = 0 THEN 1 ELSE (size - transfer) / size END"


def _compaction(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    c = Cluster(spark, sf_dir)
    return compaction.compaction_plan(annotate.with_transfer(c.regions, c.blocks), **options).withColumn("position", F.col("position").cast("bigint"))


@query(_compaction_sql(f"lower(table_name) = 'brand#11' AND {_LOCAL} <= 0.5", "hfiles DESC"))
def plan_compaction(spark, sf_dir):
    return _compaction(spark, sf_dir, table="BRAND#11", threshold=0.5)


@query(_compaction_sql("true", "mtime NULLS FIRST"))
def plan_compaction_reverse_locality(spark, sf_dir):
    return _compaction(spark, sf_dir, reverse_locality=True)


@query(_compaction_sql("server_id IN (1, 2, 3)", "hfiles DESC"))
def plan_major_compact_servers(spark, sf_dir):
    return _compaction(spark, sf_dir, servers=(1, 2, 3))


_ASKED = _compaction_sql("true", "hfiles DESC")


@query(
    f"SELECT server_id, position, region_id, transfer, 'major' AS kind, greatest(position - 2, 0) AS after_completions, position * 5 AS earliest_second FROM ({_ASKED})"
)
def compaction_throttle(spark, sf_dir):
    return compaction.throttled(_compaction(spark, sf_dir), queue_size=2, quiet_seconds=5)


@query(cluster_sql("SELECT region_id, server_id FROM regions WHERE region_id % 11 <> 0"))
def regions_not_listed(spark, sf_dir):
    r = Cluster(spark, sf_dir).regions
    return compaction.not_listed(r, r.where("region_id % 11 = 0").select("region_id")).select("region_id", "server_id")


@query(cluster_sql("SELECT region_id, true AS known FROM regions WHERE region_id % 11 = 0 UNION ALL SELECT -region_id, false FROM regions WHERE region_id % 11 = 0 AND region_id > 0"))
def listed_regions(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    some = c.regions.where("region_id % 11 = 0").select("region_id")
    known, unknown = compaction.listed_regions(c.regions, some.unionByName(some.where("region_id > 0").select((-F.col("region_id")).alias("region_id"))))
    return known.select("region_id", F.lit(True).alias("known")).unionByName(unknown.select("region_id", F.lit(False).alias("known")))


@query("SELECT DISTINCT p_brand AS table_name, 'snapshot-1700000000000-' || p_brand AS snapshot FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')")
def flush_and_snapshot(spark, sf_dir):
    brands = Cluster(spark, sf_dir).regions.select("table_name").distinct()
    return compaction.snapshot_names(compaction.flush_plan(brands, "Brand#11,Brand#12, Brand#13"), 1_700_000_000_000)


# -- merges -----------------------------------------------------------------------------------------------------------


def _sized_ranges(c: Cluster) -> DataFrame:
    return c.ranges.join(c.regions.select("region_id", "size"), "region_id")


@query(cluster_sql("SELECT region_id, table_name, coalesce(lead(start_pos) OVER (PARTITION BY table_name ORDER BY start_pos) = end_pos, true) AS contiguous FROM ranges"))
def merge_contiguity(spark, sf_dir):
    return merge.contiguity(Cluster(spark, sf_dir).ranges).select("region_id", "table_name", "contiguous")


_HALF = 250 * 1048576 * 8

_MERGE_SQL = cluster_sql(
    f"""
    SELECT table_name, string_agg(CAST(region_id AS VARCHAR), ',' ORDER BY rn) AS region_ids, count(*) AS n FROM walk GROUP BY table_name, g HAVING count(*) >= 2""",
    f""",
ordered AS (SELECT g.table_name, g.region_id, r.size, row_number() OVER (PARTITION BY g.table_name ORDER BY start_pos) AS rn FROM ranges g JOIN regions r USING (region_id)),
walk AS (
  SELECT table_name, region_id, rn, 1 AS g, 1 AS k, size AS acc, (size >= {_HALF // 2}) AS full FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.table_name, o.region_id, o.rn, w.g + CASE WHEN w.full THEN 1 ELSE 0 END, CASE WHEN w.full THEN 1 ELSE w.k + 1 END,
         CASE WHEN w.full THEN o.size ELSE w.acc + o.size END,
         CASE WHEN w.full THEN o.size >= {_HALF // 2} ELSE (w.k + 1 >= 3 OR w.acc + o.size >= {_HALF // 2}) END
  FROM walk w JOIN ordered o ON o.table_name = w.table_name AND o.rn = w.rn + 1
)""",
).replace("WITH ", "WITH RECURSIVE ", 1)


def _told_groups(groups: DataFrame) -> DataFrame:
    return groups.select("table_name", F.array_join(F.transform("region_ids", lambda r: r.cast("string")), ",").alias("region_ids"), F.size("region_ids").cast("bigint").alias("n"))


@query(_MERGE_SQL)
def merge_full_table(spark, sf_dir):
    return _told_groups(merge.merge_groups(_sized_ranges(Cluster(spark, sf_dir)), factor=3, max_file_size=_HALF))


def _with_empty(c: Cluster) -> DataFrame:
    """Ranges of which some are empty: every third, and by brand's position a run of them."""
    r = _sized_ranges(c)
    return r.withColumn("size", F.when(F.col("region_id") % 3 == 0, F.lit(0)).otherwise(F.col("size") + 1))


_EMPTY_SQL = cluster_sql(
    """
    SELECT table_name, groups AS region_ids, len(string_split(groups, ',')) AS n FROM (
      SELECT table_name, unnest(CASE WHEN run <> '' AND before <> '' THEN list_append(out, before || ',' || run) ELSE out END) AS groups
      FROM walk QUALIFY rn = max(rn) OVER (PARTITION BY table_name))""",
    """,
ordered AS (
  SELECT g.table_name, CAST(g.region_id AS VARCHAR) AS id, region_id % 3 = 0 AS empty, row_number() OVER (PARTITION BY g.table_name ORDER BY start_pos) AS rn FROM ranges g
),
walk AS (
  SELECT table_name, CAST(0 AS BIGINT) AS rn, CAST('' AS VARCHAR) AS run, CAST('' AS VARCHAR) AS before, CAST([] AS VARCHAR[]) AS out FROM (SELECT DISTINCT table_name FROM ordered)
  UNION ALL
  SELECT w.table_name, o.rn,
         CASE WHEN NOT o.empty THEN '' WHEN w.run = '' THEN o.id ELSE w.run || ',' || o.id END,
         CASE WHEN o.empty THEN w.before WHEN w.run <> '' AND w.before = '' THEN '' ELSE o.id END,
         CASE WHEN o.empty OR w.run = '' THEN w.out WHEN w.before <> '' THEN list_append(w.out, w.before || ',' || w.run) ELSE list_append(w.out, w.run || ',' || o.id) END
  FROM walk w JOIN ordered o ON o.table_name = w.table_name AND o.rn = w.rn + 1
)""",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_EMPTY_SQL)
def merge_empty_regions(spark, sf_dir):
    return _told_groups(merge.merge_empty_groups(_with_empty(Cluster(spark, sf_dir))))


@query(
    cluster_sql(
        """
    SELECT table_name, CAST(min(start_pos) AS VARCHAR) AS start_pos, CAST(max(end_pos) AS VARCHAR) AS end_pos, count(*) AS n_merged
    FROM (SELECT *, (row_number() OVER (PARTITION BY table_name ORDER BY start_pos) - 1) // 2 AS g FROM ranges) GROUP BY table_name, g"""
    )
)
def merged_catalog(spark, sf_dir):
    r = _sized_ranges(Cluster(spark, sf_dir))
    after = merge.merged_catalog(r, merge.merge_groups(r, factor=2, max_file_size=1 << 60))
    return after.select("table_name", F.col("start_pos").cast("string").alias("start_pos"), F.col("end_pos").cast("string").alias("end_pos"), "n_merged")


@query(
    cluster_sql(
        """
    SELECT table_name, g AS group_no, count(*) AS n_regions, CAST(sum(region_id * 3) AS BIGINT) AS reads, CAST(sum(size) AS BIGINT) AS writes
    FROM (SELECT r.*, (row_number() OVER (PARTITION BY r.table_name ORDER BY start_pos) - 1) // 2 AS g, count(*) OVER (PARTITION BY r.table_name) AS n,
                 row_number() OVER (PARTITION BY r.table_name ORDER BY start_pos) AS k FROM regions r JOIN ranges USING (region_id))
    WHERE NOT (n % 2 = 1 AND k = n) GROUP BY ALL"""
    )
)
def merged_counters(spark, sf_dir):
    """Request counters of merged regions, with stand-ins for reads and writes."""
    c = Cluster(spark, sf_dir)
    groups = merge.merge_groups(_sized_ranges(c), factor=2, max_file_size=1 << 60)
    counters = c.regions.select("table_name", "region_id", (F.col("region_id") * 3).alias("reads"), F.col("size").alias("writes"))
    return merge.merged_counters(groups, counters, ["reads", "writes"]).withColumn("group_no", F.col("group_no").cast("bigint"))


# -- scans ------------------------------------------------------------------------------------------------------------


def _catalog(c: Cluster) -> DataFrame:
    return c.regions.withColumn("table_disabled", F.col("table_name").endswith("5"))


@query(cluster_sql("SELECT region_id, server_id FROM regions WHERE table_name NOT IN ('Brand#11', 'Brand#12') AND table_name NOT LIKE '%5'"))
def disabled_table_anti(spark, sf_dir):
    c = _catalog(Cluster(spark, sf_dir))
    excluded = spark.range(1).select(F.explode(F.array(F.lit("Brand#11"), F.lit("Brand#12"))).alias("table_name"))
    return tables.catalog(c, excluded=excluded, skip_disabled=True).select("region_id", "server_id")


@query(cluster_sql("SELECT region_id, server_id FROM regions WHERE table_name = 'Brand#13'"))
def one_table_scan(spark, sf_dir):
    return tables.catalog(_catalog(Cluster(spark, sf_dir)), table="bRAND#13").select("region_id", "server_id")


@query("SELECT DISTINCT p_brand AS table_name, p_brand LIKE '%5' AS disabled FROM part")
def tables_by_state(spark, sf_dir):
    c = _catalog(Cluster(spark, sf_dir))
    off, on = tables.tables_by_state(c, True), tables.tables_by_state(c, False)
    return off.select("table_name", F.lit(True).alias("disabled")).unionByName(on.select("table_name", F.lit(False).alias("disabled")))


@query("SELECT 'host' || (s_suppkey % 7) AS hostname, max(lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS server FROM supplier GROUP BY 1")
def servers_by_host(spark, sf_dir):
    s = Cluster(spark, sf_dir).table("supplier")
    named = s.select(F.concat(F.lit("host"), (F.col("s_suppkey") % 7).cast("string")).alias("hostname"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("server"))
    return tables.servers_by_host(named)


@query("SELECT s_suppkey AS server_id, split_part(s_name || '.rack' || s_nationkey || '.example.com', '.', 1) AS host, s_suppkey IN (1, 2, 30) AS listed FROM supplier")
def host_filters(spark, sf_dir):
    s = Cluster(spark, sf_dir).table("supplier")
    full = F.concat(F.col("s_name"), F.lit(".rack"), F.col("s_nationkey").cast("string"), F.lit(".example.com"))
    return s.select(F.col("s_suppkey").alias("server_id"), R.short_host(full).alias("host"), R.listed_in(F.col("s_suppkey").cast("string"), "1,2,30").alias("listed"))


_NAME = "CASE WHEN event_id % 17 = 0 THEN '.META.,,1' WHEN event_id % 19 = 0 THEN '-ROOT-,,0' ELSE event_type || ',' || user_id || ',' || event_id || '.' || md5(CAST(event_id AS VARCHAR)) || '.' END"


def _named_events(c: Cluster) -> DataFrame:
    e = c.table("events")
    i = F.col("event_id")
    plain = F.concat(F.col("event_type"), F.lit(","), F.col("user_id").cast("string"), F.lit(","), i.cast("string"), F.lit("."), F.md5(i.cast("string").cast("binary")), F.lit("."))
    return e.withColumn("region_name", F.when(i % 17 == 0, F.lit(".META.,,1")).when(i % 19 == 0, F.lit("-ROOT-,,0")).otherwise(plain))


@query(
    f"""
    SELECT event_id, CASE WHEN name LIKE '%.META.%' THEN 'META' WHEN name LIKE '%-ROOT-%' THEN 'ROOT' ELSE split_part(name, ',', 1) END AS table_name,
           CASE WHEN name LIKE '%.META.%' OR name LIKE '%-ROOT-%' THEN NULL ELSE split_part(name, '.', 2) END AS region,
           CASE WHEN name LIKE '%.META.%' OR name LIKE '%-ROOT-%' THEN NULL ELSE split_part(name, ',', 1) || '.' || split_part(name, '.', 2) END AS label
    FROM (SELECT event_id, {_NAME} AS name FROM events)"""
)
def region_name_parse(spark, sf_dir):
    named = _named_events(Cluster(spark, sf_dir))
    table, region = R.region_table(F.col("region_name")), R.region_encoded(F.col("region_name"))
    return named.select("event_id", table.alias("table_name"), region.alias("region"), R.compact_label(table, region).alias("label"))


# -- sketches ---------------------------------------------------------------------------------------------------------


def _user_cells(c: Cluster) -> DataFrame:
    e = c.table("events")
    return e.select(F.col("event_type").alias("row"), F.lit("f").alias("family"), F.lit("q").alias("qualifier"), "user_id", F.col("event_id").alias("ts"))


def _near(estimate: Column, exact: Column) -> Column:
    """Within three standard errors of the default precision, as the only thing that holds for any data."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * 0.015)


@query("SELECT event_type AS row, count(DISTINCT user_id) AS exact, true AS near, max(event_id) AS ts FROM events GROUP BY 1")
def hll_distinct_users(spark, sf_dir):
    cells = _user_cells(Cluster(spark, sf_dir))
    exact = cells.groupBy("row").agg(F.countDistinct("user_id").alias("exact"))
    found = sketches.build_hll(cells, "user_id").select("row", F.hll_sketch_estimate("sketch").alias("estimate"), "ts")
    return found.join(exact, "row").select("row", "exact", _near(F.col("estimate"), F.col("exact")).alias("near"), "ts")


@query("SELECT event_type AS row, true AS same FROM events GROUP BY 1")
def hll_union_merge(spark, sf_dir):
    cells = _user_cells(Cluster(spark, sf_dir))
    halves = [sketches.build_hll(cells.where(F.col("ts") % 2 == k), "user_id") for k in (0, 1)]
    merged = sketches.merge_hll(*halves).select("row", F.hll_sketch_estimate("sketch").alias("m"))
    whole = sketches.build_hll(cells, "user_id").select("row", F.hll_sketch_estimate("sketch").alias("w"))
    return merged.join(whole, "row").select("row", (F.abs(F.col("m") - F.col("w")) <= F.greatest(F.lit(1.0), F.col("w") * 0.01)).alias("same"))


@query(
    "SELECT event_type AS row, count(*) FILTER (WHERE event_id % 4 = 0 AND event_type <> 'error') = 0 AS absent, max(event_id) AS ts, true AS near FROM events GROUP BY 1"
)
def hll_upsert(spark, sf_dir):
    """State from a quarter of the events without errors; the delta brings the rest."""
    cells = _user_cells(Cluster(spark, sf_dir))
    early = (F.col("ts") % 4 == 0) & (F.col("row") != "error")
    state, delta = sketches.build_hll(cells.where(early), "user_id"), sketches.build_hll(cells.where(~early), "user_id")
    after, returned = sketches.upsert_hll(state, delta)
    exact = cells.groupBy("row").agg(F.countDistinct("user_id").alias("exact"))
    joined = after.join(returned, sketches.CELL).join(exact, "row")
    return joined.select("row", (F.col("returned") == -1).alias("absent"), "ts", _near(F.hll_sketch_estimate("sketch"), F.col("exact")).alias("near"))


@query("SELECT row, family, qualifier, min(found) AS found FROM (SELECT event_type AS row, 'f' AS family, 'q' AS qualifier, true AS found FROM events UNION ALL SELECT 'no such row', 'f', 'q', false) GROUP BY ALL")
def hll_bulk_read(spark, sf_dir):
    cells = _user_cells(Cluster(spark, sf_dir))
    wanted = cells.select(*sketches.CELL).distinct().unionByName(spark.range(1).select(F.lit("no such row").alias("row"), F.lit("f").alias("family"), F.lit("q").alias("qualifier")))
    read = sketches.read_hll(sketches.build_hll(cells, "user_id"), wanted)
    return read.select(*sketches.CELL, ((F.col("estimate") > 0) & (F.col("ts") >= 0)).alias("found"))


@query("SELECT event_type AS row, 'f2' AS family, max(event_id) AS ts FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def hll_bulk_read_last_cell(spark, sf_dir):
    """Two families per row; the row's last cell in scan order answers."""
    cells = _user_cells(Cluster(spark, sf_dir))
    two = cells.withColumn("family", F.when(F.col("ts") % 2 == 0, F.lit("f2")).otherwise(F.lit("f1")))
    return sketches.read_hll_bulk(sketches.build_hll(two, "user_id"), compat=True).where("family = 'f2'").select("row", "family", "ts")


_ITEMS = "SELECT l_returnflag AS row, l_suppkey AS item, count(*) AS n FROM lineitem GROUP BY ALL"
_SHAPE = {"depth": 7, "width": 8192, "seed": 0}


def _flag_items(c: Cluster) -> DataFrame:
    return c.table("lineitem").select(F.col("l_returnflag").alias("row"), F.col("l_suppkey").alias("item"), F.col("l_quantity").cast("bigint").alias("w"), F.col("l_orderkey").alias("ts"))


def _bounded(estimates: DataFrame, exact: DataFrame) -> DataFrame:
    """Never below the exact count, and at most a two-thousandth of all above it."""
    everything = F.sum("n").over(Window.partitionBy("row"))
    return estimates.join(exact.withColumn("t", everything), ["row", "item"]).select(
        "row", "item", "n", ((F.col("estimate") >= F.col("n")) & (F.col("estimate") <= F.col("n") + F.greatest(F.lit(1.0), F.col("t") / 2000))).alias("bounded")
    )


@query(f"SELECT row, item, n, true AS bounded FROM ({_ITEMS})")
def cms_frequency(spark, sf_dir):
    items = _flag_items(Cluster(spark, sf_dir))
    state = sketches.build_cms(items, "item", keys=["row"], **_SHAPE)
    return _bounded(sketches.estimate_cms(state, items, "item", keys=["row"], **_SHAPE), items.groupBy("row", "item").agg(F.count("*").alias("n")))


@query("SELECT row, item, n, true AS bounded FROM (SELECT l_returnflag AS row, l_suppkey AS item, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY ALL)")
def cms_weighted(spark, sf_dir):
    items = _flag_items(Cluster(spark, sf_dir))
    state = sketches.build_cms(items, "item", keys=["row"], count="w", **_SHAPE)
    return _bounded(sketches.estimate_cms(state, items, "item", keys=["row"], **_SHAPE), items.groupBy("row", "item").agg(F.sum("w").alias("n")))


@query("SELECT l_returnflag AS row, true AS same FROM lineitem GROUP BY 1")
def cms_merge(spark, sf_dir):
    """Sketches of the two halves add up to the sketch of all, counter by counter."""
    items = _flag_items(Cluster(spark, sf_dir))
    halves = [sketches.build_cms(items.where(F.col("ts") % 2 == k), "item", keys=["row"], **_SHAPE) for k in (0, 1)]
    merged = sketches.merge_cms(*halves, keys=["row"]).withColumnRenamed("cnt", "m")
    whole = sketches.build_cms(items, "item", keys=["row"], **_SHAPE)
    both = whole.join(merged, ["row", "depth", "bucket"], "full")
    return both.groupBy("row").agg(F.min(F.coalesce(F.col("cnt") == F.col("m"), F.lit(False))).alias("same"))


@query(
    f"""SELECT row, CAST(sum(n) AS BIGINT) AS n, round(sum(item * n) / sum(n), 6) AS mean,
        round(sqrt((sum(CAST(item AS DOUBLE) * item * n) - sum(CAST(item AS DOUBLE) * n) * sum(CAST(item AS DOUBLE) * n) / sum(n)) / (sum(n) - 1)), 6) AS stddev,
        CAST(min(item) AS DOUBLE) AS least, CAST(max(item) AS DOUBLE) AS most FROM ({_ITEMS}) GROUP BY 1"""
)
def cms_summary(spark, sf_dir):
    """On a sketch so wide that its estimates are exact here."""
    items = _flag_items(Cluster(spark, sf_dir))
    shape = {"depth": 9, "width": 1 << 18, "seed": 0}
    state = sketches.build_cms(items, "item", keys=["row"], **shape)
    summary = sketches.summary_cms(sketches.estimate_cms(state, items, "item", keys=["row"], **shape), "item", keys=["row"])
    return summary.select("row", "n", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "least", "most")


@query("SELECT l_returnflag AS row, max(l_orderkey) AS ts, count(*) AS total FROM lineitem GROUP BY 1")
def cms_upsert(spark, sf_dir):
    items = _flag_items(Cluster(spark, sf_dir))
    parts = [items.where(F.col("ts") % 3 == 0), items.where(F.col("ts") % 3 != 0)]
    states = [sketches.build_cms(p, "item", keys=["row"], **_SHAPE) for p in parts]
    times = [p.groupBy("row").agg(F.max("ts").alias("ts")) for p in parts]
    counters, newest = sketches.upsert_cms(states[0], times[0], states[1], times[1], keys=["row"])
    total = counters.where("depth = 0").groupBy("row").agg(F.sum("cnt").alias("total"))
    return newest.join(total, "row")


# -- streams as batches -----------------------------------------------------------------------------------------------


@query(
    """SELECT server, strftime(w, '%Y-%m-%d') AS day, requests, errors, requests >= 10 AND 100.0 * errors / requests >= 25 AS open FROM (
      SELECT user_id % 10 AS server, date_trunc('day', ts) AS w, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL)"""
)
def circuit_breaker_windows(spark, sf_dir):
    found = streams.breaker_windows(Cluster(spark, sf_dir).requests, window="1 day")
    return found.select("server", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "requests", "errors", "open")


def _polls(c: Cluster) -> DataFrame:
    e = c.table("events")
    return e.select((F.col("event_id") % 20).alias("poll_id"), F.col("user_id").cast("string").alias("region")).distinct()


@query(
    """WITH p AS (SELECT DISTINCT event_id % 20 AS poll_id, CAST(user_id AS VARCHAR) AS region FROM events)
    SELECT a.poll_id + 1 AS poll_id, a.region FROM p a WHERE a.poll_id < (SELECT max(poll_id) FROM p) AND NOT EXISTS (SELECT 1 FROM p b WHERE b.poll_id = a.poll_id + 1 AND b.region = a.region)"""
)
def poll_set_difference(spark, sf_dir):
    return streams.left_transition(_polls(Cluster(spark, sf_dir)))


@query(
    f"""SELECT metric, CAST(sum(v) AS BIGINT) AS total, count(*) AS n, count(label) AS labelled FROM (
      SELECT unnest({list(streams.REGION_LOAD_METRICS)}) AS metric, unnest([{", ".join(f"event_id * {k + 1}" for k in range(len(streams.REGION_LOAD_METRICS)))}]) AS v,
             CASE WHEN name LIKE '%.META.%' OR name LIKE '%-ROOT-%' THEN NULL ELSE name END AS label
      FROM (SELECT event_id, {_NAME} AS name FROM events)) GROUP BY 1"""
)
def region_gauges_unpivot(spark, sf_dir):
    named = _named_events(Cluster(spark, sf_dir))
    load = named.select(
        (F.col("user_id") % 10).cast("string").alias("server"),
        "region_name",
        F.col("ts").cast("timestamp").alias("snapshot_ts"),
        *[(F.col("event_id") * (k + 1)).alias(m) for k, m in enumerate(streams.REGION_LOAD_METRICS)],
    )
    return streams.region_gauges(load).groupBy("metric").agg(F.sum("value").cast("bigint").alias("total"), F.count("*").alias("n"), F.count("label").alias("labelled"))


@query(cluster_sql(f"SELECT 'localityPercent' AS metric, region_id, round(100 * {_LOCAL}, 7) AS value FROM annotated", _ANNOTATED_SQL))
def locality_gauges(spark, sf_dir):
    c = Cluster(spark, sf_dir)
    found = streams.locality_gauge(annotate.with_transfer(c.regions, c.blocks), 0)
    return found.select("metric", "region_id", F.round("value", 7).alias("value"))


# -- searches and logs ------------------------------------------------------------------------------------------------


@query()
def annealing_plan(spark, sf_dir):
    """Moves of the best of eight chains under the default weights; tests hold it to its budget and its costs."""
    c = Cluster(spark, sf_dir)
    return search.balance(c.regions, c.servers, ranges=c.ranges, blocks=c.blocks, chains=8)


@query()
def annealing_moves_hold(spark, sf_dir):
    """What any plan of the search must be: within budget, from where regions are, a move each, cheaper, and as dear as the cost operators say."""
    c = Cluster(spark, sf_dir)
    budget = 200
    plan = search.balance(c.regions, c.servers, ranges=c.ranges, blocks=c.blocks, chains=2, steps=300, budget=budget)
    found = plan.collect()  # at most the budget
    rows = spark.createDataFrame([(r["region_id"], r["from_server"], r["to_server"]) for r in found], "region_id long, from_server long, to_server long")
    told = rows.join(c.regions.select("region_id", "server_id"), "region_id", "left").join(c.servers.select(F.col("server_id").alias("to_server"), F.lit(True).alias("is_server")), "to_server", "left")
    moved = c.regions.select("region_id", "table_name", "size", F.col("server_id").alias("old_server")).join(rows.select("region_id", F.col("to_server").alias("to")), "region_id", "left")
    placed = moved.withColumn("server_id", F.coalesce("to", "old_server"))
    rescored = cost.combined_cost(cost.Placement(placed, c.servers, c.blocks, c.ranges, budget=budget)).select(F.col("cost").alias("rescored"))
    final, first = (F.lit(float(found[0][x]) if found else 0.0) for x in ("final_cost", "initial_cost"))
    return told.agg(
        ((F.count("*") > 0) & (F.count("*") <= budget)).alias("within_budget"),
        (F.countDistinct("region_id") == F.count("*")).alias("one_move_each"),
        F.bool_and(F.col("from_server") == F.col("server_id")).alias("from_where_it_is"),
        F.bool_and(F.coalesce("is_server", F.lit(False)) & (F.col("from_server") != F.col("to_server"))).alias("to_another_server"),
    ).crossJoin(rescored).select(
        "within_budget", "one_move_each", "from_where_it_is", "to_another_server", (final < first).alias("cheaper"), (F.abs(F.col("rescored") - final) <= 1e-6 * F.abs(final)).alias("as_dear_as_told")
    )


ORACLES["annealing_moves_hold"] = "SELECT " + ", ".join(f"true AS {x}" for x in ("within_budget", "one_move_each", "from_where_it_is", "to_another_server", "cheaper", "as_dear_as_told"))


_PATHS = "'/data/' || o_orderpriority || '/' || md5(CAST(o_custkey AS VARCHAR))"


@query(f"SELECT {_PATHS} || '/f/' || md5(CAST(o_orderkey AS VARCHAR)) AS path, {_PATHS} AS region_path FROM orders")
def file_attribution(spark, sf_dir):
    o = Cluster(spark, sf_dir).table("orders")

    def digest(c: str) -> Column:
        return F.md5(F.col(c).cast("string").cast("binary"))

    region = F.concat(F.lit("/data/"), F.col("o_orderpriority"), F.lit("/"), digest("o_custkey"))
    listing = o.select(F.concat(region, F.lit("/f/"), digest("o_orderkey")).alias("path"))
    return files.attribute_files(listing, o.select(region.alias("region_path")).distinct())


# -- files ------------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share; removed when the driver exits."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared.rstrip('/')}/regionloom-{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(drop)
    return path


_LOGGED = "SELECT '/t/' || l_orderkey AS file, l_linenumber, l_suppkey AS s, CAST(trunc(l_quantity) AS BIGINT) AS size FROM lineitem"


@query(
    f"""SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY l_linenumber, size, s % 10) - 1 AS INTEGER) AS block_no, size,
      array_to_string(list_sort(list_filter(['s' || s % 10, 's' || (s + 1) % 10], lambda x: x <> 's3')), ',') AS replicas FROM ({_LOGGED})"""
)
def fsck_parse(spark, sf_dir):
    """A check log of all orders' blocks, written and read back; the server of one address is unknown."""
    item = Cluster(spark, sf_dir).table("lineitem")
    address = "concat('10.0.0.', {} % 10, ':50010')"
    blocks = item.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("size"), F.expr(f"concat('[', {address.format('l_suppkey')}, ', ', {address.format('(l_suppkey + 1)')}, ']')").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "size", "at")))
    per_file = blocks.groupBy("l_orderkey").agg(listed.alias("b"), F.sum("size").alias("bytes"))
    lines = F.transform("b", lambda x, k: F.format_string("%d. blk_%d len=%d repl=2 %s", k, x["l_linenumber"], x["size"], x["at"]))
    head = F.format_string("/t/%d %d bytes, %d block(s):  OK", "l_orderkey", "bytes", F.size("b"))
    path = _folder(spark, "check-log")
    per_file.select(F.concat(F.array_join(F.concat(F.array(head), lines), "\n"), F.lit("\n")).alias("value")).write.text(path)
    servers = spark.range(10).where("id <> 3").select(F.concat(F.lit("10.0.0."), "id").alias("ip"), F.concat(F.lit("s"), "id").alias("server"))
    return files.read_check_log(spark, path, servers).select("file", "block_no", "size", F.array_join("replicas", ",").alias("replicas"))


@query(cluster_sql("SELECT 'r' || region_id AS encoded_name, size, CAST(CASE WHEN region_id % 3 = 0 THEN NULL ELSE hfiles END AS BIGINT) AS modified, server_id FROM regions WHERE table_name = 'Brand#13'"))
def region_stats_json(spark, sf_dir):
    """Region statistics as gzipped JSON, written and read back for one table, its name in another case."""
    r = Cluster(spark, sf_dir).regions
    info = F.struct(F.col("table_name"), F.concat(F.lit("r"), "region_id").alias("encoded_name"), F.lit(None).cast("binary").alias("start_key"), F.lit(None).cast("binary").alias("end_key"))
    stats = r.select(info.alias("regionInfo"), F.col("server_id").cast("string").alias("serverName"), "size", F.when(F.col("region_id") % 3 != 0, F.col("hfiles")).alias("modificationTime"))
    path = _folder(spark, "region-stats")
    files.write_region_stats(stats, path, compressed=True)
    back = files.read_region_stats(spark, path, "bRAND#13")
    return back.select("regionInfo.encoded_name", "size", F.col("modificationTime").alias("modified"), F.col("serverName").cast("bigint").alias("server_id"))


@query(cluster_sql("SELECT 'r' || region_id AS encoded_name, 's' || server_id AS server FROM regions WHERE region_id % 4 <> 0 UNION ALL SELECT 'r' || region_id, 's' || server_id FROM regions WHERE region_id % 4 = 0"))
def region_list_file(spark, sf_dir):
    """Lines of regions and servers, written, added to, and read back."""
    r = Cluster(spark, sf_dir).regions
    named = r.select("region_id", F.concat(F.lit("r"), "region_id").alias("encoded_name"), F.concat(F.lit("s"), "server_id").alias("server"))
    path = _folder(spark, "region-list")
    files.write_region_list(named.where("region_id % 4 <> 0"), path)
    files.write_region_list(named.where("region_id % 4 = 0"), path, append=True)
    return files.read_region_list(spark, path)


@query(
    cluster_sql(
        """SELECT a.region_id, CASE WHEN a.region_id % 3 = 0 THEN a.size ELSE b.size * 2 END AS size, b.hfiles + 1 AS hfiles
    FROM regions a LEFT JOIN (SELECT * FROM regions WHERE region_id % 5 <> 0) b USING (region_id)"""
    )
)
def merged_stats(spark, sf_dir):
    """Statistics of two sources: the left one's where it knows them."""
    r = Cluster(spark, sf_dir).regions
    left = r.select("region_id", F.when(F.col("region_id") % 3 == 0, F.col("size")).alias("size"))
    right = r.where("region_id % 5 <> 0").select("region_id", (F.col("size") * 2).alias("size"), (F.col("hfiles") + 1).alias("hfiles"))
    return annotate.merge_stats(left, right, ["region_id"], ["size", "hfiles"])


@query("SELECT s_suppkey AS server_id, s_name AS hostname FROM supplier WHERE lower(s_name) IN (SELECT lower(min(s_name)) FROM supplier)")
def host_any_case(spark, sf_dir):
    s = Cluster(spark, sf_dir).servers
    return s.where(R.same_name(F.col("hostname"), s.agg(F.min("hostname")).first()[0].swapcase()))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_tags, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def known_tags_only(spark, sf_dir):
    o = Cluster(spark, sf_dir).table("orders")
    tags = R.known_tags(priority=F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), customer=F.col("o_custkey"), none=F.lit(None))
    return o.select(F.col("o_orderkey").alias("id"), tags.alias("t")).select("id", F.size("t").alias("n_tags"), F.col("t")["priority"].alias("priority"), F.col("t")["customer"].alias("customer"))
