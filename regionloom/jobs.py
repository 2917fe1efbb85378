"""Jobs by name, and their options.

A job takes a `Context` of tables and gives a DataFrame: a plan or a report.  It
never acts on a cluster.  An option that a job would not heed is refused.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.regions import listed_in, same_name
from .operators import annotate, report
from .operators.cost import DEFAULT_WEIGHTS
from .plans import balance, compaction, merge, moves
from .sources import files
from .streaming import streams

CONF_PREFIX = "spark.regionloom."


@dataclass(frozen=True)
class Options:
    """Options of all jobs, with their defaults (fixed values)."""

    actuallyRun: bool = False
    maxTimeMillis: int = 600_000
    maxTransitionsPerMinute: int = 75
    optimizationTimeSeconds: int = 30
    maxTransitions: int = 5
    serverName: str | None = None
    outputFileName: str | None = None
    inputFileName: str | None = None
    costFunction: str | None = None
    perturber: str = "TableGreedyPerturber"
    reverseLocality: bool = False
    compactionQuietTimeSeconds: int = 5
    compactionQueueSize: int = 2
    source: str | None = None
    pullMostLocal: bool = False
    factor: int = 2
    compactThreshold: float | None = None
    stagnateIterations: int = 100
    table: str | None = None
    compactionType: str = "major"
    compactPostMove: bool = False
    emptyRegionsOnly: bool = False

    @property
    def weights(self) -> Mapping[str, float]:
        return json.loads(self.costFunction) if self.costFunction else DEFAULT_WEIGHTS

    @property
    def budget(self) -> int:
        return moves.transition_budget(self.maxTimeMillis, self.maxTransitionsPerMinute)


def _typed(f: dataclasses.Field, value):
    kind = str(f.type).split(" | ")[0]
    if isinstance(value, str) and kind != "str":
        return {"bool": lambda v: v.strip().lower() == "true", "int": int, "float": float}[kind](value)
    return value


def options(spark: SparkSession | None = None, **given) -> Options:
    """Options from arguments, else from the session's ``spark.regionloom.*`` settings, else the defaults.

    Unknown names are ignored; texts are turned into the option's type.
    """
    out = {}
    for f in dataclasses.fields(Options):
        value = given.get(f.name)
        if value is None and spark is not None:
            value = spark.conf.get(CONF_PREFIX + f.name, None)
        if value is not None:
            out[f.name] = _typed(f, value)
    return Options(**out)


def at_most_one(message: str, *values) -> None:
    """An error if more than one of the values is given."""
    if sum(v is not None for v in values) > 1:
        raise ValueError(message)


@dataclass
class Context:
    """The tables that jobs read: regions (``region_id, table_name, server_id, size, hfiles, mtime``), servers, blocks, metrics, ranges."""

    regions: DataFrame
    servers: DataFrame
    blocks: DataFrame | None = None
    metrics: DataFrame | None = None
    ranges: DataFrame | None = None
    listed: DataFrame | None = None
    region_load: DataFrame | None = None

    def on_hosts(self, names: str | None) -> list:
        """Ids of the servers whose host name is in a comma-separated list."""
        if not names:
            return []
        return [r["server_id"] for r in self.servers.where(listed_in(F.col("hostname"), names)).select("server_id").collect()]

    def named_regions(self, o: Options) -> DataFrame | None:
        """The regions that the list names, or the file of `inputFileName` in its place."""
        if self.listed is not None or not o.inputFileName:
            return self.listed
        named = files.read_region_list(self.regions.sparkSession, o.inputFileName)
        return named.select(F.col("encoded_name").cast(self.regions.schema["region_id"].dataType).alias("region_id"))

    def annotated(self) -> DataFrame:
        with_transfer = annotate.with_transfer(self.regions, self.blocks)
        return annotate.load_weights(with_transfer, self.metrics) if self.metrics is not None else with_transfer.withColumn("load", F.lit(0.0))


Job = Callable[[Context, Options], DataFrame]


def _one_table(df: DataFrame, o: Options) -> DataFrame:
    return df.where(F.lower("table_name") == o.table.lower()) if o.table else df


def display_region_stats(c: Context, o: Options) -> DataFrame:
    """The report by table and by server, and by region of a table and of a server if named; ``grouping`` tells which.

    A table and a host are named without regard to case.  The regions that were
    reported go to ``outputFileName`` as JSON lines, if it is given.
    """
    rows = c.annotated()
    if o.outputFileName:
        files.write_region_stats(rows, o.outputFileName, compressed=o.outputFileName.endswith(".gz"))
    out = [("table", report.region_report(rows, "table_name")), ("server", report.region_report(rows, "server_id"))]
    if o.table:
        out.append(("region", report.region_report(_one_table(rows, o), "region_id")))
    if o.serverName:
        on_host = rows.join(c.servers.where(same_name(F.col("hostname"), o.serverName)).select("server_id"), "server_id", "left_semi")
        named = on_host.withColumn("__key", F.concat_ws(", ", "table_name", "region_id"))
        out.append(("server region", report.region_report(named, "__key")))
    frames = [r.select(F.lit(kind).alias("grouping"), F.col("key").cast("string").alias("key"), *[x for x in r.columns if x != "key"]) for kind, r in out]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def run_custom_balancer(c: Context, o: Options) -> DataFrame:
    migrating = o.perturber == "MigrationPerturber"
    if migrating:
        at_most_one("name either a source or a target", o.source, o.serverName)
    known = c.annotated() if c.blocks is not None else c.regions
    if o.inputFileName:  # what displayRegionStats has written
        known = c.regions.sparkSession.read.schema(known.schema).option("mode", "FAILFAST").json(o.inputFileName)
    plan = balance.balance(
        _one_table(known, o),
        c.servers,
        weights=o.weights,
        ranges=c.ranges,
        blocks=c.blocks,
        budget=o.budget,
        steps=100 * o.optimizationTimeSeconds,
        stagnate=o.stagnateIterations,
        perturber="GreedyPerturber" if o.table and o.perturber == "TableGreedyPerturber" else o.perturber,
        targets=tuple(c.on_hosts(o.serverName)) if migrating else (),
        sources=tuple(c.on_hosts(o.source)) if migrating else (),
    )
    return moves.schedule(moves.check_budget(plan, o.budget), o.maxTransitionsPerMinute, o.maxTransitions)


def run_custom_balancer_daemon(c: Context | Callable[[], Context], o: Options, every: str = "10 seconds") -> StreamingQuery:
    """The balancer again and again until the query is stopped; plan ``n`` is a table below ``outputFileName``.

    A context that is a function is called for each plan, which then sees the
    cluster as it is.
    """
    if not o.outputFileName:
        raise ValueError("outputFileName must name where plans go")

    def plan(n: int) -> None:
        run_custom_balancer(c() if callable(c) else c, o).write.mode("overwrite").parquet(f"{o.outputFileName}/plan={n}")

    spark = SparkSession.active()
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return streams.repeat_plan(ticks, plan, f"{o.outputFileName}/_checkpoint", every)


def _after_moves(c: Context, o: Options, plan: DataFrame) -> DataFrame:
    return moves.compacted_after(plan, c.regions, c.blocks, o.compactThreshold) if o.compactPostMove else plan


def graceful_shutdown(c: Context, o: Options) -> DataFrame:
    return _after_moves(c, o, moves.schedule(moves.drain(c.regions, c.servers, c.on_hosts(o.serverName)), o.maxTransitionsPerMinute, o.maxTransitions))


def graceful_load(c: Context, o: Options) -> DataFrame:
    """Regions onto a server; or, with a file of regions and hosts, each onto the host that the file says."""
    at_most_one("give either a file or a server", o.inputFileName, o.serverName)
    if o.inputFileName:
        named = files.read_region_list(c.regions.sparkSession, o.inputFileName).join(c.servers.select(F.col("hostname").alias("server"), F.col("server_id").alias("to_server")), "server")
        known = c.regions.join(named, F.col("region_id").cast("string") == F.col("encoded_name")).where("server_id <> to_server")
        plan = known.select("region_id", F.col("server_id").alias("from_server"), "to_server")
    else:
        target, source = c.on_hosts(o.serverName), c.on_hosts(o.source)
        if len(target) != 1 or (o.source and len(source) != 1):
            raise ValueError("unknown server")
        plan = moves.load(c.regions, c.servers, c.blocks, target[0], source=source[0] if source else None, most_local=o.pullMostLocal, listed=c.listed)
    return _after_moves(c, o, moves.schedule(plan, o.maxTransitionsPerMinute, o.maxTransitions))


def _throttled(o: Options, plan: DataFrame) -> DataFrame:
    return compaction.throttled(plan, queue_size=o.compactionQueueSize, quiet_seconds=o.compactionQuietTimeSeconds, kind=o.compactionType)


def major_compact_table(c: Context, o: Options) -> DataFrame:
    return _throttled(o, compaction.compaction_plan(c.annotated(), table=o.table, threshold=o.compactThreshold, reverse_locality=o.reverseLocality))


def major_compact_servers(c: Context, o: Options) -> DataFrame:
    return _throttled(o, compaction.compaction_plan(c.annotated(), servers=c.on_hosts(o.serverName), threshold=o.compactThreshold))


def compact_regions_from_file(c: Context, o: Options) -> DataFrame:
    known, _ = compaction.listed_regions(c.annotated(), c.named_regions(o))
    return _throttled(o, compaction.compaction_plan(known))


def merge_table_regions(c: Context, o: Options, max_file_size: int = 10 << 30) -> DataFrame:
    rows = _one_table(c.ranges, o).join(c.regions.select("region_id", "size"), "region_id")
    return merge.merge_empty_groups(rows) if o.emptyRegionsOnly else merge.merge_groups(rows, factor=o.factor, max_file_size=max_file_size)


def flush_tables(c: Context, o: Options) -> DataFrame:
    tables = c.regions.select("table_name").distinct()
    return compaction.flush_plan(tables, o.table) if o.table else tables


def report_cluster_status(c: Context, o: Options) -> DataFrame:
    return streams.region_gauges(c.region_load)


JOBS: dict[str, Job] = {
    "displayRegionStats": display_region_stats,
    "runCustomBalancer": run_custom_balancer,
    "gracefulShutdown": graceful_shutdown,
    "gracefulLoad": graceful_load,
    "majorCompactTable": major_compact_table,
    "majorCompactServers": major_compact_servers,
    "compactRegionsFromFile": compact_regions_from_file,
    "mergeTableRegions": merge_table_regions,
    "flushTables": flush_tables,
    "reportClusterStatus": report_cluster_status,
}


#: Jobs that go on until their query is stopped.
DAEMONS = {"runCustomBalancerDaemon": run_custom_balancer_daemon}

_MOVES = {"maxTransitionsPerMinute", "maxTransitions"}
_REQUESTS = {"compactionQueueSize", "compactionQuietTimeSeconds", "compactionType"}
_SEARCH = _MOVES | {"maxTimeMillis", "optimizationTimeSeconds", "costFunction", "perturber", "stagnateIterations", "table", "serverName", "source", "inputFileName"}
#: What each job heeds.
HEEDED: dict[str, set[str]] = {
    "displayRegionStats": {"table", "serverName", "outputFileName"},
    "runCustomBalancer": _SEARCH,
    "runCustomBalancerDaemon": _SEARCH | {"outputFileName"},
    "gracefulShutdown": _MOVES | {"serverName", "compactPostMove", "compactThreshold"},
    "gracefulLoad": _MOVES | {"serverName", "source", "pullMostLocal", "inputFileName", "compactPostMove", "compactThreshold"},
    "majorCompactTable": _REQUESTS | {"table", "compactThreshold", "reverseLocality"},
    "majorCompactServers": _REQUESTS | {"serverName", "compactThreshold"},
    "compactRegionsFromFile": _REQUESTS | {"inputFileName"},
    "mergeTableRegions": {"table", "factor", "emptyRegionsOnly"},
    "flushTables": {"table"},
    "reportClusterStatus": set(),
}


def run(name: str, context: Context, spark: SparkSession | None = None, **given) -> DataFrame | StreamingQuery:
    """Run a job by name; an unknown one is an error that lists those there are.

    An option given here that the job does not heed is an error too, and so is
    ``actuallyRun``: jobs give plans.
    """
    if name not in JOBS | DAEMONS:
        raise KeyError(f"no job {name!r}; jobs: {', '.join(sorted(JOBS | DAEMONS))}")
    if refused := sorted(k for k, v in given.items() if v not in (None, False) and k in Options.__dataclass_fields__ and k not in HEEDED[name]):
        raise ValueError(f"{name} does not heed {', '.join(refused)}")
    return (JOBS | DAEMONS)[name](context, options(spark, **given))
