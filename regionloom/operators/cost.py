"""Costs of an assignment of regions to servers, and of the servers in it.

A cost function is an entry of `COSTS`: a name and a function from a `Placement` to
a one-row DataFrame ``cost``.  `SERVER_COSTS` likewise gives ``server_id, cost``.
Register more with `register_cost`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .annotate import transfer_costs

#: Weights by cost function (fixed values).
DEFAULT_WEIGHTS: Mapping[str, float] = {"DataSizeCost": 1000, "ProximateRegionKeyCost": 5, "LocalityCost": 75, "TransitionCost": 2000}


@dataclass
class Placement:
    """What costs are computed from.

    ``assignments`` has ``region_id, table_name, size, old_server, server_id`` and
    for the load cost ``load``; ``ranges`` has ``region_id, start_pos, end_pos``;
    ``targets`` are the servers a migration goes to, ``sources`` those it drains.
    """

    assignments: DataFrame
    servers: DataFrame
    blocks: DataFrame | None = None
    ranges: DataFrame | None = None
    budget: int = 750
    targets: tuple = ()
    sources: tuple = ()


Cost = Callable[[Placement], DataFrame]


def unevenness(value: Column) -> Column:
    """``1 - exp(-sd / mean)`` of a group's values with the population deviation: 0 for none, and where the mean is 0."""
    mean = F.avg(value)
    return F.coalesce(F.when(mean == 0, F.lit(0.0)).otherwise(1 - F.exp(-F.stddev_pop(value) / mean)), F.lit(0.0))


def _per_server(p: Placement, value: Column) -> DataFrame:
    """``server_id, total`` for all servers, 0 for those without regions."""
    sums = p.assignments.groupBy("server_id").agg(F.sum(value).alias("total"))
    return p.servers.select("server_id").join(sums, "server_id", "left").select("server_id", F.coalesce("total", F.lit(0)).cast("double").alias("total"))


def _evenness_cost(value: str | None) -> Cost:
    return lambda p: _per_server(p, F.col(value) if value else F.lit(1)).agg(unevenness(F.col("total")).alias("cost"))


def locality_cost(p: Placement) -> DataFrame:
    """Share of all bytes that isn't local to the assigned servers; 0 without bytes."""
    moved = transfer_costs(p.blocks, p.assignments).agg(F.coalesce(F.sum("transfer"), F.lit(0)).alias("transfer"))
    return _ratio(moved, p.assignments.agg(F.sum("size").alias("size")))


def _ratio(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Quotient of two one-row tables, by way of one aggregation."""
    both = part.select(F.col(part.columns[0]).cast("double").alias("a"), F.lit(0.0).alias("b")).unionByName(
        whole.select(F.lit(0.0).alias("a"), F.coalesce(F.col(whole.columns[0]), F.lit(0)).cast("double").alias("b"))
    )
    return both.agg(F.coalesce(F.try_divide(F.sum("a"), F.sum("b")), F.lit(0.0)).alias("cost"))


def table_balance_cost(p: Placement) -> DataFrame:
    """Mean over tables of the unevenness of the table's bytes over the servers that hold it."""
    held = p.assignments.groupBy("table_name", "server_id").agg(F.sum("size").alias("bytes"))
    return held.groupBy("table_name").agg(unevenness(F.col("bytes")).alias("u")).agg(F.coalesce(F.avg("u"), F.lit(0.0)).alias("cost"))


def key_gaps(p: Placement, keys: list[str]) -> DataFrame:
    """``keys, gaps``: closeness of the range ends that a group holds.

    All starts and ends are sorted; from the third value on, each adds one over one
    plus its distance to the one before.  A group with fewer than four values has 0.
    """
    placed = p.assignments.join(p.ranges.select("region_id", "start_pos", "end_pos"), "region_id")
    ends = placed.select(*keys, F.explode(F.array("start_pos", "end_pos")).alias("k"))
    ordered = Window.partitionBy(*keys).orderBy("k")
    gap = F.when(F.row_number().over(ordered) >= 3, 1 / (1 + F.abs(F.col("k") - F.lag("k").over(ordered)).cast("double")))
    return (
        ends.select(*keys, gap.alias("gap"))
        .groupBy(*keys)
        .agg(F.when(F.count("*") < 4, F.lit(0.0)).otherwise(F.coalesce(F.sum("gap"), F.lit(0.0))).alias("gaps"))
    )


def key_proximity_cost(p: Placement) -> DataFrame:
    """Gaps over (server, table), per assignment, to the power 0.3."""
    gaps = key_gaps(p, ["server_id", "table_name"]).agg(F.coalesce(F.sum("gaps"), F.lit(0.0)).alias("gaps"))
    return _ratio(gaps, p.assignments.agg(F.count("*").alias("n"))).select(F.pow("cost", F.lit(0.3)).alias("cost"))


def transition_cost(p: Placement) -> DataFrame:
    """Root of the share of moved regions, scaled by 0.001 while they are fewer than the budget."""
    moved = F.sum(F.when(F.col("old_server").eqNullSafe(F.col("server_id")), F.lit(0)).otherwise(F.lit(1)))
    counts = p.assignments.agg(moved.alias("moved"), F.count("*").alias("n"))
    scale = F.when(F.col("moved") < p.budget, F.lit(0.001)).otherwise(F.lit(1.0))
    return counts.select(F.coalesce(scale * F.sqrt(F.try_divide(F.col("moved").cast("double"), F.col("n"))), F.lit(0.0)).alias("cost"))


def migration_cost(p: Placement) -> DataFrame:
    """Number of regions that aren't on a target server; 0 if no targets are named."""
    off = F.when(F.col("server_id").isin(*p.targets), F.lit(0)).otherwise(F.lit(1)) if p.targets else F.lit(0)
    return p.assignments.agg(F.coalesce(F.sum(off), F.lit(0)).cast("double").alias("cost"))


COSTS: dict[str, Cost] = {
    "DataSizeCost": _evenness_cost("size"),
    "LoadCost": _evenness_cost("load"),
    "RegionCountCost": _evenness_cost(None),
    "LocalityCost": locality_cost,
    "TableDataBalanceCost": table_balance_cost,
    "ProximateRegionKeyCost": key_proximity_cost,
    "TransitionCost": transition_cost,
    "MigrationCost": migration_cost,
}


def _share_of_average(value: str | None) -> Cost:
    """A server's total over the servers' mean total."""

    def cost(p: Placement) -> DataFrame:
        totals = _per_server(p, F.col(value) if value else F.lit(1))
        mean = totals.agg(F.avg("total")).scalar()
        return totals.select("server_id", F.coalesce(F.try_divide(F.col("total"), mean), F.lit(0.0)).alias("cost"))

    return cost


def _for_all(p: Placement, costs: DataFrame) -> DataFrame:
    return p.servers.select("server_id").join(costs, "server_id", "left").select("server_id", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def server_key_cost(p: Placement) -> DataFrame:
    """Gaps over all of a server's regions, per region, to the power 0.3."""
    held = p.assignments.groupBy("server_id").agg(F.count("*").alias("n"))
    return _for_all(p, key_gaps(p, ["server_id"]).join(held, "server_id").select("server_id", F.pow(F.col("gaps") / F.col("n"), F.lit(0.3)).alias("cost")))


def server_table_cost(p: Placement) -> DataFrame:
    """Mean over a server's tables of its bytes of the table over the table's mean per server."""
    held = p.assignments.groupBy("table_name", "server_id").agg(F.sum("size").alias("bytes"))
    n = p.servers.agg(F.count("*").alias("n")).first()["n"]
    mean = F.sum("bytes").over(Window.partitionBy("table_name")) / n
    shares = held.select("server_id", F.col("bytes").alias("bytes"), mean.alias("mean")).where("mean > 0")
    return _for_all(p, shares.groupBy("server_id").agg(F.avg(F.col("bytes") / F.col("mean")).alias("cost")))


def server_migration_cost(p: Placement) -> DataFrame:
    """A server's regions, 0 for a target."""
    totals = _per_server(p, F.lit(1))
    return totals.select("server_id", F.when(F.col("server_id").isin(*p.targets), F.lit(0.0)).otherwise(F.col("total") if p.targets else F.lit(0.0)).alias("cost"))


SERVER_COSTS: dict[str, Cost] = {
    "DataSizeCost": _share_of_average("size"),
    "LoadCost": _share_of_average("load"),
    "RegionCountCost": _share_of_average(None),
    "LocalityCost": _share_of_average("size"),
    "TableDataBalanceCost": server_table_cost,
    "ProximateRegionKeyCost": server_key_cost,
    "TransitionCost": lambda p: p.servers.select("server_id", F.lit(0.0).alias("cost")),
    "MigrationCost": server_migration_cost,
}


def register_cost(name: str, cost: Cost, server_cost: Cost) -> None:
    """Make a cost function known by name."""
    COSTS[name], SERVER_COSTS[name] = cost, server_cost


def cost_breakdown(p: Placement, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """``function, weight, cost, weighted_cost``: a row per function."""
    rows = [
        COSTS[name](p).select(F.lit(name).alias("function"), F.lit(float(w)).alias("weight"), F.col("cost"), (F.col("cost") * float(w)).alias("weighted_cost"))
        for name, w in weights.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def combined_cost(p: Placement, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    return cost_breakdown(p, weights).agg(F.sum("weighted_cost").alias("cost"))


def combined_server_cost(p: Placement, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """``server_id, cost``: weighted sum of the server costs."""
    rows = [SERVER_COSTS[name](p).select("server_id", (F.col("cost") * float(w)).alias("cost")) for name, w in weights.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("server_id").agg(F.sum("cost").alias("cost"))


def elevated_server_cost(p: Placement, weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """Server costs of a migration: the largest cost plus one on top for a source, or for all that aren't targets."""
    if p.sources and p.targets:
        raise ValueError("name either source or target servers, not both")
    costs = combined_server_cost(p, weights)
    most = costs.agg(F.max("cost")).scalar()
    if p.sources:
        elevated = F.col("server_id").isin(*p.sources)
    else:
        elevated = ~F.col("server_id").isin(*p.targets) if p.targets else F.lit(False)
    return costs.select("server_id", F.when(elevated, F.col("cost") + most + 1).otherwise(F.col("cost")).alias("cost"))
