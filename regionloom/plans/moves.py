"""Plans that move regions: differences of assignments, drains, loads, schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.regions import locality
from ..operators.annotate import transfer_costs
from .numbering import numbered


def transition_budget(max_time_millis: int = 600_000, per_minute: int = 75) -> int:
    """Moves that fit into a time limit."""
    return max_time_millis * per_minute // 60_000


def transitions(assignments: DataFrame) -> DataFrame:
    """``region_id, from_server, to_server``: the rows of ``assignments(region_id, old_server, server_id)`` that change."""
    changed = ~F.col("old_server").eqNullSafe(F.col("server_id"))
    return assignments.where(changed).select("region_id", F.col("old_server").alias("from_server"), F.col("server_id").alias("to_server"))


def check_budget(plan: DataFrame, budget: int) -> DataFrame:
    """The plan, or an error if it is larger than the budget."""
    n = plan.count()
    if n > budget:
        raise ValueError(f"{n} transitions exceed the budget of {budget}")
    return plan


def transition_report(plan: DataFrame, regions: DataFrame) -> DataFrame:
    """Transitions with their region's table and size, in order of region."""
    r = regions.select("region_id", "table_name", "size")
    return plan.join(r, "region_id").select("region_id", "table_name", "from_server", "to_server", "size").orderBy("region_id")


def schedule(plan: DataFrame, per_minute: int = 75, max_transitions: int = 5) -> DataFrame:
    """The plan with ``minute`` and ``after_completions``, for moves in order of region.

    A move starts in its minute at the earliest, and not before so many moves have
    ended, which keeps fewer than ``max_transitions`` others in flight.
    """
    rows = numbered(plan, "__n", "region_id")
    room = F.greatest(F.col("__n") - max_transitions + 1, F.lit(0))
    return rows.withColumn("minute", F.floor(F.col("__n") / per_minute).cast("bigint")).withColumn("after_completions", room.cast("bigint")).drop("__n")


def transition_room(planned: DataFrame, in_transition: DataFrame, max_transitions: int = 5) -> DataFrame:
    """One row ``in_flight, room``: how many planned regions are in transition now, and whether another may follow."""
    flying = moves_in_transition(planned, in_transition).agg(F.count("*").alias("in_flight"))
    return flying.withColumn("room", F.col("in_flight") < max_transitions)


def compacted_after(plan: DataFrame, regions: DataFrame, blocks: DataFrame, threshold: float | None = None) -> DataFrame:
    """The plan with ``compact``: whether a region is to be compacted where it goes, its locality there not above the threshold."""
    placed = plan.join(regions.select("region_id", "size"), "region_id").withColumn("server_id", F.col("to_server"))
    there = transfer_costs(blocks, placed).select("region_id", F.col("server_id").alias("to_server"), "transfer")
    share = locality(F.coalesce("size", F.lit(0)), F.coalesce("transfer", F.lit(0)))
    local = placed.join(there, ["region_id", "to_server"], "left").select("region_id", (share <= (1.0 if threshold is None else threshold)).alias("compact"))
    return plan.join(local, "region_id")


def moves_in_transition(planned: DataFrame, in_transition: DataFrame) -> DataFrame:
    """Planned regions that are in transition now."""
    return planned.select("region_id").intersect(in_transition.select("region_id"))


def drain(regions: DataFrame, servers: DataFrame, listed: Sequence, *, order: Column | None = None) -> DataFrame:
    """Graceful shutdown: regions of the listed servers go round robin to the others.

    The round follows ``order`` (by default the region; a seeded hash shuffles) and
    the other servers by id.  Naming no known server, or all of them, is an error.
    """
    on = F.col("server_id").isin(*listed)
    others = servers.where(~on)
    n = others.count()
    if n == 0 or servers.where(on).isEmpty():
        raise ValueError("some, not all, of the listed servers must be known")
    queue = [order, "region_id"] if order is not None else ["region_id"]
    leaving = numbered(regions.where(on).select("region_id", F.col("server_id").alias("from_server"), *([order.alias("__order")] if order is not None else [])), "turn", *["__order" if x is order else x for x in queue])
    leaving = leaving.select("region_id", "from_server", (F.col("turn") % n).alias("turn"))
    ranked = numbered(others.select(F.col("server_id").alias("to_server")), "turn", "to_server")
    return leaving.join(ranked, "turn").select("region_id", "from_server", "to_server")


def _target_locality(regions: DataFrame, blocks: DataFrame, target) -> DataFrame:
    """``regions`` with ``target_locality`` and ``current_locality``; 1 for a region without bytes."""

    def share(transfer: Column) -> Column:
        return F.when(F.col("size") == 0, F.lit(1.0)).otherwise((F.col("size") - F.coalesce(transfer, F.lit(0))) / F.col("size"))

    here = transfer_costs(blocks, regions).select("region_id", F.col("transfer").alias("here"))
    there = transfer_costs(blocks, regions.withColumn("server_id", F.lit(target).cast("bigint"))).select("region_id", F.col("transfer").alias("there"))
    return (
        regions.join(here, "region_id", "left")
        .join(there, "region_id", "left")
        .withColumn("target_locality", share(F.col("there")))
        .withColumn("current_locality", share(F.col("here")))
        .drop("here", "there")
    )


def load(
    regions: DataFrame, servers: DataFrame, blocks: DataFrame, target, *, source=None, most_local: bool = False, listed: DataFrame | None = None
) -> DataFrame:
    """Graceful load: ``region_id, from_server, to_server`` onto the target.

    ``listed`` regions as they are; or all regions of ``source``; or with
    ``most_local`` the most local of all others, as many as an even share; or by
    default from each server above the even share its excess, most local first, up
    to an even share in all.  Regions that are there already are skipped.  An
    unknown target or source is an error, and so are ``listed`` and ``source`` together.
    """
    if listed is not None and source is not None:
        raise ValueError("give either a list of regions or a source server")
    known = servers.select("server_id")
    if known.where(F.col("server_id") == target).isEmpty() or (source is not None and known.where(F.col("server_id") == source).isEmpty()):
        raise ValueError("unknown server")
    others = regions.where(F.col("server_id") != target)
    if listed is not None:
        chosen = others.join(listed.select("region_id").distinct(), "region_id", "left_semi")
    elif source is not None:
        chosen = others.where(F.col("server_id") == source)
    else:
        even = regions.count() // servers.count()
        order = [F.desc("target_locality"), F.asc("current_locality"), F.asc("mtime"), F.asc("region_id")]
        ranked = _target_locality(others, blocks, target)
        if not most_local:
            per_server = Window.partitionBy("server_id")
            ranked = (
                ranked.withColumn("__held", F.count("*").over(per_server))
                .withColumn("__rank", F.row_number().over(per_server.orderBy(*order)))
                .where(F.col("__rank") <= F.col("__held") - even)
            )
        chosen = ranked.orderBy(*order).limit(even)
    return chosen.select("region_id", F.col("server_id").alias("from_server"), F.lit(target).cast("bigint").alias("to_server"))


def heaviest_to_lightest(costs: DataFrame) -> DataFrame:
    """``from_server, to_server``: the costliest and the cheapest server, ties by id."""
    key = F.struct("cost", (-F.col("server_id")).alias("s"))
    low = F.struct("cost", F.col("server_id").alias("s"))
    return costs.agg((-F.max(key)["s"]).alias("from_server"), F.min(low)["s"].alias("to_server"))


def pick_one(rows: DataFrame, keys: list[str], value: str, seed: int = 0) -> DataFrame:
    """``keys, value``: one value per key, each as likely; the same rows and seed give the same pick."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.xxhash64(F.col(value), F.lit(seed)), F.col(value))).alias(value))
