"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations and two joins on the edge table; the number of
rounds grows with the logarithm of the largest component.  Nothing but two
numbers per round reaches the driver, and each round's edges are a table in the
shared folder, so a lost executor never costs more than the round it was in.
A hub of many edges is summed map-side, and its join side can be split by the
adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return least.select(F.col("m").alias("a"), "b").unionByName(moved).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that isn't its component's smallest.

    Edges may repeat, point either way and join a node to itself; rows with a null
    end are ignored.  An empty table gives an empty result.
    """
    current = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current = store.keep(current, "edges")
    seen = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        written = store.mark()
        current = store.keep(_small_star(_large_star(current)), "edges")
        store.drop_since(written - 1, but=1)  # the edges of the round before
    return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
