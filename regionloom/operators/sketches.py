"""Mergeable sketches kept per cell: HyperLogLog for distinct items, Count-Min for frequencies.

HyperLogLog state is a binary column of the built-in DataSketches functions.
Count-Min state is relational, a row per non-zero counter, which allows any depth
and width, weighted counts, merging by summing, and estimates in plain joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = ["row", "family", "qualifier"]


def lg_k_for(error: float) -> int:
    """Log2 of the registers that give a relative error (1.04 over the root of their number), within 4..21."""
    return min(max(math.ceil(2 * math.log2(1.04 / error)), 4), 21)


DEFAULT_LG_K = lg_k_for(0.005)


def build_hll(items: DataFrame, item: str, *, keys: list[str] = CELL, ts: str = "ts", lg_k: int = DEFAULT_LG_K) -> DataFrame:
    """``keys, sketch, ts``: a sketch of the items of each cell with its newest time."""
    return items.groupBy(*keys).agg(F.hll_sketch_agg(item, F.lit(lg_k)).alias("sketch"), F.max(ts).alias("ts"))


def merge_hll(state: DataFrame, delta: DataFrame, *, keys: list[str] = CELL) -> DataFrame:
    """The union of both tables' sketches per cell, time the larger.  Sketches of different precision are an error."""
    return state.select(*keys, "sketch", "ts").unionByName(delta.select(*keys, "sketch", "ts")).groupBy(*keys).agg(
        F.hll_union_agg("sketch", F.lit(False)).alias("sketch"), F.max("ts").alias("ts")
    )


def upsert_hll(state: DataFrame, delta: DataFrame, *, keys: list[str] = CELL, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """The state after an upsert, and what each upserted cell returns: its estimate before, -1 if it was absent.

    A merge that leaves the estimate as it was still takes the new registers and the
    newer time, so the order of deltas doesn't matter; with ``compat`` such a cell
    keeps its old sketch and time.
    """
    before = state.select(*keys, F.col("sketch").alias("__old"), F.col("ts").alias("__old_ts"))
    returned = delta.select(*keys).distinct().join(before, keys, "left").select(*keys, F.coalesce(F.hll_sketch_estimate("__old"), F.lit(-1)).alias("returned"))
    merged = merge_hll(state, delta, keys=keys)
    if compat:
        same = F.hll_sketch_estimate("__old") == F.hll_sketch_estimate("sketch")
        merged = merged.join(before, keys, "left").select(
            *keys, F.when(same, F.col("__old")).otherwise(F.col("sketch")).alias("sketch"), F.when(same, F.col("__old_ts")).otherwise(F.col("ts")).alias("ts")
        )
    return merged, returned


def read_hll(state: DataFrame, wanted: DataFrame, *, keys: list[str] = CELL) -> DataFrame:
    """``keys, estimate, ts`` of the wanted cells; (-1, -1) for a cell that isn't there."""
    return wanted.select(*keys).join(state.select(*keys, "sketch", "ts"), keys, "left").select(
        *keys, F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(-1)).alias("estimate"), F.coalesce("ts", F.lit(-1)).alias("ts")
    )


def read_hll_bulk(state: DataFrame, *, keys: list[str] = CELL, compat: bool = False) -> DataFrame:
    """Estimates of all cells; with ``compat`` one per row, that of its last cell in scan order."""
    all_cells = state.select(*keys, F.hll_sketch_estimate("sketch").alias("estimate"), "ts")
    if not compat:
        return all_cells
    last = Window.partitionBy(keys[0]).orderBy(*[F.col(k).desc() for k in keys[1:]])
    return all_cells.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def cms_shape(eps: float, confidence: float) -> tuple[int, int]:
    """Depth and width for an error of ``eps`` of the total at a confidence."""
    return math.ceil(-math.log(1 - confidence) / math.log(2)), math.ceil(2 / eps)


def _buckets(item: Column, depth: int, width: int, seed: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda d: F.struct(d.alias("depth"), F.pmod(F.xxhash64(item, d, F.lit(seed)), F.lit(width)).cast("int").alias("bucket")))


def build_cms(items: DataFrame, item: str, *, keys: list[str], count: str | None = None, depth: int = 7, width: int = 2000, seed: int = 0) -> DataFrame:
    """``keys, depth, bucket, cnt``: counters of the items of each cell; ``count`` names a weight column.

    Equal items are summed before they are spread over the depths.
    """
    weighed = items.groupBy(*keys, F.col(item).alias("__item")).agg((F.sum(count) if count else F.count("*")).cast("bigint").alias("__cnt"))
    return (
        weighed.select(*keys, F.inline(_buckets(F.col("__item"), depth, width, seed)), "__cnt")
        .groupBy(*keys, "depth", "bucket")
        .agg(F.sum("__cnt").alias("cnt"))
    )


def merge_cms(*states: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of sketches of one shape."""
    merged = states[0]
    for s in states[1:]:
        merged = merged.unionByName(s)
    return merged.groupBy(*keys, "depth", "bucket").agg(F.sum("cnt").alias("cnt"))


def estimate_cms(state: DataFrame, items: DataFrame, item: str, *, keys: list[str], depth: int = 7, width: int = 2000, seed: int = 0) -> DataFrame:
    """``keys, item, estimate`` of candidate items: the least of their counters, 0 where one is absent."""
    asked = items.select(*keys, F.col(item).alias(item)).distinct()
    spread = asked.select(*keys, item, F.inline(_buckets(F.col(item), depth, width, seed)))
    return (
        spread.join(state, [*keys, "depth", "bucket"], "left")
        .groupBy(*keys, item)
        .agg(F.min(F.coalesce("cnt", F.lit(0))).cast("bigint").alias("estimate"))
    )


def summary_cms(estimates: DataFrame, item: str, *, keys: list[str]) -> DataFrame:
    """Statistics of the multiset that holds each item as often as estimated: ``n, total, mean, variance, stddev, least, most``.

    Closed forms over the items, so the work doesn't depend on the counts.
    """
    x, c = F.col(item).cast("double"), F.col("estimate")
    sums = estimates.where(c > 0).groupBy(*keys).agg(
        F.sum(c).cast("bigint").alias("n"), F.sum(x * c).alias("total"), F.sum(x * x * c).alias("squares"), F.min(x).alias("least"), F.max(x).alias("most")
    )
    n = F.col("n")
    variance = F.when(n > 1, (F.col("squares") - F.col("total") * F.col("total") / n) / (n - 1)).otherwise(F.lit(0.0))
    return sums.select(*keys, "n", "total", (F.col("total") / n).alias("mean"), variance.alias("variance"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("stddev"), "least", "most")


def upsert_cms(state: DataFrame, times: DataFrame, delta: DataFrame, delta_times: DataFrame, *, keys: list[str] = CELL) -> tuple[DataFrame, DataFrame]:
    """Counters and times after an upsert: counters add up, a cell's time is the larger; an absent cell is stored."""
    newer = times.unionByName(delta_times).groupBy(*keys).agg(F.max("ts").alias("ts"))
    return merge_cms(state, delta, keys=keys), newer
