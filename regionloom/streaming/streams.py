"""Stream computations.  Each takes a DataFrame that may be a batch or a stream, unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.regions import compact_label, known_tags, region_encoded, region_table
from ..operators import sketches
from ..plans.numbering import numbered
from ..schema import REGION_LOAD_METRICS


def region_gauges(region_load: DataFrame) -> DataFrame:
    """``metric, value, ts, tags, label``: a point per region and metric of each snapshot."""
    table, region = region_table(F.col("region_name")), region_encoded(F.col("region_name"))
    points = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in REGION_LOAD_METRICS])
    # names are read once a snapshot, before it becomes a row per metric
    named = region_load.select(
        points.alias("points"),
        F.col("snapshot_ts").alias("ts"),
        known_tags(server=F.col("server"), table=table, region=region).alias("tags"),
        compact_label(table, region).alias("label"),
    )
    return named.select("ts", "tags", "label", F.inline("points")).select("metric", "value", "ts", "tags", "label")


def locality_gauge(regions: DataFrame, ts) -> DataFrame:
    """``metric, value, ts, region_id``: local share in percent of regions with ``size, transfer``."""
    share = F.when(F.col("size") == 0, F.lit(1.0)).otherwise((F.col("size") - F.col("transfer")) / F.col("size"))
    return regions.select(F.lit("localityPercent").alias("metric"), (share * 100).alias("value"), F.lit(ts).alias("ts"), "region_id")


def left_transition(polls: DataFrame) -> DataFrame:
    """``poll_id, region``: regions of a poll that the next poll, here named, no longer has.  For a batch.

    The last poll's regions are still in transition.
    """
    ids = numbered(polls.select("poll_id").distinct(), "n", "poll_id")
    ids = ids.join(ids.select(F.col("poll_id").alias("next_id"), (F.col("n") - 1).alias("n")), "n").drop("n")
    gone = polls.join(ids, "poll_id").select(F.col("next_id").alias("poll_id"), "region")
    return gone.join(polls.select("poll_id", "region"), ["poll_id", "region"], "left_anti")


def watch_transitions(polls: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    """Run ``act(left, batch_id)`` with the regions that left transition, poll by poll, over a stream of polls.

    The last poll of a batch is carried to the next one as a table beside the
    checkpoint, so polls may be cut into batches anywhere.
    """
    spark = polls.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        carried = spark.read.schema(batch.schema).parquet(f"{checkpoint}/last/{batch_id - 1}") if batch_id else batch.limit(0)
        both = carried.unionByName(batch).distinct()
        newest = both.agg(F.max("poll_id").alias("m")).first()["m"]
        act(left_transition(both), batch_id)
        both.where(F.col("poll_id") == newest).write.mode("overwrite").parquet(f"{checkpoint}/last/{batch_id}")

    return polls.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/stream").trigger(**trigger).start()


def breaker_windows(
    requests: DataFrame, *, window: str = "10 seconds", slide: str | None = None, least_requests: int = 10, error_percent: float = 25.0, late: str | None = None
) -> DataFrame:
    """``server, window_start, requests, errors, open``: error rates of ``requests(server, ts, ok)`` per window.

    The breaker is open in a window of enough requests and enough errors.  ``late``
    is the watermark of a stream.
    """
    r = requests.withWatermark("ts", late) if late else requests
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    failed = F.sum(F.when(F.col("ok"), F.lit(0)).otherwise(F.lit(1)))
    counts = r.groupBy("server", at.alias("w")).agg(F.count("*").alias("requests"), failed.alias("errors"))
    opened = (F.col("requests") >= least_requests) & (F.col("errors") * 100.0 / F.col("requests") >= error_percent)
    return counts.select("server", F.col("w.start").alias("window_start"), "requests", "errors", opened.alias("open"))


def upsert_hll_stream(items: DataFrame, item: str, *, keys: list[str], ts: str = "ts", lg_k: int = sketches.DEFAULT_LG_K) -> DataFrame:
    """A running sketch per cell over a stream of items; write it in update or complete mode.

    Registers and times are joined by unions and maxima, so batch limits don't matter.
    """
    return sketches.build_hll(items, item, keys=keys, ts=ts, lg_k=lg_k).select(*keys, F.hll_sketch_estimate("sketch").alias("estimate"), "sketch", "ts")


def keep_hll_state(items: DataFrame, item: str, path: str, trigger: dict, *, keys: list[str], ts: str = "ts", lg_k: int = sketches.DEFAULT_LG_K) -> StreamingQuery:
    """Keep a table of sketches per cell below ``path``, one version per batch, from a stream of items.

    A batch that is run again writes the same version from the same version before
    it, so a restart neither loses nor doubles anything.  `hll_state` reads it.
    """
    spark = items.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        delta = sketches.build_hll(batch, item, keys=keys, ts=ts, lg_k=lg_k)
        if batch_id:
            delta = sketches.merge_hll(spark.read.parquet(f"{path}/version={batch_id - 1}"), delta, keys=keys)
        delta.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return items.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/_checkpoint").trigger(**trigger).start()


def hll_state(spark, path: str, version: int) -> DataFrame:
    """A version of the table that `keep_hll_state` writes."""
    return spark.read.parquet(f"{path}/version={version}")


def write_gauges(points: DataFrame, path: str, trigger: dict) -> StreamingQuery:
    """Append a stream of gauge points to a table."""
    return points.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}/_checkpoint").outputMode("append").trigger(**trigger).start()


def repeat_plan(ticks: DataFrame, plan: Callable[[int], None], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Run a planner again and again: once per trigger of any stream of ticks."""
    return ticks.writeStream.foreachBatch(lambda _, batch_id: plan(batch_id)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
