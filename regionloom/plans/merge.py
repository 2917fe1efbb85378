"""Plans that merge neighbouring regions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contiguity(ranges: DataFrame) -> DataFrame:
    """``ranges`` with ``next_start`` and ``contiguous``: whether each range ends where its table's next one starts.

    The last range of a table has no next one and counts as contiguous.
    """
    ordered = Window.partitionBy("table_name").orderBy("start_pos")
    following = ranges.withColumn("next_start", F.lead("start_pos").over(ordered))
    return following.withColumn("contiguous", F.col("next_start").isNull() | (F.col("next_start") == F.col("end_pos")))


def _walked(regions: DataFrame) -> DataFrame:
    """``table_name, rs``: a table's regions in key order.  A table's region list is metadata of bounded size."""
    return regions.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("start_pos", "region_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")))).alias("rs"))


_ID = "array<array<bigint>>"


def _groups(walked: DataFrame, groups: Column, least: int = 2) -> DataFrame:
    """``table_name, group_no, region_ids`` of the groups with enough regions, in key order."""
    kept = F.filter(groups, lambda g: F.size(g) >= least)
    return walked.select("table_name", F.posexplode(kept).alias("group_no", "region_ids"))


def merge_groups(regions: DataFrame, *, factor: int = 2, max_file_size: int, compat: bool = False) -> DataFrame:
    """Full-table merge: neighbours are joined until ``factor`` regions, or half the largest file size, are together.

    A region that alone reaches half the largest size forms a group of one and is
    skipped; with ``compat`` it ends its table's plan.
    """
    walked = _walked(regions)
    half = max_file_size / 2

    def step(state: Column, r: Column) -> Column:
        ids = F.concat(state["ids"], F.array(r["region_id"]))
        size = state["size"] + r["size"]
        full = (F.size(ids) >= factor) | (size >= half)
        return F.struct(
            F.when(full, F.array().cast("array<bigint>")).otherwise(ids).alias("ids"),
            F.when(full, F.lit(0).cast("bigint")).otherwise(size).alias("size"),
            F.when(full, F.concat(state["out"], F.array(ids))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("bigint").alias("size"), F.array().cast(_ID).alias("out"))
    groups = F.aggregate("rs", start, step, lambda s: F.when(F.size(s["ids"]) > 0, F.concat(s["out"], F.array(s["ids"]))).otherwise(s["out"]))
    if compat:
        first_single = F.transform(groups, lambda g: F.size(g) < 2)
        stop = F.array_position(first_single, F.lit(True))
        groups = F.when(stop > 0, F.slice(groups, F.lit(1), (stop - 1).cast("int"))).otherwise(groups)
    return _groups(walked, groups)


def merge_empty_groups(regions: DataFrame) -> DataFrame:
    """Merge of empty regions into a neighbour that isn't.

    A run of empty regions joins the region before it if that is remembered, else
    the one after it; a region that took the run before it isn't remembered for the
    next run.  A run at the end joins what is remembered or stays.
    """
    walked = _walked(regions)
    none = F.array().cast("array<bigint>")

    def step(s: Column, r: Column) -> Column:
        empty = r["size"] == 0
        one = F.array(r["region_id"])
        run, before = s["run"], s["before"]
        pending, remembered = F.size(run) > 0, F.size(before) > 0
        group = F.when(remembered, F.concat(before, run)).otherwise(F.concat(run, one))
        return F.struct(
            F.when(empty, F.concat(run, one)).otherwise(none).alias("run"),
            # the region that ends a run is remembered unless it took the run itself
            F.when(empty, before).when(pending & ~remembered, none).otherwise(one).alias("before"),
            F.when(~empty & pending, F.concat(s["out"], F.array(group))).otherwise(s["out"]).alias("out"),
        )

    start = F.struct(none.alias("run"), none.alias("before"), F.array().cast(_ID).alias("out"))

    def finish(s: Column) -> Column:
        last = (F.size(s["run"]) > 0) & (F.size(s["before"]) > 0)
        return F.when(last, F.concat(s["out"], F.array(F.concat(s["before"], s["run"])))).otherwise(s["out"])

    return _groups(walked, F.aggregate("rs", start, step, finish))


def merged_catalog(ranges: DataFrame, groups: DataFrame) -> DataFrame:
    """``table_name, start_pos, end_pos, n_merged`` after the groups are merged: untouched ranges, and one for each group.

    A group whose ranges have a gap is refused with an error.
    """
    member = groups.select(F.col("table_name").alias("g_table"), "group_no", F.explode("region_ids").alias("g_region"))
    keys = (ranges.table_name == member.g_table) & (ranges.region_id == member.g_region)
    untouched = ranges.join(member, keys, "left_anti").select("table_name", "start_pos", "end_pos", F.lit(1).cast("bigint").alias("n_merged"))
    inside = ranges.join(member, keys).groupBy("table_name", "group_no").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("covered"), F.count("*").alias("n_merged")
    )
    whole = F.when(F.col("covered") == F.col("end_pos") - F.col("start_pos"), F.col("n_merged")).otherwise(F.raise_error(F.lit("ranges to merge must be contiguous")).cast("bigint"))
    return untouched.unionByName(inside.select("table_name", "start_pos", "end_pos", whole.alias("n_merged")))


def merged_counters(groups: DataFrame, counters: DataFrame, columns: list[str]) -> DataFrame:
    """``table_name, group_no, n_regions`` and the sums of the counters of each group's regions."""
    member = groups.select("table_name", "group_no", F.explode("region_ids").alias("region_id"))
    return member.join(counters, ["table_name", "region_id"]).groupBy("table_name", "group_no").agg(
        F.count("*").alias("n_regions"), *[F.sum(c).cast("bigint").alias(c) for c in columns]
    )
