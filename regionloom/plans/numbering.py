"""Row numbers over a whole table, without taking it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges into which rows are cut, and rows that set their limits.
RANGES, SAMPLED = 64, 4096


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with their place from 0 on in ``order``, as column ``name``.

    The limits of `RANGES` ranges of the first order column are taken from the rows
    whose hash is lowest, a fixed number; each range is numbered in a task of its own
    and begins where the ranges before it end.  Limits only decide how evenly rows
    are spread, so any will do.  Rows that tie in all of ``order`` are numbered at will.
    """
    first = rows.select((F.col(order[0]) if isinstance(order[0], str) else order[0]).alias("v")).where("v is not null")
    sample = first.orderBy(F.xxhash64("v")).limit(SAMPLED).distinct().orderBy("v").collect()
    limits = [F.lit(sample[k * len(sample) // RANGES]["v"]) for k in range(1, RANGES)] if len(sample) >= RANGES else []
    value = F.col(order[0]) if isinstance(order[0], str) else order[0]
    above = sum((F.when(value >= x, F.lit(1)).otherwise(F.lit(0)) for x in limits), F.lit(0))
    ranged = rows.withColumn("__range", above)
    before = Window.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    # at most `RANGES` rows
    return ranged.withColumn(name, inside).join(F.broadcast(starts), "__range").withColumn(name, F.col(name) + F.col("__start")).drop("__range", "__start")
