"""Rows counted under a masked row key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import in_key_range, mask_key


def group_key_count(cells: DataFrame, mask: bytes, *, start: bytes = b"", stop: bytes = b"", row_col: str = "row", one_cell_a_row: bool = False) -> DataFrame:
    """``row_key, n_rows``: how many rows of ``[start, stop)`` fall under each masked key.

    A row counts once however many cells it has; pass ``one_cell_a_row`` to spare
    the deduplication where the input is known to have one.  Counts are summed in
    each task before the shuffle.
    """
    rows = cells.select(F.col(row_col).alias("row")).where(F.col("row").isNotNull())
    if start or stop:
        rows = rows.where(in_key_range(F.col("row"), start, stop))
    if not one_cell_a_row:
        rows = rows.distinct()
    return rows.groupBy(mask_key(F.col("row"), mask).alias("row_key")).agg(F.count("*").alias("n_rows"))
