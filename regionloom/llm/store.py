"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a recomputation.  The setting
is read from the session; only in local mode (tests, a laptop) may it be unset, and
a folder below the warehouse directory stands in for it.  Tables that no result
reads any more are dropped by who wrote them, the rest when the driver exits.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash; an error on a cluster that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_regionloom_shared"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver exits."""
    path = f"{shared_folder(spark)}/regionloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """What has been written so far, for `drop_since`."""
    return len(_written)


def drop_since(since: int, *, but: int = 0) -> None:
    """Delete the tables written since a mark, except the last ``but`` of them."""
    last = len(_written) - but
    gone, _written[since:last] = _written[since:last], []
    for spark, path in gone:
        drop(spark, path)


@atexit.register
def _drop_all() -> None:
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
