"""Text and JSON inputs and outputs: region lists, file-system check logs, region statistics, file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import REGION_STATS

#: Line formats of a file-system check log (fixed values).
FILE_LINE = r"^(\S+) (\d+) bytes, (\d+) block.*"
BLOCK_LINE = r"^\d+.*? len=(\d+).*?\[(.*?)\].*"
#: A region's directory name (fixed value).
REGION_NAME = r"^[a-f0-9]{32}$"


def read_region_stats(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Region statistics from JSON lines, gunzipped where the name ends in ``.gz``; an unreadable row is an error."""
    stats = spark.read.schema(REGION_STATS).option("mode", "FAILFAST").json(path)
    return stats if table is None else stats.where(F.lower("regionInfo.table_name") == table.lower())


def write_region_stats(stats: DataFrame, path: str, *, compressed: bool = False) -> None:
    stats.write.mode("errorifexists").json(path, compression="gzip" if compressed else "none")


def read_region_list(spark: SparkSession, path: str) -> DataFrame:
    """``encoded_name, server`` of a text file of lines ``<region> <server>``; a region's last line counts."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).where("v <> ''")
    parts = lines.select(F.split("v", r"\s").alias("p"), "f", "n").where(F.size("p") >= 2)
    last = Window.partitionBy("encoded_name").orderBy(F.desc("f"), F.desc("n"))
    return (
        parts.select(F.col("p")[0].alias("encoded_name"), F.col("p")[1].alias("server"), "f", "n")
        .withColumn("r", F.row_number().over(last))
        .where("r = 1")
        .select("encoded_name", "server")
    )


def match_region_list(listed: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed rows of known regions, and the rejected rows of unknown ones."""
    known = regions.select("encoded_name").distinct()
    return listed.join(known, "encoded_name", "left_semi"), listed.join(known, "encoded_name", "left_anti")


def write_region_list(placed: DataFrame, path: str, *, append: bool = False) -> None:
    """Lines ``<region> <server>``."""
    lines = placed.select(F.concat_ws(" ", "encoded_name", "server").alias("value"))
    lines.write.mode("append" if append else "overwrite").text(path)


def read_check_log(spark: SparkSession, path: str, servers: DataFrame) -> DataFrame:
    """``file, block_no, size, replicas`` of a file-system check log; replicas are servers by their address.

    A paragraph is a file and its blocks.  Addresses that belong to no server are
    dropped; a file without blocks has none.
    """
    records = spark.read.option("lineSep", "\n\n").text(path).select(F.split(F.trim("value"), "\n").alias("lines"))
    files = records.select(
        F.regexp_extract(F.col("lines")[0], FILE_LINE, 1).alias("file"),
        F.posexplode(F.filter("lines", lambda x: x.rlike(BLOCK_LINE))).alias("block_no", "line"),
    ).where("file <> ''")
    blocks = files.select(
        "file",
        "block_no",
        F.regexp_extract("line", BLOCK_LINE, 1).cast("bigint").alias("size"),
        F.transform(F.split(F.regexp_extract("line", BLOCK_LINE, 2), ", "), lambda a: F.split_part(a, F.lit(":"), F.lit(1))).alias("ips"),
    )
    resolved = (
        blocks.select("file", "block_no", F.explode("ips").alias("ip"))
        .join(servers.select("ip", "server"), "ip")
        .groupBy("file", "block_no")
        .agg(F.sort_array(F.collect_set("server")).alias("replicas"))
    )
    return blocks.join(resolved, ["file", "block_no"], "left").select("file", "block_no", "size", F.coalesce("replicas", F.array().cast("array<string>")).alias("replicas"))


def attribute_files(files: DataFrame, regions: DataFrame, *, path_col: str = "path") -> DataFrame:
    """``path, region_path``: the deepest known region directory above each file.

    Only files whose own name is 32 hexadecimal digits count; a directory whose
    name starts with a dot cuts off what is above it.
    """
    parts = F.split(F.col(path_col), "/")
    named = files.select(F.col(path_col).alias("path"), parts.alias("parts")).where(F.element_at("parts", -1).rlike(REGION_NAME))
    above = named.select(
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(2), F.size("parts") - 1),
                lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("parts", 1, n), "/").alias("dir"), F.exists(F.slice("parts", n, F.size("parts") - n), lambda d: d.startswith(".")).alias("cut")),
            )
        ).alias("a"),
    ).where(~F.col("a.cut"))
    hit = above.join(regions.select(F.col("region_path").alias("dir")), F.col("a.dir") == F.col("dir"))
    return hit.groupBy("path").agg(F.max_by("dir", "a.depth").alias("region_path"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modification_time, visible`` of the files below a directory; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(
        "path",
        "length",
        F.unix_millis("modificationTime").alias("modification_time"),
        (~F.element_at(F.split("path", "/"), -2).startswith(".")).alias("visible"),
    )
