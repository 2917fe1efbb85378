"""Expressions over region statistics, names and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_transfer(size: Column, replicas: Column, server: Column) -> Column:
    """Bytes of a block that a server would have to read from elsewhere."""
    return F.when(F.array_contains(replicas, server), F.lit(0)).otherwise(size).cast("long")


def storage_transfer(storage: Column, server: Column) -> Column:
    """The same over nested storage (files of blocks); 0 where storage is unknown."""
    per_file = F.transform(
        storage,
        lambda f: F.aggregate(f["hdfsBlockInfos"], F.lit(0).cast("long"), lambda total, b: total + block_transfer(b["size"], b["replicas"], server)),
    )
    return F.coalesce(F.aggregate(per_file, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))


def file_count(storage: Column) -> Column:
    return F.when(storage.isNull(), F.lit(0)).otherwise(F.size(storage))


def locality(size: Column, transfer: Column) -> Column:
    """Share of the bytes that are local: 1 for nothing to read, an error for an unknown size."""
    known = F.when(size.isNull(), F.raise_error(F.lit("locality needs a size")).cast("long")).otherwise(size)
    return F.when(known == 0, F.lit(1.0)).otherwise((known - transfer) / known)


def region_table(name: Column) -> Column:
    """Table of a full region name ``table,startkey,ts.encoded.``; META and ROOT for the catalog's own regions."""
    return F.when(name.contains(".META."), F.lit("META")).when(name.contains("-ROOT-"), F.lit("ROOT")).otherwise(F.split_part(name, F.lit(","), F.lit(1)))


def region_encoded(name: Column) -> Column:
    """Encoded part of a full region name: the last piece between dots that isn't empty; null for the catalog's own."""
    pieces = F.filter(F.split(name, r"\."), lambda p: p != "")
    return F.when(name.contains(".META.") | name.contains("-ROOT-"), F.lit(None)).otherwise(F.try_element_at(pieces, F.lit(-1)))


def compact_label(table: Column, region: Column) -> Column:
    """``table.region`` if both are known, else null."""
    return F.when(table.isNotNull() & region.isNotNull(), F.concat_ws(".", table, region))


def known_tags(**tags: Column) -> Column:
    """A map of the tags that have a value."""
    pairs = [x for name, value in tags.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def pretty_bytes(size: Column) -> Column:
    """Bytes below 2048 as they are, else whole binary units, rounded down."""
    shown = F.concat(size.cast("string"), F.lit(""))
    for power, unit in ((10, "KB"), (20, "MB"), (30, "GB"), (40, "TB"), (50, "PB"), (60, "EB")):
        shown = F.when(size >= (1 << power), F.format_string(f"%d {unit}", F.shiftright(size, power))).otherwise(shown)
    return F.when(size < 2048, size.cast("string")).otherwise(shown)


def short_host(host: Column) -> Column:
    """A host name up to its first dot; the text "null" for none."""
    return F.when(host.isNull() | (host == ""), F.lit("null")).otherwise(F.split_part(host, F.lit("."), F.lit(1)))


def listed_in(value: Column, comma_list: str) -> Column:
    """Whether a value is in a comma-separated list: case counts, blanks are part of a name."""
    return value.isin(*comma_list.split(","))


def same_name(value: Column, name: str) -> Column:
    """Equality without regard to case."""
    return F.lower(value) == name.lower()
