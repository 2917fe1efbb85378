"""Row-key expressions: masked prefixes, unsigned key positions, key ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One above the largest unsigned 64-bit value, as text for decimal literals.
KEY_SPACE_END = "18446744073709551615"


def _byte_at(value: Column, position: Column) -> Column:
    return F.conv(F.hex(F.substring(value, position, F.lit(1))), 16, 10).cast("int")


def mask_key(row: Column, mask: bytes) -> Column:
    """The first ``min(len(mask), len(row))`` bytes of a binary key, each ANDed with its mask byte.

    A mask of 0xFF bytes is a plain prefix, which stays inside generated code and
    keeps min/max statistics usable.
    """
    if not mask:
        return F.when(row.isNotNull(), F.lit(b""))
    if all(b == 0xFF for b in mask):
        return F.substring(row, 1, len(mask))
    masks = F.array(*[F.lit(b) for b in mask])
    n = F.least(F.length(row), F.lit(len(mask)))
    masked = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.lpad(F.hex(_byte_at(row, i).bitwiseAND(F.element_at(masks, i)).cast("long")), 2, "0")
    )
    return F.when(n == 0, F.lit(b"")).otherwise(F.unhex(F.array_join(masked, "")))


def key_position(key: Column) -> Column:
    """The first eight bytes of a binary key, zero-padded on the right, as an unsigned number."""
    eight = F.substring(F.rpad(key, 8, b"\x00"), 1, 8)
    return F.conv(F.hex(eight), 16, 10).cast("decimal(21,0)")


def range_start(key: Column) -> Column:
    """Position of a range's first key; an empty key is the open start."""
    return F.when(F.length(key) == 0, F.lit(0).cast("decimal(21,0)")).otherwise(key_position(key))


def range_end(key: Column) -> Column:
    """Position of a range's end key; an empty key is the open end."""
    return F.when(F.length(key) == 0, F.lit(KEY_SPACE_END).cast("decimal(21,0)")).otherwise(key_position(key))


def in_key_range(row: Column, start: bytes = b"", stop: bytes = b"") -> Column:
    """``start <= row < stop``; an empty bound is open.  Plain comparisons, so that they reach the scan."""
    test = F.lit(True)
    if start:
        test = row >= F.lit(start)
    if stop:
        test = test & (row < F.lit(stop)) if start else row < F.lit(stop)
    return test
