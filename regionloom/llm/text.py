"""Column helpers that the text operators share (JVM side only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda variable is the one thing the optimizer can't inline, so an array
    used inside another lambda isn't computed again for each element.
    """
    return F.transform(F.array(value), body)[0]


def running(values: Column, start: Column, combine: Callable[[Column, Column], Column], stretch: int = 512) -> Column:
    """Running totals (inclusive) of an array of longs under an associative ``combine`` that ``start`` leaves alone.

    Arrays can't be added to in place, so a fold over all of it would copy the square
    of its length; folds over stretches, and one over their totals, copy far less.
    """

    def fold(array: Column) -> Column:
        """``start`` and the running totals after it."""
        return F.aggregate(array, F.array(start), lambda done, x: F.concat(done, F.array(combine(F.element_at(done, -1), x))))

    def joined(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / stretch).cast("int")), lambda k: fold(F.slice(v, k * stretch + 1, stretch)))
        return bound(
            cut,
            lambda parts: bound(
                fold(F.transform(parts, lambda p: F.element_at(p, -1))),
                lambda before: F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(p, 2, stretch), lambda x: combine(before[k], x)))),
            ),
        )

    return bound(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(joined(v)))


def whole(text: Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a non-null text, in order."""
    return F.array_remove(F.split(text, WHITE_SPACE), "")


def word_count(text: Column) -> Column:
    """Number of words of a non-null text."""
    return F.size(words(text)).cast("long")


def utf8_bytes(text: Column) -> Column:
    """Length in UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
