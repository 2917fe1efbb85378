"""Quality rules, line first: bad lines go, then documents that lost too much.

Each line that holds a word is held against rules for punctuation, navigation and
boilerplate.  Failing lines are removed; a document that loses more than a stated
share of its characters, or fails the two counts below, is rejected.  Everything
is built-in functions over one row, so the corpus is never shuffled.

The repeated-word count marks the words that lie in a window of three consecutive
words which the text holds at least twice.  Windows are sorted once per text, so
equal windows are neighbours; texts without a repeated window skip the sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: A document may lose this share of the characters of its lines.
MOST_LOST_PERCENT = 50

#: Characters of a short line: longer ones aren't page furniture.
SHORT_LINE = 160

#: Phrases of page furniture, in lower case (fixed values).
BOILERPLATE = (
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|accept (?:all )?cookies|enable javascript"
    r"|javascript is (?:disabled|required)|lorem ipsum|click here|read more|sign (?:in|up)\b|log ?in\b|subscribe (?:now|to our)|share (?:this|on)"
    r"|add to cart|back to top|skip to (?:main )?content|powered by|copyright (?:\(c\)|©)|follow us on|page not found"
    r"|alle rechte vorbehalten|datenschutzerkl|todos los derechos|política de (?:privacidad|cookies)|tous droits réservés|mentions légales"
)


#: Every mark that the line rules count, and the white space of `T.WHITE_SPACE`.
_MARKS, _EXCLAIM, _SEPARATORS = "#*$%&<>=~^\\{}@_", "!", "|»›•→"
_ANY_MARK = r"[#*$%&<>=~^\\{}@_!|»›•→]"
#: A phrase starts where no letter precedes it, which spares most positions the comparison.
_FURNITURE = rf"(?:^|[^a-z])(?:{BOILERPLATE})"


def _many(text: Column, marks: str) -> Column:
    """How many characters of a text are among ``marks``."""
    return F.length(text) - F.length(F.translate(text, marks, ""))


def line_passes(line: Column) -> Column:
    """Whether a line that holds a word passes every rule.

    Punctuation: it ends a sentence somewhere, and marks other than sentence
    punctuation are at most one to three words; exclamation marks likewise.
    Navigation: fewer than three separators (``|``, ``»``, ``›``, ``•``, ``→``), or
    less than one to six words.  Boilerplate: it isn't a short line around a
    phrase of `BOILERPLATE`.
    """
    n = F.greatest(T.word_count(line), F.lit(1))
    ends = line.rlike(r"[.!?…。！？:;][\"'”’»)\]]*(?:\s|$)")
    separators = _many(line, _SEPARATORS)
    overdone = (_many(line, _MARKS) * 3 > n) | (_many(line, _EXCLAIM) * 3 > n) | ((separators >= 3) & (separators * 6 > n))
    # Counting marks is dear, so lines without any are told apart first.
    marked = F.when(line.rlike(_ANY_MARK), overdone).otherwise(F.lit(False))
    furniture = F.when(F.length(line) <= SHORT_LINE, F.lower(line).rlike(_FURNITURE)).otherwise(F.lit(False))
    return ends & ~marked & ~furniture


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that the array holds at least twice.

    Windows are ordered by a hash, and neighbours of one hash compared word by word.
    """

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

        def covered(g: Column) -> Column:
            ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def twice(s: Column) -> Column:
                def same(a: Column, b: Column) -> Column:
                    i, j = a["i"], b["i"]
                    return (a["h"] == b["h"]) & (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])

                last = F.size(s) - 1
                found = F.filter(s, lambda x, k: ((k > 0) & same(x, s[F.greatest(k - 1, F.lit(0))])) | ((k < last) & same(x, s[F.least(k + 1, last)])))
                return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

            return T.bound(ordered, twice)

        return T.bound(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted(words)).cast("long")


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every row of ``docs``, and its cleaned text.

    Columns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lines, n_lines_kept, cleaned``.  A null or
    empty text has no words and fails.  Lines without a word count neither as lost
    nor as kept and stay in ``cleaned``.  Null ids and repeated rows are rows like
    any other, other columns are ignored, an empty table gives an empty result.
    """
    text = T.whole(F.col(text_col))
    has_word = r"[^\x20\x09-\x0D]"

    def judged(x: Column) -> Column:
        full = x.rlike(has_word)
        return F.struct(x.alias("line"), full.alias("full"), F.when(full, line_passes(x)).otherwise(F.lit(True)).alias("stays"))

    def characters(lines: str, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(lines, F.lit(0).cast("long"), lambda total, x: total + F.when(of(x), F.length(x["line"])).otherwise(F.lit(0)))

    def full(x: Column) -> Column:
        return x["full"]

    def passing(x: Column) -> Column:
        return x["full"] & x["stays"]

    def words_of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeated"))

    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    parts = rows.select(
        "doc_id",
        F.when(F.col("text").rlike(r"[#*$%&|<>]"), _many(F.col("text"), "#*$%&|<>")).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
        T.bound(T.words(F.col("text")), words_of).alias("w"),
        F.transform(F.split("text", "\n"), judged).alias("l"),
    )
    counted = parts.select(
        "doc_id",
        F.col("w.n").alias("n_words"),
        F.col("w.chars").alias("word_chars"),
        "n_symbols",
        (F.size(F.filter("l", full)) - F.size(F.array_distinct(F.transform(F.filter("l", full), lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        F.col("w.repeated").alias("n_repeat_words"),
        F.size(F.filter("l", full)).cast("long").alias("n_lines"),
        F.size(F.filter("l", passing)).cast("long").alias("n_lines_kept"),
        characters("l", full).alias("all_chars"),
        characters("l", passing).alias("kept_chars"),
        F.array_join(F.transform(F.filter("l", lambda x: x["stays"]), lambda x: x["line"]), "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    lost = (F.col("all_chars") - F.col("kept_chars")) * 100 > F.col("all_chars") * MOST_LOST_PERCENT
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~lost).alias("kept"), "n_lines", "n_lines_kept", "cleaned"
    )
