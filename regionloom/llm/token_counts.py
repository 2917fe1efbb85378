"""Token counts by a map-side two-tier lookup of pre-token lengths.

Tier one is a broadcast hash table ``pre-token -> number of tokens`` for the
pre-tokens the vocabulary itself holds whole; a subword vocabulary is the list
of the frequent pre-tokens of the text it was made from, and its size (a few
tens of thousands of entries) does not depend on the corpus.  Tier two is a
bounded cache in each Python worker: pre-tokens outside the table are encoded
once by the library and remembered.  A text never leaves its task, so there is
no shuffle of pre-tokens.

The count of a text is the sum over its pre-tokens, because subword merges never
cross a pre-token.  Texts of stable Latin characters are cut by a local regular
expression that agrees with the library's splitter there; every other text is
normalised and cut by the library itself.  A text that holds the string of a
special token goes to the library as a whole, which is the library's default.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from . import text as T

#: Characters for which normalising is lower-casing, and for which all Unicode
#: versions agree on letter, number and space.
STABLE = regex.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\\xa1-\\u012f\\u0131-\\u017f\\u2010-\\u2015\\u2018-\\u201f\\u2022\\u2026\\u20ac]*+")

#: Longer pre-tokens are encoded each time: they are rare and would fill the cache.
LONGEST_CACHED = 48


def default_tokenizer_path() -> str:
    """The path of the lower-casing word BPE among the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_pattern(path: str) -> str:
    """The pattern by which the tokenizer file cuts normalised text."""
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)["pre_tokenizer"]
    steps = stated.get("pretokenizers", [stated])
    found = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
    if len(found) != 1:
        raise ValueError("the tokenizer must cut text by one inverted, removing Split")
    return found[0]


class Lengths:
    """Counts tokens of texts in one Python worker."""

    def __init__(self, path: str, table: dict[str, int], cache_entries: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        pattern = split_pattern(path)
        self.cut = regex.compile(pattern).findall
        self.library_cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.table, self.cache_entries = table, cache_entries
        self.known = dict(table)

    def pre_tokens(self, text: str) -> list[str]:
        if STABLE.fullmatch(text):
            return self.cut(text.lower())
        return [w for w, _ in self.library_cut(self.library.normalizer.normalize_str(text))]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        cut = self.pre_tokens(text)
        misses = list(set(cut).difference(self.known))
        if misses:
            if len(self.known) + len(misses) > len(self.table) + self.cache_entries:
                self.known = dict(self.table)
                misses = list(set(cut).difference(self.known))
            found = self.library.encode_batch_fast(misses, add_special_tokens=False)
            self.known.update(zip(misses, map(len, found), strict=True))
        total = sum(map(self.known.__getitem__, cut))
        for w in misses:
            if len(w) > LONGEST_CACHED:
                del self.known[w]
        return total


def frequent_lengths(path: str, more: Iterable[str] = ()) -> dict[str, int]:
    """Token counts of the pre-tokens that the vocabulary holds whole, and of ``more``."""
    state = Lengths(path, {}, 1 << 30)
    model = json.loads(state.library.to_str())["model"]
    end = model.get("end_of_word_suffix") or ""
    ascii_words = {w.removesuffix(end) for w in model["vocab"] if w.endswith(end)}
    wanted = [w for w in {*ascii_words, *more} if w and state.pre_tokens(w) == [w]]
    found = state.library.encode_batch_fast(wanted, add_special_tokens=False)
    return dict(zip(wanted, map(len, found), strict=True))


_worker: dict[str, Lengths] = {}


def token_count(
    spark: SparkSession, text: Column, *, tokenizer_path: str | None = None, frequent: Iterable[str] = (), cache_entries: int = 300_000
) -> Column:
    """Tokens of ``text`` without begin, end or added special tokens; null counts as empty."""
    shipping.ship(spark)
    path = tokenizer_path or default_tokenizer_path()
    table = spark.sparkContext.broadcast(frequent_lengths(path, frequent))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _worker:
            _worker[path] = Lengths(path, table.value, cache_entries)
        state = _worker[path]
        for batch in batches:
            yield pd.Series([state.count(t) for t in batch], dtype="int64")

    return count(text)


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    tokenizer_path: str | None = None,
    frequent: Iterable[str] = (),
    cache_entries: int = 300_000,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    One row per input row, repeated rows and null ids included; a null or empty
    text has 0 bytes and 0 tokens; texts of any length are counted whole; other
    columns are ignored whatever their names.  ``over_limit`` is
    ``n_tokens > limit``.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.select(
        "doc_id",
        T.utf8_bytes(F.col("text")).alias("n_bytes"),
        token_count(docs.sparkSession, F.col("text"), tokenizer_path=tokenizer_path, frequent=frequent, cache_entries=cache_entries).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
