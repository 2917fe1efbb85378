"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are reduced to lower-case letters and digits with single
spaces.  An item of ``n`` characters may occur with up to ``k`` edits, ``k`` a fixed
share of ``n``.  Such an occurrence shares at least ``n + 1 - q - k * q`` character
q-grams with the item, and these lie on at most ``k + 1`` neighbouring diagonals
(position in the text minus position in the item).  Shared q-grams are counted in
diagonal bands of width ``2 (k + 1)`` that overlap by half, so that some band has
them all; places of the item count once, however often the text repeats them.  Bands
that reach the bound are joined to their neighbours and verified by an alignment
that is limited to the band, item against text with free ends.  All bands of a
buffer of texts are aligned together, row by row, and leave as soon as no cell is
within the budget; an item whose head many items share is aligned from its tail.

Items shorter than a q-gram must occur exactly, as whole words.

The benchmark's q-grams are broadcast.  Its size is measured first, and a benchmark
beyond `BLOCK_CHARS` is taken in blocks of that size, each a pass over the corpus.
Texts are never shuffled; q-grams of texts live in buffers of `BUFFER_CHARS`, and
their places in items are listed at most some `POSTINGS` at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shipping

Q = 12
#: Edits allowed per character of an item.
EDIT_SHARE = 0.06
#: Characters of a benchmark block; about 60 bytes each when broadcast and indexed.
BLOCK_CHARS = 4_000_000
#: Characters of texts hashed at once.
BUFFER_CHARS = 1_000_000
#: Places of shared q-grams listed at once, and cells of an alignment's row over all bands aligned at once.
POSTINGS, CELLS = 1 << 21, 1 << 18

_APART = re.compile(r"[\W_]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def plain(text: str | None) -> str:
    """Lower-case letters and digits, everything between them as one space."""
    return _APART.sub(" ", (text or "").lower()).strip()


def edit_budget(n: int, share: float = EDIT_SHARE, q: int = Q) -> int:
    """Edits allowed in an item of ``n`` characters: its share, as long as the lemma's bound stays at 4 or more."""
    return max(0, min(int(n * share), (n + 1 - q - 4) // q))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """Hash of the 12 characters from each position on."""
    if len(c) < Q:
        return np.empty(0, dtype=np.uint64)
    two = c[:-1] * _FACTORS[0] + c[1:]
    two ^= two >> np.uint64(29)
    four = two[:-2] * _FACTORS[1] + two[2:]
    four ^= four >> np.uint64(31)
    eight = four[:-4] * _FACTORS[2] + four[4:]
    twelve = eight[:-4] * _FACTORS[3] + four[8:]
    return (twelve ^ (twelve >> np.uint64(32))) * _FACTORS[0]


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: list
    texts: list[str]

    def __post_init__(self):
        self.length = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.budget = np.array([edit_budget(n) for n in self.length.tolist()], dtype=np.int64)
        self.least = np.maximum(self.length + 1 - Q - Q * self.budget, 1)
        self.width = self.budget + 1
        self.chars = np.concatenate([codes(t) for t in self.texts]).astype(np.uint32) if self.texts else np.empty(0, dtype=np.uint32)
        self.begin = np.cumsum(self.length) - self.length
        #: Items shorter than a q-gram, by their number of words.
        self.short: dict[int, dict[str, list[int]]] = {}
        for i in np.flatnonzero(self.length < Q).tolist():
            self.short.setdefault(self.texts[i].count(" ") + 1, {}).setdefault(self.texts[i], []).append(i)
        grams = [gram_hashes(codes(t)) for t in self.texts]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, dtype=np.int64)
        hashes = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, many = np.unique(hashes[order], return_counts=True)
        #: Ascending: q-gram, then item.
        self.posted = np.repeat(np.arange(len(many)) * len(self.texts), many) + self.item
        shared = np.where(2 * self.place < self.length[self.item], 1, -1) * np.repeat(many, many)
        #: Items that share more of their first half with others than of their second.
        self.from_tail = np.bincount(self.item, weights=shared, minlength=len(self.texts)) > 0
        bits = min(max(16, int(np.ceil(np.log2(max(len(self.grams), 1) * 64)))), 26)
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[self.grams >> self.shift] = True
        #: Longer than any occurrence; texts in a buffer lie so far apart that no band holds two of them.
        self.gap = int(self.length.max(initial=0)) + 8 * int(self.width.max(initial=1)) + Q

    def shared(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes are q-grams of items, and which."""
        at = np.flatnonzero(self.maybe[hashes >> self.shift])
        found = np.searchsorted(self.grams, hashes[at])
        same = (found < len(self.grams)) & (self.grams[np.minimum(found, len(self.grams) - 1)] == hashes[at])
        return at[same], found[same]

    def bands(self, at: np.ndarray, found: np.ndarray, first: int = 0, last: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items ``first`` to ``last`` with the stretches ``low`` to ``high`` of a buffer that may hold them.

        ``at`` are ascending positions of shared q-grams, ``found`` the q-grams.  Where
        these occur in too many places of items, the positions are taken in two halves
        that overlap by more than an occurrence, or the items in two halves.
        """
        last = len(self.texts) if last is None else last
        if not len(at):
            return
        low, high = (np.searchsorted(self.posted, found * len(self.texts) + i) for i in (first, last))
        many = high - low
        total = int(many.sum())
        if total > POSTINGS and at[-1] - at[0] > 4 * self.gap:
            middle = (at[0] + at[-1]) // 2
            for half in (at < middle + self.gap, at >= middle):
                yield from self.bands(at[half], found[half], first, last)
        elif total > POSTINGS and last - first > 1:
            yield from self.bands(at, found, first, (first + last) // 2)
            yield from self.bands(at, found, (first + last) // 2, last)
        elif total:
            posting = np.repeat(low - np.cumsum(many) + many, many) + np.arange(total)
            yield from self._counted(np.repeat(at, many), posting, self._repeats(at, found))

    def _repeats(self, at: np.ndarray, found: np.ndarray) -> bool:
        """Whether a q-gram occurs twice within a band's width."""
        order = np.argsort(found, kind="stable")
        return bool(((np.diff(found[order]) == 0) & (np.diff(at[order]) <= 2 * self.width.max(initial=1))).any())

    def _counted(self, at: np.ndarray, posting: np.ndarray, repeats: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        item, place = self.item[posting], self.place[posting]
        cells = np.int64(at[-1] + 4)
        # A cell is half a band; a band is a cell that holds something, and the next one.
        key = item * cells + (at - place) // self.width[item]
        keys, counts = np.unique(key, return_counts=True)
        follows = np.append(keys[1:] == keys[:-1] + 1, False)
        least = self.least[keys // cells]
        enough = counts + np.where(follows, np.append(counts[1:], 0), 0) >= least
        if repeats and enough.any():
            cell = np.searchsorted(keys, key)
            own, previous = enough[cell], np.append(False, (enough & follows)[:-1])[cell]
            longest = np.int64(self.length.max() + 1)
            distinct = np.unique(np.concatenate([cell[own] * longest + place[own], (cell[previous] - 1) * longest + place[previous]])) // longest
            enough &= np.bincount(distinct, minlength=len(keys)) >= least
        if not enough.any():
            return
        # Neighbouring bands become one stretch.
        joined = np.append(False, (enough & follows)[:-1]) & enough
        starts = np.flatnonzero(enough & ~joined)
        ends = np.flatnonzero(enough & ~np.append(joined[1:], False))
        items = keys[starts] // cells
        width, budget = self.width[items], self.budget[items]
        yield items, keys[starts] % cells * width - budget, (keys[ends] % cells + 2) * width + self.length[items] + budget


def edits_within(index: Index, buffer: np.ndarray, items: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least edits that turn each item into some part of its stretch of the buffer, or more than its budget.

    All items advance together, a character at a time; of each row only the cells
    that the budget can reach are kept, which is a band around the stretch's
    diagonals.  The buffer holds zeros around texts, which match nothing.
    """
    out = index.budget[items] + 1
    band = high - low - index.length[items] + 2 * index.budget[items] + 1
    order = np.lexsort((index.length[items], np.ceil(np.log2(band))))
    at = 0
    while at < len(order):
        # as many of like width as fit
        widest = np.maximum.accumulate(band[order[at : at + CELLS]])
        n = max(int(np.searchsorted(widest * np.arange(1, len(widest) + 1), CELLS, side="right")), 1)
        part = order[at : at + n]
        out[part] = _aligned(index, buffer, items[part], low[part], high[part], band[part])
        at += n
    return out


def _aligned(index: Index, buffer: np.ndarray, items: np.ndarray, low: np.ndarray, high: np.ndarray, band: np.ndarray) -> np.ndarray:
    # a column for each item, so that every step runs over all of them at once
    k, n, tail = index.budget[items], index.length[items], index.from_tail[items]
    out = k + 1
    step = np.where(tail, -1, 1)
    text = np.where(tail, high - 1, low)  # the stretch's first character, or its last
    char = np.where(tail, index.begin[items] + n - 1, index.begin[items])
    cells = np.arange(int(band.max()))[:, None]
    small = np.int16 if int(out.max()) + len(cells) < 1 << 14 else np.int32
    row = np.where((cells >= k) & (cells < band), 0, k + 1).astype(small)
    slope, limit = cells.astype(small), out.astype(small)
    here, text = np.arange(len(items)), text + step * (cells - k)
    for i in range(int(n.max(initial=0))):
        new = row + (buffer.take(text, mode="clip") != index.chars[char])
        np.minimum(new[:-1], row[1:] + small(1), out=new[:-1])
        new -= slope
        np.minimum.accumulate(new, axis=0, out=new)
        new += slope
        row = np.minimum(new, limit, out=new)
        text += step
        char += step
        ended = n == i + 1
        if ended.any() or i % 4 == 3:
            best = row.min(axis=0)
            out[here[ended]] = best[ended]
            stay = ~ended & (best < limit)
            if not stay.all():
                row, text = row[:, stay], text[:, stay]
                step, char, limit, n, here = (x[stay] for x in (step, char, limit, n, here))
                if not len(here):
                    break
    return out


def find_items(index: Index, texts: list[str]) -> list[dict[int, int]]:
    """For each plain text, the items it holds and the least edits of each."""
    out: list[dict[int, int]] = [{} for _ in texts]
    for held, t in zip(out, texts, strict=True):
        words = t.split(" ") if index.short else []
        for n, known in index.short.items():
            for piece in known.keys() & {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}:
                held.update(dict.fromkeys(known[piece], 0))
    if not len(index.grams):
        return out
    # A long text goes in pieces that overlap by more than any occurrence.
    pieces = [(k, t[at : at + BUFFER_CHARS + index.gap]) for k, t in enumerate(texts) for at in range(0, max(len(t), 1), BUFFER_CHARS)]
    held, buffered = 0, []
    for n, (k, piece) in enumerate(pieces, 1):
        buffered.append((k, piece))
        held += len(piece) + index.gap
        if held >= BUFFER_CHARS or n == len(pieces):
            _search(index, buffered, out)
            held, buffered = 0, []
    return out


def _search(index: Index, members: list[tuple[int, str]], out: list[dict[int, int]]) -> None:
    """Search texts ``(place in out, text)`` that lie in one buffer, far enough apart."""
    starts, total = [], index.gap
    for _, piece in members:
        starts.append(total)
        total += len(piece) + index.gap
    buffer = np.zeros(total, dtype=np.uint64)
    for (_, piece), s in zip(members, starts, strict=True):
        buffer[s : s + len(piece)] = codes(piece)
    at, found = index.shared(gram_hashes(buffer))
    buffer = buffer.astype(np.uint32)
    firsts = np.array(starts)
    looked: set[int] = set()
    for items, low, high in index.bands(at, found):
        member = np.maximum(np.searchsorted(firsts, high, side="left") - 1, 0)
        pairs, which = np.unique(member * len(index.texts) + items, return_inverse=True)
        open_pairs = np.ones(len(pairs), dtype=bool)
        for x, pair in enumerate(pairs.tolist()):
            (k, piece), i = members[pair // len(index.texts)], pair % len(index.texts)
            if pair not in looked:
                looked.add(pair)
                if index.texts[i] in piece:
                    out[k][i] = 0
            open_pairs[x] = out[k].get(i) != 0
        rest = open_pairs[which]
        if not rest.any():
            continue
        edits = edits_within(index, buffer, items[rest], low[rest], high[rest])
        good = edits <= index.budget[items[rest]]
        for j, i, e in zip(member[rest][good].tolist(), items[rest][good].tolist(), edits[good].tolist(), strict=True):
            k = members[j][0]
            out[k][i] = min(e, out[k].get(i, e))


def benchmark_blocks(
    benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, least_chars: int = 1
) -> Iterator[list[tuple]]:
    """The benchmark's distinct items as lists of bounded size; only a block is on the driver at a time.

    A block holds at most ``block_chars`` characters, or one item that alone is longer.
    Items of fewer than ``least_chars`` characters, as `plain` reads them, are left out.
    """
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 if chars <= block_chars else 16 * -(-chars // block_chars)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.sum(F.length("text"))).collect()) if parts > 1 else [(0, chars)]
    taken: list[int] = []
    held = 0
    for number, size in [*sizes, (None, block_chars + 1)]:
        if taken and held + size > block_chars:
            yield [(r["item_id"], r["text"]) for r in (rows.where(part.isin(taken)) if parts > 1 else rows).collect() if len(plain(r["text"])) >= least_chars]
            taken, held = [], 0
        taken.append(number)
        held += size


def contained_items(text: Column, block: list[tuple], spark, id_type: str = "bigint") -> Column:
    """``array<struct<item_id, edits, item_chars>>`` of the items of a block that the text holds."""
    shipping.ship(spark)
    ids_of: dict[str, list] = {}
    for i, t in block:
        if p := plain(t):
            ids_of.setdefault(p, []).append(i)
    share = spark.sparkContext.broadcast(ids_of)
    built: dict[str, Index] = {}

    @F.pandas_udf(f"array<struct<item_id: {id_type}, edits: int, item_chars: int>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "index" not in built:
            built["index"] = Index(list(share.value.values()), list(share.value))
        index = built["index"]
        for texts in batches:
            found = find_items(index, [plain(t) for t in texts])
            yield pd.Series(
                [[{"item_id": i, "edits": e, "item_chars": len(index.texts[x])} for x, e in sorted(f.items()) for i in index.ids[x]] for f in found]
            )

    return search(text)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", **blocks
) -> DataFrame:
    """``doc_id, item_id, edits, item_chars``: a row per row of ``docs`` and benchmark item it holds.

    Null and empty texts hold nothing, items without a letter or digit are held by
    nothing.  Items shorter than a q-gram must occur exactly, as whole words, and
    items below some 27 characters without an edit (`edit_budget`).  Null ids stay on
    both sides, ids of any type; repeated rows of ``docs`` are reported each, those
    of the benchmark once; texts of any length are searched whole; other columns are
    ignored; an empty table on either side gives an empty result.
    """
    out = None
    id_type = benchmark.schema[item_id_col].dataType.simpleString()
    for block in benchmark_blocks(benchmark, id_col=item_id_col, text_col=item_text_col, **blocks):
        found = docs.select(F.col(id_col).alias("doc_id"), F.explode(contained_items(F.col(text_col), block, docs.sparkSession, id_type)).alias("x")).select("doc_id", "x.*")
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least_chars: int = Q, **blocks
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they were.

    An item of fewer than ``least_chars`` characters (letters, digits and single
    spaces) is a word or two that clean texts use as well, so it convicts no text.
    Null and empty texts and repeated rows stay; an empty benchmark leaves all.
    """
    id_type = benchmark.schema[item_id_col].dataType.simpleString()
    for block in benchmark_blocks(benchmark, id_col=item_id_col, text_col=item_text_col, least_chars=least_chars, **blocks):
        docs = docs.where(F.size(contained_items(F.col(text_col), block, docs.sparkSession, id_type)) == 0)
    return docs
