"""SimHash near-duplicates, candidates pruned by the pigeonring principle.

A 64-bit fingerprint is cut into five consecutive segments on a ring.  If two
fingerprints differ in at most four bits, there is a start on the ring from which
every chain of ``l`` segments differs in at most ``l * 4 / 5`` bits: the first
segment is equal, the first two differ in one bit at most, three in two, four in
three.  The first two links are the key of the candidate search: a fingerprint is
filed under its first two segments, and looked up under these and under each form
with one more bit set in the second.  (Of two fingerprints that differ in that
bit, exactly one has it unset, so each pair meets from one side.)  The chain's
further links prune what meets, before the full Hamming check.

Two links are 26 bits.  Beyond `MOST_FOR_TWO_LINKS` fingerprints chance meetings
under so short a key would outnumber the rows, and the key takes the third link
too (39 bits): each side is filed under its own form and each form with one bit of
the second or third segment turned, which meet for any two differences.  The same
finer key is used inside a task for a two-link key that many fingerprints share.

Copies never meet: the search runs over distinct fingerprints.  What shares a key
is handled as one stream sorted by key, and yields a spanning forest of the
verified links, never all pairs.  A pair that meets under several keys is reported
under the smallest: its two members are connected there, so no link is lost.

Texts that share 0.8 of their five-word shingles mostly differ in 5 to 13 bits of
their shingles' fingerprint, too many for a selective key, but in few bits of a
fingerprint of their word sets.  `keep_one_per_group` therefore also links texts by
`WORD_VIEWS` word-set fingerprints, searched in the same way, whose five-word
shingles have `SIMILAR_BITS`-bit fingerprints that differ in at most
`SIMILAR_WITHIN` bits, what similarity 0.8 gives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shipping
from . import components, store
from . import text as T

SEGMENTS = 5
LINKED = 4
#: Bit offset and width of each segment.
OFFSETS, WIDTHS = (0, 13, 26, 39, 52), (13, 13, 13, 13, 12)
_MASKS = np.array([((1 << w) - 1) << o for o, w in zip(OFFSETS, WIDTHS, strict=True)], dtype=np.uint64)

#: Distinct fingerprints up to which the key has two links; members of a key from which it is refined.
MOST_FOR_TWO_LINKS, REFINED_FROM = 1 << 27, 2048

#: Fingerprints of the word set; bits of the five-word shingles' fingerprint, and how many may differ.  Two texts
#: of Jaccard similarity J have shingle sets at the angle acos(2 J / (1 + J)): 19.3 of 128 bits at 0.8, deviation 4.
WORD_VIEWS, SIMILAR_SHINGLE, SIMILAR_BITS, SIMILAR_WITHIN = 4, 5, 128, 23
_VIEWS = [f"w{k}" for k in range(WORD_VIEWS)] + ["g0", "g1"]

#: Shingles hashed at once, so that a very long text needs bounded memory.
_CHUNK = 1 << 16


def fingerprint(text: str | None, *, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: ASCII lower case, words, shingles with repeats, XXH64.

    A bit is 1 if it is set in over half the hashes.  Fewer words than a shingle
    are one shingle; no word gives 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    joined = b" ".join(words)
    starts = [0, *ends]
    width = min(shingle, len(words))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array(
            [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts[at : min(at + _CHUNK, n)], ends[at + width - 1 :], strict=False)], dtype="<u8"
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _majority(features: Iterable[bytes], n: int, seed: int = 0) -> list[int]:
    """Two 64-bit halves: the bits that over half of ``n`` features' 128-bit hashes have."""
    from xxhash import xxh3_128_digest

    ones, hashed = np.zeros(128, dtype=np.int64), (xxh3_128_digest(f, seed) for f in features)
    while chunk := b"".join(islice(hashed, _CHUNK)):
        ones += np.unpackbits(np.frombuffer(chunk, dtype=np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > n).view(">i8").tolist()


def similar_views(text: str | None) -> list[int]:
    """`_VIEWS` of a text, lower-cased as its fingerprint is: those of its word set, and two halves of its five-word shingles'.

    No word gives zeros; fewer words than a shingle are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * len(_VIEWS)
    known = set(words)
    n = max(len(words) - SIMILAR_SHINGLE + 1, 1)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    shingles = (joined[a : b - 1] for a, b in zip([0, *ends], ends[min(SIMILAR_SHINGLE, len(words)) - 1 :], strict=False))
    return [*(w for seed in range(WORD_VIEWS // 2) for w in _majority(known, len(known), seed)), *_majority(shingles, n)]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, similar: bool = False) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long): one row per input row.

    With ``similar`` also ``key``, a hash of the text, and the views of `similar_views`.
    """

    shipping.ship(docs.sparkSession)
    names = ["fp", *_VIEWS] if similar else ["fp"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            fps = np.array([fingerprint(t, shingle=shingle) for t in texts], dtype=np.uint64).view(np.int64)
            views = np.array([similar_views(t) if similar else [] for t in texts], dtype=np.int64).reshape(len(texts), len(names) - 1)
            yield pd.DataFrame(np.column_stack([fps, views]), columns=names)

    found = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(T.whole(F.col(text_col))).alias("key"), hashed(F.col(text_col)).alias("h"))
    return found.select("doc_id", "key", "h.*") if similar else found.select("doc_id", "h.fp")


def _segment(fps: np.ndarray, k: int) -> np.ndarray:
    return (fps & _MASKS[k % SEGMENTS]) >> np.uint64(OFFSETS[k % SEGMENTS])


def keys_from(fps: np.ndarray, start: int, links: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first ``links`` (2 or 3) links of the chain from ``start``, and the place of each one's fingerprint."""
    after, place = (start + 1) % SEGMENTS, np.arange(len(fps))
    second = _segment(fps, after)
    head = (np.uint64(start) << np.uint64(26)) | (_segment(fps, start) << np.uint64(13))
    keys, owners = [head | second], [place]
    if links == 2:
        for bit in range(WIDTHS[after]):
            flip = np.uint64(1 << bit)
            unset = (second & flip) == 0
            keys.append(head[unset] | second[unset] | flip)
            owners.append(place[unset])
    else:
        own = (keys[0] << np.uint64(13)) | _segment(fps, start + 2)
        turned = [np.uint64(1 << bit) for bit in range(WIDTHS[(start + 2) % SEGMENTS])] + [np.uint64(1 << (13 + bit)) for bit in range(WIDTHS[after])]
        keys = [own, *[own ^ t for t in turned]]
        owners = [place] * len(keys)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def chain_keys(links: int):
    """A function from batches of fingerprints ``fp``, with any other columns, to rows of each under all its keys."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy().view(np.uint64)
            for start in range(SEGMENTS):
                keys, owners = keys_from(fps, start, links)
                yield pd.DataFrame({"key": keys, **{c: batch[c].to_numpy()[owners] for c in batch.columns}})

    return keyed


def linked(one: np.ndarray, other: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs are linked, going down the chain from ``start``: each link prunes before the full check."""
    alive = np.arange(len(one))
    differing = one ^ other
    within = np.zeros(len(one), dtype=np.int64)
    for length in range(1, SEGMENTS + 1):
        segment = _MASKS[(start[alive] + length - 1) % SEGMENTS]
        within = within + np.bitwise_count(differing[alive] & segment)
        fits = within <= length * LINKED // SEGMENTS
        alive, within = alive[fits], within[fits]
    out = np.zeros(len(one), dtype=bool)
    out[alive] = np.bitwise_count(differing[alive]) <= LINKED
    return out


@dataclass(frozen=True)
class _Members:
    """Fingerprints under sorted keys, the names that links tie, and the halves that must be similar too, if any."""

    fps: np.ndarray
    names: np.ndarray
    similar: np.ndarray | None = None

    @classmethod
    def of(cls, rows: pd.DataFrame) -> _Members:
        fps = rows["fp"].to_numpy().view(np.uint64)
        if "name" not in rows.columns:
            return cls(fps, fps.view(np.int64))
        return cls(fps, rows["name"].to_numpy(), rows[["g0", "g1"]].to_numpy().view(np.uint64))

    def at(self, places: np.ndarray) -> _Members:
        return _Members(self.fps[places], self.names[places], None if self.similar is None else self.similar[places])

    def linked(self, one: np.ndarray, other: np.ndarray, start: np.ndarray) -> np.ndarray:
        ok = linked(self.fps[one], self.fps[other], start)
        if self.similar is not None and ok.any():
            ok[ok] = np.bitwise_count(self.similar[one[ok]] ^ self.similar[other[ok]]).sum(axis=1) <= SIMILAR_WITHIN
        return ok

    def pairs(self, one: np.ndarray, other: np.ndarray, keys: np.ndarray, links: int) -> np.ndarray:
        """The names of those linked pairs that have no smaller key in common."""
        first = smallest_in_common(self.fps[one], self.fps[other], keys, links)
        return np.column_stack([self.names[one[first]], self.names[other[first]]])


def smallest_in_common(one: np.ndarray, other: np.ndarray, keys: np.ndarray, links: int) -> np.ndarray:
    """Which linked pairs, found under ``keys``, meet and are linked under no smaller key of the same kind."""
    width = np.int64(13 * (links - 1))
    starts = keys >> (width + 13)
    out = np.ones(len(one), dtype=bool)
    for start in range(SEGMENTS - 1):
        later = np.flatnonzero(out & (starts > start))
        out[later] = ~linked(one[later], other[later], np.full(len(later), start))
    a, b = (_segment_at(x, starts + 1) for x in (one, other))
    if links == 2:
        least = a | b
    else:
        a, b = ((x << 13) | _segment_at(y, starts + 2) for x, y in ((a, one), (b, other)))
        differing = a ^ b
        low = differing & -differing
        highest = np.left_shift(1, np.maximum(np.frexp(a.astype(float))[1] - 1, 0))
        least = np.where(differing == 0, np.minimum(a, a ^ highest), np.where(differing == low, np.minimum(a, b), np.minimum(a ^ low, a ^ differing ^ low)))
    return out & (least == keys & ((np.int64(1) << width) - 1))


def _segment_at(fps: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Segment number ``k`` (on the ring) of each fingerprint, as a signed number."""
    k = k % SEGMENTS
    return ((fps & _MASKS[k]) >> np.array(OFFSETS, dtype=np.uint64)[k]).astype(np.int64)


def _forest(members: _Members, key: int, links: int) -> np.ndarray:
    """Pairs that connect what verified links connect among the members of one key."""
    start = key >> (26 if links == 2 else 39)
    rest, out = np.arange(len(members.fps)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = np.full(len(rest), queue.pop())
            found = members.linked(node, rest, np.full(len(rest), start))
            out.append(members.pairs(node[found], rest[found], np.full(int(found.sum()), key), links))
            queue += list(rest[found])
            rest = rest[~found]
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def _links(keys: np.ndarray, members: _Members, links: int) -> list[np.ndarray]:
    """Pairs (as arrays of two columns) that connect the members of each key; ``keys`` are sorted.

    Keys of two to sixteen members are compared at once, larger ones searched from
    member to member, which gives at most one edge a member; a large two-link key
    is first refined by the third link.
    """
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], dtype=np.int64)
    sizes = np.diff(np.r_[first, len(keys)])
    starts = keys >> (26 if links == 2 else 39)
    out = []
    for size in range(2, 17):
        at = first[sizes == size]
        if len(at):
            for i in range(size):
                for j in range(i + 1, size):
                    ok = members.linked(at + i, at + j, starts[at])
                    if ok.any():
                        out.append(members.pairs(at[ok] + i, at[ok] + j, keys[at[ok]], links))
    for at, size in zip(first[sizes > 16], sizes[sizes > 16], strict=True):
        those, key = members.at(np.arange(at, at + size)), int(keys[at])
        if links == 2 and size >= REFINED_FROM:
            finer, owners = keys_from(those.fps, key >> 26, 3)
            order = np.argsort(finer, kind="stable")
            out += _links(finer[order], those.at(owners[order]), 3)
        else:
            out.append(_forest(those, key, links))
    return out


def links_by_key(links: int):
    """A function from batches of rows sorted by key to the links found inside the keys."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        out = _links(rows["key"].to_numpy(), _Members.of(rows), links)
        pairs = np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = rows["key"].to_numpy()
            last = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            yield settle(rows[:last])
            held = rows[last:]
        if held is not None:
            yield settle(held)

    return search


def fingerprint_links(distinct: DataFrame, links: int | None = None) -> DataFrame:
    """Links ``a, b`` that connect what Hamming distance 4 connects among distinct ``fp``.

    With columns ``name, g0, g1`` the links are between names, and only of rows
    whose halves ``g0, g1`` are similar as well; one ``fp`` may then have several rows.
    ``links`` (2 or 3) is the length of the key; by default it follows from the
    number of fingerprints.  Either finds every pair.
    """
    shipping.ship(distinct.sparkSession)
    if links is None:
        links = 2 if distinct.count() <= MOST_FOR_TWO_LINKS else 3
    searched = distinct.select([c for c in ("fp", "name", "g0", "g1") if c in distinct.columns])
    schema = "".join(f", {c} long" for c in searched.columns)
    keyed = searched.mapInPandas(chain_keys(links), "key long" + schema)
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(links_by_key(links), "a long, b long")


def similar_links(rows: DataFrame) -> DataFrame:
    """Links ``a, b`` between ``name`` of ``rows(fp, name, g0, g1)`` that connect what is within distance 4 and similar.

    Most fingerprints have no other near them.  The few that have are found first,
    without names and halves, and only they are searched again with these.
    """
    of_fp = rows.groupBy("fp").agg(F.count("*").alias("n"))
    near = fingerprint_links(of_fp.select("fp"))
    some = of_fp.where("n > 1").select("fp").union(near.select(F.explode(F.array("a", "b")))).distinct()
    some = store.keep(rows.join(some, "fp", "left_semi"), "near-others")
    return fingerprint_links(some)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hexadecimal digits.  Rows whose fingerprints
    differ in at most four bits are linked; ``component_id`` is the smallest id
    that links reach, the row's own included.  Null, empty and blank texts have
    fingerprint zero and are linked like any other.  Null ids count as no id: their
    rows stay, and take the smallest id of their component if it has one.
    Repeated rows stay.  Other columns are ignored; an empty table gives an empty
    result.
    """
    docs_fp = store.keep(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    by_fp = least_of_component(docs_fp, F.col("doc_id")).withColumnRenamed("least", "component_id")
    return docs_fp.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_of_component(docs_fp: DataFrame, value: Column) -> DataFrame:
    """``fp, least``: for each fingerprint the least ``value`` of the rows in its component.

    Where ``docs_fp`` has the views of `similar_views`, similar texts are linked too;
    those of one fingerprint are represented by their least view.
    """
    similar = "w0" in docs_fp.columns
    view = [F.min(F.struct(*_VIEWS)).alias("view")] if similar else []
    distinct = store.keep(docs_fp.groupBy("fp").agg(F.min(value).alias("least"), *view), "distinct-fingerprints")
    links = fingerprint_links(distinct.select("fp"))
    for k in range(WORD_VIEWS if similar else 0):
        links = links.unionByName(similar_links(distinct.select(F.col(f"view.w{k}").alias("fp"), F.col("fp").alias("name"), "view.g0", "view.g1")))
    links = store.keep(links, "links")
    roots = components.connected_components(links)
    tied = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = tied.groupBy("root").agg(F.min("least").alias("least"))
    return tied.drop("least").join(of_root, "root").select("fp", "least")


def keep_one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, similar: bool = True) -> DataFrame:
    """One row of ``docs`` per component, with its columns as they were: that of the smallest id, rows without one last.

    Components are those of `near_duplicates`, joined further with ``similar`` by the
    links of texts that share some 0.8 of their five-word shingles (see above).
    Null, empty and blank texts are one component; texts of any length count whole.
    The texts that go are named by id (null is an id here) and hash of the text, and
    found from fingerprints; the texts are joined against them once.  Of rows that
    share id and text one stays, found in a second join of these alone.
    """
    docs_fp = store.keep(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, similar=True), "fingerprints")
    docs_fp = docs_fp if similar else docs_fp.select("doc_id", "key", "fp")
    by_fp = least_of_component(docs_fp, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "key"))
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("fp") == F.col("least.fp")) & (F.col("key") == F.col("least.key"))
    told = docs_fp.join(by_fp, "fp").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), first.alias("__first"))
    texts = told.groupBy("__id", "__key").agg(F.max("__first").alias("__first"), F.count("*").alias("__n"))
    marked = store.keep(texts.where("NOT __first OR __n > 1"), "duplicates")

    def same(names: DataFrame) -> Column:
        return docs[id_col].eqNullSafe(names["__id"]) & (F.xxhash64(T.whole(docs[text_col])) == names["__key"])

    # The list grows with the corpus, so it is never broadcast, not even where it happens to be small.
    once = docs.join(marked.hint("merge"), same(marked), "left_anti")
    repeated = marked.where("__first")
    if repeated.isEmpty():
        return once
    # `docs` may have columns of any name, so its own are kept by their place.
    names = [f"c{k}" for k in range(len(docs.columns))]
    hit = docs.join(repeated, same(repeated)).select(repeated["__id"].alias("id"), repeated["__key"].alias("key"), F.struct(*[docs[f"`{c}`"].alias(n) for n, c in zip(names, docs.columns, strict=True)]).alias("row"))
    one = hit.groupBy("id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.union(one.select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)]))
