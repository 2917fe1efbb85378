"""Mixing sources to target weights by Sainte-Laguë apportionment of blocks.

Words are counted per (source, shard), where a shard is a hash class of the
source's documents.  The mix is cut into blocks of equally many words.  Sources get whole
numbers of blocks by highest quotients (weight over 1, 3, 5, ...), a source's
blocks are handed to its shards in the same way by the words they hold, and within
a shard a seeded choice of blocks is taken: documents are put in a seeded order,
their words form a ring, and the blocks are taken from a seeded place on, going
round again if the quota asks for more than the shard holds.  Blocks are small
against every shard, and a shard that gives all it may ends in a partial block.

The two apportionments work on counts per source and per shard; documents are only
hashed, numbered inside their (source, shard) and given their part.  A source that
holds a third of all rows has a third of the shards, and rows that agree in all that
matters are counted first and dealt to shards in parts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import shipping
from . import store
from . import text as T

#: Documents that a source's shard holds on average, and the most shards a source has.
DOCS_PER_CELL, MOST_SHARDS = 64, 1 << 18
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
#: A recipe has a row per source, which the driver holds; beyond so many, `source_col` is no source.
MOST_SOURCES = 1_000_000
#: Share of its target by which a source's blocks may miss it, and words.
MISSED_SHARE, MISSED_WORDS = 0.01, 1


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of the total of ``sizes`` by weight, none above ``most`` times its size.

    What a capped source gives up is shared among the others by weight, until none
    is above its cap.
    """
    total, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] > most * sizes[i] * weight]
        if not over or weight == 0:
            for i in free:
                out[i] = total * weights[i] / weight if weight else 0.0
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free -= set(over)
        total -= sum(out[i] for i in over)
    return out


def sainte_lague(weights: Iterable[float], seats: int, most: Iterable[int] | None = None) -> list[int]:
    """Whole numbers that add up to ``seats`` (to the sum of ``most`` if that is less), by highest quotients.

    A claimant with ``n`` seats bids ``weight / (2 n + 1)``; ties go to the earlier
    one.  Seats above a common low price are given at once, the last few one by one.
    """
    w = np.array(list(weights), dtype=float)
    cap = np.array(list(most), dtype=np.int64) if most is not None else np.full(len(w), np.iinfo(np.int64).max // 4)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum(dtype=object))) if len(w) else 0

    def at_price(price: float) -> np.ndarray:
        """Seats whose quotient is above the price."""
        return np.minimum(np.maximum(np.ceil(w / price / 2 - 0.5), 0), cap).astype(np.int64)

    given = np.zeros(len(w), dtype=np.int64)
    if seats > 0:
        low, high = float(w[w > 0].min()) / (2.0 * seats + 3) / 4, float(w.max()) * 2
        for _ in range(200):
            middle = (low * high) ** 0.5
            if at_price(middle).sum() > seats:
                low = middle
            else:
                high = middle
        given = at_price(high)
    bids = [(-w[i] / (2 * int(given[i]) + 1), i) for i in range(len(w)) if given[i] < cap[i]]
    heapq.heapify(bids)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(bids)
        given[i] += 1
        if given[i] < cap[i]:
            heapq.heappush(bids, (-w[i] / (2 * int(given[i]) + 1), i))
    return [int(x) for x in given]


def block_words(sizes: Sequence[int], targets: Sequence[float], smallest_shard: int) -> int:
    """Words of a block: few against the whole, the smallest target and the smallest shard that has words."""
    return max(1, int(min([sum(sizes) / (1 << 20), smallest_shard / 16, *(t / 256 for t in targets if t > 0)])))


def hand_out(held: Sequence[int], words: int, block: int, most: int = MOST_REPEATS) -> list[int]:
    """Words that each shard of a source gives: ``words`` in all, of none more than ``most`` times what it holds.

    Whole blocks go by what shards hold; a shard's last may be partial.  What then
    is left of ``words`` goes where there is room, in order.
    """
    limits = np.array([most * h for h in held], dtype=np.int64)
    given = np.minimum(np.array(sainte_lague(held, words // block, -(-limits // block)), dtype=np.int64) * block, limits)
    room = limits - given
    return [int(x) for x in given + np.clip(words - given.sum() - (room.cumsum() - room), 0, room)]


def source_quotas(sizes: Sequence[int], targets: Sequence[float], block: int, most: int = MOST_REPEATS) -> list[int]:
    """Words that each source gives: whole blocks by highest quotients, at most ``most`` times what it has.

    An error says so if that misses a source's target.
    """
    seats = sainte_lague(targets, round(sum(targets) / block), [-(-most * s // block) for s in sizes])
    quotas = [min(n * block, most * s) for n, s in zip(seats, sizes, strict=True)]
    for number, (quota, target) in enumerate(zip(quotas, targets, strict=True)):
        if abs(quota - target) > max(MISSED_SHARE * target, MISSED_WORDS):
            raise ArithmeticError(f"source number {number} would give {quota} words in place of {target:.0f}, in blocks of {block}")
    return quotas


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
    most: int = MOST_REPEATS, shards: int | None = None, seed: int = 11,
) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, place_key`` for every row of ``docs``.

    ``size`` is the words of the text (null: 0), ``target`` the words its source
    should give, ``taken`` the words the mix takes of this row, repeats counted, at
    most ``most * size``.  Sources come in code point order, the null source last,
    and weigh ``weights`` in turn; the empty string is a source of its own.  Repeated
    rows are rows like any other, null ids too, other columns are ignored; an empty
    table, or one without words, takes nothing.  The same rows and seed give the
    same mix.

    The number of sources is that of a mixture's recipe: a row per source reaches
    the driver (more than `MOST_SOURCES` are an error), a row per source and shard
    one task per source.
    """
    spark = docs.sparkSession
    shipping.ship(spark)
    text = T.whole(F.col(text_col))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), T.word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    counted = named.groupBy(*named.columns).agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / DOCS_PER_CELL)
    dealt = F.transform(
        F.sequence(F.lit(0).cast("long"), parts - 1),
        lambda k: F.struct(k.alias("part"), (F.floor(F.col("n") / parts) + F.when(k < F.col("n") % parts, 1).otherwise(0)).alias("copies")),
    )
    rows = store.keep(counted.select(*named.columns, F.inline(dealt)), "sizes")
    # A source has as many shards as give each some `DOCS_PER_CELL` documents, so a hot source has many.
    rows_of = rows.groupBy("source").agg(F.sum("copies").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows_of) > MOST_SOURCES:
        raise ValueError(f"{source_col} has more than {MOST_SOURCES} values; a mixture's sources are fewer")
    spread = spark.createDataFrame(
        [(r["source"], shards or min(max(r["n"] // DOCS_PER_CELL, 1), MOST_SHARDS)) for r in rows_of], "s_source string, n_shards int"
    )
    sharded = rows.join(spread, F.col("source").eqNullSafe(F.col("s_source")))
    keyed = sharded.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "part", F.lit(seed)), F.col("n_shards")).cast("int")).drop("s_source", "n_shards")
    cells = store.keep(keyed.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words")), "cells")

    totals = cells.groupBy("source").agg(F.sum("words").alias("words")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["words"] for r in totals]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    smallest = cells.where("words > 0").agg(F.min("words")).first()[0] or 1
    block = block_words(sizes, targets, smallest)
    quotas = source_quotas(sizes, targets, block, most)
    recipe = spark.createDataFrame(
        [(r["source"], s, t, q) for r, s, t, q in zip(totals, sizes, targets, quotas, strict=True)], "source string, source_size long, target double, quota long"
    )

    def by_shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        held = part["words"].tolist()
        return part[["source", "shard", "words"]].assign(given=hand_out(held, int(part["quota"].iloc[0]), block, most))

    # The recipe has a row per source, of which the driver holds the list already.
    due = cells.join(recipe.select(F.col("source").alias("r_source"), "quota"), F.col("source").eqNullSafe(F.col("r_source")))
    quota = (
        due.groupBy("source")
        .applyInPandas(by_shard, "source string, shard int, words long, given long")
        .select(
            F.col("source").alias("q_source"),
            F.col("shard").alias("q_shard"),
            "words",
            F.col("given").alias("words_taken"),
        )
    )
    # The first block taken is a seeded one of the shard's whole blocks.
    blocks = F.greatest(F.floor(F.col("words") / block), F.lit(1))
    quota = store.keep(quota, "quotas").withColumn("from_word", F.pmod(F.xxhash64("q_source", "q_shard", F.lit(seed)), blocks) * block)

    seeded = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "text_hash", "size", "part")
    ring = keyed.withColumn("ends", F.sum(F.col("size") * F.col("copies")).over(seeded.rowsBetween(Window.unboundedPreceding, 0)))
    # from here on a row for each copy again
    ring = ring.withColumn("later", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("ends", F.col("ends") - F.col("later") * F.col("size"))
    placed = ring.join(quota, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    turns = F.expr("words_taken div words")
    rest = F.col("words_taken") - turns * F.col("words")

    def overlap(low: F.Column, high: F.Column) -> F.Column:
        return F.greatest(F.least(F.col("ends"), high) - F.greatest(F.col("ends") - F.col("size"), low), F.lit(0))

    # From `from_word` on, `rest` words of the ring: a stretch, and what goes past the ring's end.
    start, stop = F.col("from_word"), F.col("from_word") + rest
    taken = F.when(F.col("size") > 0, F.col("size") * turns + overlap(start, F.least(stop, F.col("words"))) + overlap(F.lit(0).cast("long"), stop - F.col("words"))).otherwise(F.lit(0))
    r = recipe.select(F.col("source").alias("r_source"), "source_size", "target")
    return placed.join(r, F.col("source").eqNullSafe(F.col("r_source"))).select(
        "doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), F.col("text_hash").alias("place_key")
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, **options) -> DataFrame:
    """The mix as whole documents, with the columns of ``docs``: each row as many times as the mix takes it, rounded by chance.

    A row of which a fraction is taken stays with that probability (seeded), however
    long it is, so sources meet their targets on average.  Rows without an id are
    matched by their text; rows that share id and text are rounded alike.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    chance = F.pmod(F.xxhash64("doc_id", "place_key", F.lit(seed + 2)), F.lit(1 << 30)) / (1 << 30)
    times = taken.groupBy("doc_id", "place_key").agg((F.sum("taken") / F.count("*")).alias("each"), F.max("size").alias("size")).select(
        F.col("doc_id").alias("__t_id"), F.col("place_key").alias("__t_key"), F.when(F.col("size") > 0, F.floor(F.col("each") / F.col("size") + chance)).otherwise(F.lit(0)).cast("int").alias("__t_times")
    ).where("__t_times > 0")
    times = store.keep(times, "times")
    hit = docs.join(times, docs[id_col].eqNullSafe(times["__t_id"]) & (F.xxhash64(T.whole(docs[text_col])) == times["__t_key"]))
    # `docs` may have columns of any name, so its own are kept by their place.
    kept = hit.select(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(docs.columns)], F.explode(F.sequence(F.lit(1), times["__t_times"])).alias("copy"))
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
