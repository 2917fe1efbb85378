"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of virtual slots (4,096 by default).  Bytes are
summed per slot, whole slots are placed on shards so that the shards' bytes are
near equal, and the placement is a small versioned table.  Rebalancing (a shard
more, or bytes that have drifted) edits that table: it moves as few bytes as it
needs and leaves every other slot where it was.

The hash is of the text, so equal texts meet in a shard.  A slot that alone is
heavier than a whole shard's share (a hot group of copies) is split into fixed
sub-slots by the record's id, which are placed one by one.  There can be no more
such slots than shards, so the map has at most ``slots + shards * SUB_SLOTS`` rows
whatever the corpus: that is the bound under which it is broadcast.

Rows that agree in id and text are interchangeable, so they are counted first and
dealt evenly over the sub-slots.  Places are numbered in chunks of some `CHUNK_ROWS`
rows, however many rows a slot, a text or an id has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from . import text as T

SLOTS = 4096
SUB_SLOTS = 16
#: Rows numbered in one piece, about.
CHUNK_ROWS = 1 << 14
#: In the map, a slot that isn't split.
WHOLE = -1


def slotted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Narrow rows ``doc_id, size, text_crc32, virtual_slot, sub, part, copies``; the text is hashed and left behind.

    Equal rows of ``docs`` become one with their number, or parts of it: one for each
    sub-slot where they are as many, or more where these would be over `CHUNK_ROWS`.
    """
    text, key = F.col(text_col), F.col(id_col)
    rows = docs.select(
        key.alias("doc_id"),
        (T.utf8_bytes(text) + 1).alias("size"),
        F.crc32(F.encode(T.whole(text), "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(T.whole(text)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    n, home = F.col("n"), F.pmod(F.xxhash64("doc_id", F.lit("sub")), F.lit(SUB_SLOTS)).cast("int")
    parts = F.greatest(F.lit(SUB_SLOTS).cast("long"), F.ceil(n / CHUNK_ROWS))
    dealt = F.transform(
        F.sequence(F.lit(0).cast("long"), parts - 1),
        lambda k: F.struct(
            (k % SUB_SLOTS).cast("int").alias("sub"), k.alias("part"), (F.floor(n / parts) + F.when(k < n % parts, 1).otherwise(0)).alias("copies")
        ),
    )
    whole = F.array(F.struct(home.alias("sub"), F.lit(0).cast("long").alias("part"), n.alias("copies")))
    return counted.select(*rows.columns, F.inline(F.when(n < SUB_SLOTS, whole).otherwise(dealt)))


def slot_units(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each (slot, sub-slot): at most ``slots * SUB_SLOTS`` rows."""
    return rows.groupBy("virtual_slot", "sub").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n_rows"))


def _pieces(units: DataFrame, n_shards: int) -> DataFrame:
    """What is placed: whole slots, and the sub-slots of those heavier than a shard's share."""
    everything = F.sum("slot_bytes").over(Window.partitionBy(F.lit(1)))
    heavy = F.broadcast(
        units.groupBy("virtual_slot")
        .agg(F.sum("bytes").alias("slot_bytes"))
        .withColumn("heavy", F.col("slot_bytes") * n_shards > everything)
        .select("virtual_slot", "heavy")
    )
    return (
        units.join(heavy, "virtual_slot")
        .withColumn("sub", F.when(F.col("heavy"), F.col("sub")).otherwise(F.lit(WHOLE)))
        .groupBy("virtual_slot", "sub")
        .agg(F.sum("bytes").alias("bytes"))
    )


def _pack(pieces: DataFrame, loads: DataFrame) -> DataFrame:
    """Place pieces, heaviest first, each on the shard that is lightest then.

    One row holds the bounded list of pieces; a fold in the JVM carries the loads.
    ``loads`` has ``shard, load``: the bytes that each shard holds already.
    """
    piece = F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "sub", "bytes")
    held = F.struct("shard", "load")
    both = pieces.select(piece.alias("piece"), F.lit(None).cast("struct<shard: int, load: bigint>").alias("held")).unionByName(
        loads.select(held.alias("held")), allowMissingColumns=True
    )
    listed = both.groupBy().agg(F.collect_list("piece").alias("pieces"), F.transform(F.array_sort(F.collect_list("held")), lambda x: x.load).alias("loads"))
    done = listed.select(
        F.expr(
            """
            aggregate(
              array_sort(pieces),
              named_struct('loads', loads, 'placed', cast(array() as array<struct<virtual_slot: int, sub: int, shard: int>>)),
              (s, p) -> transform(
                array(cast(array_position(s.loads, array_min(s.loads)) as int) - 1),
                k -> named_struct(
                  'loads', transform(s.loads, (b, i) -> b + if(i = k, p.bytes, 0L)),
                  'placed', concat(s.placed, array(named_struct('virtual_slot', p.virtual_slot, 'sub', p.sub, 'shard', k)))
                )
              )[0],
              s -> s.placed
            )
            """
        ).alias("placed")
    )
    return done.select(F.inline("placed"))


def build_map(units: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map: ``version, virtual_slot, sub, shard``."""
    empty = units.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("load"))
    placed = _pack(_pieces(units, n_shards), empty)
    return placed.select(F.lit(1).alias("version"), "virtual_slot", "sub", "shard")


def rebalance_map(slot_map: DataFrame, units: DataFrame, n_shards: int) -> DataFrame:
    """The next version of ``slot_map`` for ``n_shards`` shards, not fewer than it has.

    A shard above its share gives up its lightest pieces until it is back at the
    share; these are packed onto the lightest shards.  Nothing else moves.  Slots
    that were empty when the map was made have no row in it and are packed too.
    """
    m, u = slot_map.alias("m"), units.alias("u")
    held = (
        u.join(F.broadcast(m), (F.col("u.virtual_slot") == F.col("m.virtual_slot")) & F.col("m.sub").isin(F.lit(WHOLE), F.col("u.sub")), "left")
        .groupBy("u.virtual_slot", F.coalesce("m.sub", F.lit(WHOLE)).alias("sub"), "m.shard")
        .agg(F.sum("bytes").alias("bytes"))
        .select("virtual_slot", "sub", "shard", "bytes")
    )
    share = F.sum("bytes").over(Window.partitionBy(F.lit(1))) / F.lit(n_shards)
    lightest_first = Window.partitionBy("shard").orderBy("bytes", "virtual_slot", "sub")
    judged = held.withColumn("excess", F.sum("bytes").over(Window.partitionBy("shard")) - share).withColumn(
        "moves", F.col("shard").isNull() | (F.sum("bytes").over(lightest_first) <= F.col("excess"))
    )
    stay, go = judged.where(~F.col("moves")), judged.where("moves")
    by_shard = F.broadcast(stay.groupBy("shard").agg(F.sum("bytes").alias("load")))
    shards = slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    loads = shards.join(by_shard, "shard", "left").select("shard", F.coalesce("load", F.lit(0)).cast("long").alias("load"))
    following = (slot_map.agg(F.max("version")).first()[0] or 0) + 1
    edited = stay.select("virtual_slot", "sub", "shard").unionByName(_pack(go, loads))
    return edited.select(F.lit(following).alias("version"), "virtual_slot", "sub", "shard")


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; versions already there stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a stored map, the newest by default."""
    stored = spark.read.schema("version int, virtual_slot int, sub int, shard int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == F.lit(version))


def apply_map(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Give rows that have ``virtual_slot`` and ``sub`` their shard, by broadcast of the bounded map."""
    m, r = slot_map.select("virtual_slot", F.col("sub").alias("map_sub"), "shard"), rows
    found = r.join(F.broadcast(m), (r.virtual_slot == m.virtual_slot) & F.col("map_sub").isin(F.lit(WHOLE), r["sub"]))
    return found.select(*[r[c] for c in r.columns], "shard")


def shard_documents(
    docs: DataFrame, *, n_shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None
) -> DataFrame:
    """Every row of ``docs`` with its shard and its gapless place in that shard.

    Columns ``doc_id, size, text_crc32, law, shard, slot, grown_shard,
    virtual_slot, map_version``.  The law is ``bytes``: the shards' bytes are near
    equal.  ``slot`` numbers the rows of a shard from 0 without gaps.  The map used
    is stored at ``map_path`` (by default in the shared folder) as its version 1.

    A null text has size 1 and the checksum of the empty text; null ids and
    repeated rows are rows like any other; other columns are ignored; an empty
    table gives an empty result.  Places inside a shard come from counts per
    bounded (slot, sub-slot) unit, per chunk of a unit, and a window within the
    chunk, so no hot text, repeated row or shard has to pass through one task.
    """
    spark = docs.sparkSession
    rows = store.keep(slotted(docs, id_col=id_col, text_col=text_col, slots=slots), "slotted")
    units = store.keep(slot_units(rows), "slot-units")
    path = map_path or store.new_path(spark, "slot-map")
    write_map(build_map(units, n_shards), path)
    current = read_map(spark, path)

    unit = ["virtual_slot", "sub"]
    before = Window.partitionBy("shard").orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    first = (
        apply_map(units, current)
        .withColumn("first", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
        .select(*unit, "shard", "first", F.ceil(F.col("n_rows") / CHUNK_ROWS).alias("chunks"))
    )
    # A row per unit: bounded, whatever the corpus.
    chunked = rows.join(F.broadcast(first), unit).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", "part"), F.col("chunks")))
    in_unit = Window.partitionBy(*unit).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunked.groupBy(*unit, "chunk").agg(F.sum("copies").alias("n")).select(*unit, "chunk", F.coalesce(F.sum("n").over(in_unit), F.lit(0)).alias("start"))
    )
    in_chunk = Window.partitionBy(*unit, "chunk").orderBy("doc_id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, 0)
    placed = chunked.withColumn("ends", F.sum("copies").over(in_chunk)).join(starts, [*unit, "chunk"])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return placed.select("doc_id", "size", "text_crc32", "shard", "virtual_slot", (F.col("first") + F.col("start") + F.col("ends") - F.col("copies")).alias("at"), copies).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") + F.col("copy") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(1).alias("map_version"),
    )
