import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from regionloom.llm import mixing, sharding, store


def word_count(text):
    return len((text or "").encode().split())


def brute_targets(sizes):
    total, weights = sum(sizes), [(1, 2, 3)[i % 3] for i in range(len(sizes))]
    capped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(3 * sizes[i] for i in capped)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free} if free else {}
        over = {i for i in free if share[i] > 3 * sizes[i]}
        if not over:
            return [3 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def brute_sainte_lague(weights, seats, most):
    given = [0] * len(weights)
    for _ in range(min(seats, sum(m for m, w in zip(most, weights) if w > 0))):
        i = max((i for i in range(len(weights)) if given[i] < most[i] and weights[i] > 0), key=lambda i: (weights[i] / (2 * given[i] + 1), -i))
        given[i] += 1
    return given


@pytest.mark.parametrize("seed", range(20))
def test_sainte_lague(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 9)
    weights = [rng.choice([0, 1, 2, 3, rng.random() * 50]) for _ in range(n)]
    most = [rng.choice([0, 3, 1000]) for _ in range(n)]
    seats = rng.randrange(200)
    got = mixing.sainte_lague(weights, seats, most)
    want = brute_sainte_lague(weights, seats, most)
    assert sum(got) == sum(want)
    assert got == want
    assert mixing.sainte_lague([], 5) == [] and mixing.sainte_lague([0, 0], 5) == [0, 0]


def check_mix(rows, got):
    """``rows`` of (doc_id, text, source) against the contract."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(word_count(t) for _, t, x in rows if x == s) for s in sources]
    targets = dict(zip(sources, brute_targets(sizes)))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, word_count(t)) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[sources.index(r["source"])]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sources:
        assert taken[s] == pytest.approx(targets[s], rel=0.01, abs=2), s
    return taken


def test_mix_of_real_documents(spark, real):
    docs = spark.createDataFrame(real, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    check_mix(real, got)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    check_mix(real, mixing.mix(docs, shards=16).collect())
    # blocks are taken whole: few documents are cut
    cut = sum(r["taken"] % r["size"] != 0 for r in mixing.mix(docs, shards=1).collect() if r["size"])
    assert cut <= 2 * 20 * 2


@pytest.mark.parametrize("seed", range(20))
def test_shards_give_what_their_source_should(seed):
    rng = random.Random(seed)
    held = [rng.choice([0, 1, 7, 100, rng.randrange(5000)]) for _ in range(rng.randrange(1, 300))]
    words = int(3 * sum(held) * rng.choice([0, 0.1, 0.7, 0.99, 1]))
    given = mixing.hand_out(held, words, rng.choice([1, 40, 4482]))
    assert sum(given) == words and all(0 <= g <= 3 * h for g, h in zip(given, held, strict=True))


def test_blocks_are_small_against_shards():
    assert mixing.block_words([10**9, 10**7], [10**9, 3 * 10**7], 1000) == 62
    assert mixing.block_words([10**9, 10**7], [10**9, 3 * 10**7], 2) == 1


def test_shards_smaller_than_a_share_of_the_whole(spark):
    # 2^20 blocks of the whole would have 19 words, a shard of the short documents some 5.
    long = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 20_000).alias("text"), F.lit("a").alias("source"))
    short = spark.range(5000).select((F.col("id") + 1000).alias("doc_id"), F.lit("two words").alias("text"), F.lit("b").alias("source"))
    got = {r["source"]: r for r in mixing.mix(long.union(short), shards=2000).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()}
    assert got["b"]["target"] == 30_000
    assert all(r["taken"] == pytest.approx(r["target"], rel=0.001) and r["most"] <= 3 for r in got.values())


def test_a_missed_target_is_an_error():
    assert mixing.source_quotas([1000, 1000], [500.0, 1500.0], 7) == [71 * 7, 215 * 7]  # 286 blocks of 7 words
    with pytest.raises(ArithmeticError, match="source number 1"):
        mixing.source_quotas([10**6, 2000], [10**6, 3000.0], 4000)


@pytest.mark.parametrize("sources", [[(8_000_000, 300), (1_000_000, 10)], [(7_000_000, 300), (1_000_000, 10)], [(16_000_000, 300)] * 20, [(1_000_000, 300)] * 300, [(10**9, 400), (10**9, 2), (3, 1)]])
def test_no_source_loses_its_quota_at_scale(sources):
    # words of the first shards of each source, as so many documents of so many words would fill them
    rng = np.random.default_rng(4)
    sizes = [n * w for n, w in sources]
    targets = mixing.capped_targets(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))])
    shards = [min(max(n // mixing.DOCS_PER_CELL, 1), mixing.MOST_SHARDS) for n, _ in sources]
    cells = [np.maximum(rng.poisson(n / k, k) * w, 0) if k > 1 else np.array([n * w]) for (n, w), k in zip(sources, shards, strict=True)]
    block = mixing.block_words(sizes, targets, min(int(c[c > 0].min()) for c in cells))
    for size, target, quota, held in zip(sizes, targets, mixing.source_quotas(sizes, targets, block), cells, strict=True):
        assert quota == pytest.approx(target, rel=0.01, abs=1)
        words = min(quota * int(held.sum()) // size, 3 * int(held.sum()))
        given = mixing.hand_out(held.tolist(), words, block)
        assert sum(given) == words and (np.array(given) <= 3 * held).all()


def test_equal_rows_are_mixed_alike(spark):
    rows = [(None, "ein zwei drei", "a")] * 1000 + [(i, f"text of {i} words", "a" if i % 5 else "b") for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    check_mix(rows, got)
    assert max(Counter(r["taken"] for r in got if r["doc_id"] is None).values()) < 1000


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        mixing.mix(spark.createDataFrame([(i, "x", str(i)) for i in range(4)], "doc_id long, text string, source string"))


def test_mix_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    check_mix(rows, mixing.mix(odd).collect())
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.where("text is null")).count() == 2
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert all(n <= 3 * sum(i == k for k, _, _ in rows) for i, n in copies.items())


def check_shards(rows, got, n_shards=16):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    loads, places = [0] * n_shards, defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return loads


def test_shards(spark, real):
    docs = spark.createDataFrame(real, "doc_id long, text string, source string")
    got = sharding.shard_documents(docs).collect()
    loads = check_shards([(i, t) for i, t, _ in real], got)
    largest = max(len(t.encode()) for _, t, _ in real)
    assert max(loads) - min(loads) <= largest + 1
    of_text = defaultdict(set)
    for (i, t, _), s in ((r, {x["doc_id"]: x["shard"] for x in got}[r[0]]) for r in real):
        of_text[t].add(s)
    assert all(len(s) == 1 for s in of_text.values())  # equal texts meet


def test_shards_of_odd_rows(spark, odd, none):
    check_shards([(r["doc_id"], r["text"]) for r in odd.collect()], sharding.shard_documents(odd).collect())
    assert sharding.shard_documents(none).count() == 0


def test_a_hot_text_is_split(spark):
    rows = [(i, "the same text again" if i % 3 == 0 else f"text number {i}") for i in range(3000)]
    loads = check_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert max(loads) <= 1.05 * sum(loads) / 16


def test_equal_rows_are_spread(spark, monkeypatch):
    rows = [(None, "the same text again") if i % 3 == 0 else (7, "one id") if i % 3 == 1 else (i, f"text number {i}") for i in range(3000)]
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 7)
    loads = check_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert max(loads) <= 1.05 * sum(loads) / 16


def test_places_do_not_depend_on_how_rows_lie(spark, real):
    docs = spark.createDataFrame(real, "doc_id long, text string, source string")
    docs = docs.union(docs.limit(20)).drop("source")
    a, b = (sharding.shard_documents(d).collect() for d in (docs, docs.repartition(5)))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_map_versions(spark, real):
    docs = spark.createDataFrame(real, "doc_id long, text string, source string")
    rows = sharding.slotted(docs)
    units = store.keep(sharding.slot_units(rows), "units")
    path = store.new_path(spark, "map-test")
    sharding.write_map(sharding.build_map(units, 8), path)
    first = sharding.read_map(spark, path)
    sharding.write_map(sharding.rebalance_map(first, units, 9), path)
    second = sharding.read_map(spark, path)
    assert sharding.read_map(spark, path, 1).count() == first.count() and {r["version"] for r in second.collect()} == {2}
    a = {(r["virtual_slot"], r["sub"]): r["shard"] for r in sharding.read_map(spark, path, 1).collect()}
    b = {(r["virtual_slot"], r["sub"]): r["shard"] for r in second.collect()}
    assert a.keys() == b.keys()
    assert all(b[k] in (a[k], 8) for k in a)  # the new shard only takes
    loads = Counter()
    for r in sharding.apply_map(units, second).collect():
        loads[r["shard"]] += r["bytes"]
    assert max(loads.values()) <= 1.35 * sum(loads.values()) / 9
    same = {(r["virtual_slot"], r["sub"]): r["shard"] for r in sharding.rebalance_map(second, units, 9).collect()}
    assert sum(same[k] != b[k] for k in b) <= len(b) // 5


def test_packing_is_longest_first(spark):
    rows = [(i, 0, b) for i, b in enumerate([50, 40, 30, 30, 20, 10, 10, 5])]
    units = spark.createDataFrame([(s, u, b, 1) for s, u, b in rows], "virtual_slot int, sub int, bytes long, n_rows long")
    got = {r["virtual_slot"]: r["shard"] for r in sharding.build_map(units, 2).collect()}
    heap, want = [(0, 0), (0, 1)], {}
    for s, _, b in sorted(rows, key=lambda r: (-r[2], r[0])):
        load, shard = heapq.heappop(heap)
        want[s] = shard
        heapq.heappush(heap, (load + b, shard))
    assert got == want


def test_long_documents_of_a_small_share_keep_their_due(spark):
    # A shard of 64 documents gives some 600 words, less than half a long document.
    hot = spark.range(26_624).select("id", F.when(F.col("id") < 1024, 2000).otherwise(20).alias("n"), F.lit("a").alias("source"))
    rest = spark.range(1024).select((F.col("id") + 100_000).alias("id"), F.lit(2500).alias("n"), F.lit("b").alias("source"))
    docs = hot.union(rest).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.expr("repeat(' w', n - 1)")).alias("text"), "source")
    mixed = mixing.mixed_documents(docs, weights=(1, 20)).select("source", F.size(F.split("text", " ")).alias("n")).where("source = 'a'")
    long, words = mixed.agg(F.count_if(F.col("n") == 2000), F.sum("n")).first()
    target = (26_624 - 1024) * 20 + 1024 * 2000 + 1024 * 2500
    assert words == pytest.approx(target / 21, rel=0.2)
    assert long == pytest.approx(1024 * target / 21 / ((26_624 - 1024) * 20 + 1024 * 2000), rel=0.25)


def test_whole_documents_keep_columns_of_any_name(odd):
    named = odd.withColumns({n: F.lit(k) for k, n in enumerate(("__t_id", "__t_key", "__t_times", "copy", "c0", "a.b"))})
    mixed = mixing.mixed_documents(named)
    assert mixed.schema.names == named.schema.names
    rows = mixed.collect()
    assert rows and all(r[-6:] == (0, 1, 2, 3, 4, 5) for r in map(tuple, rows))
    assert sorted(map(str, (tuple(r)[:-6] for r in rows))) == sorted(map(str, map(tuple, mixing.mixed_documents(odd).collect())))
