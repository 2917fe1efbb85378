import numpy as np
import pandas as pd
import pytest
from xxhash import xxh3_128_intdigest, xxh64_intdigest

from regionloom.llm import components, simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Union of all pairs at distance 4 or less; null ids have no say in the smallest id."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f"{f:016x}", least.get(root(f))) for i, f in rows]


def plain_views(text):
    """Four word-set fingerprints and the 128 bits of the five-word shingles', by counting each bit."""
    words = (text or "").encode().lower().split()

    def bits(features, seed=0):
        hashes = [xxh3_128_intdigest(f, seed) for f in features]
        return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    v, w = bits(set(words)), bits(set(words), 1)
    return (v >> 64, v & (2**64 - 1), w >> 64, w & (2**64 - 1)), bits([b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))] if words else [])


def plain_groups(texts):
    """Groups of texts under the links of fingerprints and of similar views, over all pairs."""
    known = [(plain_fingerprint(t), *plain_views(t)) for t in texts]
    group = list(range(len(texts)))
    for i, (f, w, g) in enumerate(known):
        for j, (f2, w2, g2) in enumerate(known[:i]):
            near = (f ^ f2).bit_count() <= 4 or ((g ^ g2).bit_count() <= 23 and min((a ^ b).bit_count() for a, b in zip(w, w2)) <= 4)
            if near and group[i] != group[j]:
                group = [group[j] if x == group[i] else x for x in group]
    return group


def edited(rng, text, share):
    words = text.split()
    for _ in range(int(len(words) * share)):
        words[rng.integers(len(words))] = f"new{rng.integers(10**6)}"
    return " ".join(words)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def test_similar_texts_are_one_group(spark, real):
    rng = np.random.default_rng(5)
    long = [t for _, t, _ in real if t and 80 < len(t.split()) < 400][:60]
    texts = [t or "" for _, t, _ in real] + [edited(rng, t, s) for t in long for s in (0.01, 0.02, 0.1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one_per_group(docs).collect()}
    groups = plain_groups(texts)
    first = {}
    for i, g in enumerate(groups):
        first.setdefault(g, i)
    # a fingerprint's texts go by one view, so texts whose fingerprints are equal may be read as each other
    assert len(kept ^ set(first.values())) <= 1
    pairs = [(i, j) for k, t in enumerate(long) for i in [texts.index(t)] for j in range(len(real) + 3 * k, len(real) + 3 * k + 2)]
    alike = [(i, j) for i, j in pairs if len(shingles(texts[i]) & shingles(texts[j])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[j]))]
    assert len(alike) > 80 and np.mean([groups[i] == groups[j] for i, j in alike]) >= 0.9
    narrow = {r["doc_id"] for r in simhash.keep_one_per_group(docs, similar=False).collect()}
    assert kept < narrow


def test_views():
    for t in (None, "", " \n", "one", "one two three four", "A b a B  c d e f", "w " * 3000, " ".join(f"x{i % 37}" for i in range(900))):
        w, g = plain_views(t)
        assert [v & (2**64 - 1) for v in simhash.similar_views(t)] == [*w, g >> 64, g & (2**64 - 1)]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_real_documents(spark, real):
    docs = spark.createDataFrame(real, "doc_id long, text string, source string")
    assert order(simhash.near_duplicates(docs).collect()) == order(plain_components([(i, plain_fingerprint(t)) for i, t, _ in real]))


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()]
    assert order(simhash.near_duplicates(odd).collect()) == order(plain_components(rows))
    assert simhash.near_duplicates(none).count() == 0
    odd = odd.withColumn("__gone_id", odd["doc_id"] * 0)
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for i, _, c in plain_components(rows) if i == c or i is None} | {None}


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (" ".join(f"{p}{k}" for k in range(40)) for p in "abcd")
    rows = [(3, a, "x"), (3, a, "y"), (3, a, "x"), (None, b, "x"), (None, b, "y"), (1, c, "x"), (2, c, "x"), (2, d, "x"), (None, c, "x"), (2, a.upper(), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string")
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one_per_group(docs).collect()]
    assert order(kept) == order([(2, a.upper()), (None, b), (1, c), (2, d)])
    kept = simhash.keep_one_per_group(docs.where("note = 'x' AND doc_id IS NULL OR doc_id = 3"))
    assert order((r["doc_id"], r["text"]) for r in kept.collect()) == order([(3, a), (None, b), (None, c)]) and kept.columns == docs.columns


@pytest.mark.parametrize(("seed", "links", "refined"), [(0, 2, 2048), (1, 3, 2048), (2, 2, 20)])
def test_links_lose_no_pair_in_dense_groups(spark, monkeypatch, seed, links, refined):
    monkeypatch.setattr(simhash, "REFINED_FROM", refined)
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set()
    for c in centers:
        for _ in range(150):
            f = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                f ^= 1 << int(b)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    if refined == 2048:
        links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), links).collect()
    else:  # in this process, where the limit is lowered
        rows = pd.concat(simhash.chain_keys(2)(iter([pd.DataFrame({"fp": signed})]))).sort_values("key")
        links = [tuple(map(int, r)) for r in pd.concat(simhash.links_by_key(2)(iter([rows]))).values.tolist()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    roots = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = {}
    for f, s in zip(fps, signed):
        groups.setdefault(roots.get(s, s), set()).add(f)
    want = {}
    for i, f, c in plain_components(list(enumerate(fps))):
        want.setdefault(c, set()).add(fps[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert len(links) < 10 * len(fps)  # forests per key, not all pairs, and each pair once


def test_keys_across_batches():
    rows = pd.DataFrame({"key": [1, 1, 2, 2, 2, 3], "fp": [0, 1, 4, 5, 7, 9]})
    whole = pd.concat(simhash.links_by_key(2)(iter([rows])))
    cut = pd.concat(simhash.links_by_key(2)(iter([rows[:1], rows[1:3], rows[3:4], rows[4:]])))
    assert order(whole.values.tolist()) == order(cut.values.tolist())


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 4), (9, 9), (None, 1)] + [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1100)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4} | dict.fromkeys(range(101, 161), 100) | dict.fromkeys(range(1001, 1100), 1000)
