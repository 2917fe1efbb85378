"""The pipeline against its stages' rules, stage by stage on each stage's own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from regionloom.llm import decontaminate, quality, simhash, store

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"
    ]
    outputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outputs.append(store.keep(stage(spark, outputs[-1], SF), name.replace(" ", "-")))
    for out in outputs[:-1]:
        assert out.columns == docs.columns
    good, single, clean, mixed, shards = outputs[1:]

    def ids(df):
        return Counter(r["doc_id"] for r in df.select("doc_id").collect())

    scores = {r["doc_id"]: r["predicted"] for r in quality.score_quality(docs, labels).collect()}
    assert ids(good) == Counter(i for i, p in scores.items() if p == 1)

    fps = [(r["doc_id"], (simhash.fingerprint(r["text"]), *(v & (2**64 - 1) for v in simhash.similar_views(r["text"])))) for r in good.collect()]

    def near(x, y):
        f, *w, g0, g1 = ((p ^ q).bit_count() for p, q in zip(x, y, strict=True))
        return f <= 4 or (min(w) <= 4 and g0 + g1 <= 23)

    stay, groups = set(), []
    for i, f in sorted(fps):
        hit = [g for g in groups if any(near(f, x) for _, x in g)]
        groups = [g for g in groups if g not in hit] + [[(i, f), *(m for g in hit for m in g)]]
    stay = {min(i for i, _ in g) for g in groups}
    assert set(ids(single)) == stay

    items = [p for p in (decontaminate.plain(r["text"]) for r in bench.collect()) if p]
    for r in single.collect():
        exact = any(p in decontaminate.plain(r["text"]) for p in items)
        assert not (exact and r["doc_id"] in ids(clean))
    assert set(ids(clean)) <= set(ids(single)) and len(ids(clean)) >= 0.8 * len(ids(single))

    assert set(ids(mixed)) <= set(ids(clean)) and max(ids(mixed).values()) <= 3
    assert ids(shards) == ids(mixed)
    assert set(r["shard"] for r in shards.select("shard").collect()) <= set(range(16))


def test_stages_of_odd_rows(spark, odd, none):
    named = odd.withColumns({n: F.lit(k) for k, n in enumerate(("stats", "c0", "c3", "measured", "a.b", "__id", "copy"))})
    rows = [tuple(r) for r in named.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, named, SF)
        got = [tuple(r) for r in out.collect()]
        assert stage(spark, none, SF).count() == 0, name
        if name == "sharding":
            assert Counter(r[0] for r in got) == Counter(r[0] for r in rows)
            continue
        assert out.columns == named.columns, name
        left = Counter(got)
        assert all(left[r] <= 3 * rows.count(r) for r in left), name
        if name == "SimHash near-dedup":
            assert sorted(Counter(r[0] for r in got).items(), key=str) == sorted({1: 1, 4: 1, 5: 1, None: 1, 7: 1, 9: 1, 10: 1, 11: 1, 12: 1}.items(), key=str)
        if name == "benchmark decontamination":
            assert left == Counter(rows)
        if name == "mixing sources to target weights":
            assert not any((r[1] or "").strip() == "" for r in got)


def test_run_leaves_one_table(spark):
    before = store.mark()
    corpus_pipeline.run(spark, SF)
    assert store.mark() == before + 1


def test_run_is_the_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    a = corpus_pipeline.run(spark, SF).drop("map_version")
    b = corpus_pipeline.run(spark, SF).drop("map_version")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0
