import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from regionloom.llm import decontaminate, licenses, quality

SF = "/root/testdata/sf0.01"


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    known = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in got]
    test = [(g["score"], q) for g, q in known if g["held_out"]]
    assert len(test) > 50
    assert np.mean([(s >= 0.5) == q for s, q in test]) > 0.95
    pairs = [(a > b) + 0.5 * (a == b) for a, x in test if x for b, y in test if not y]
    assert np.mean(pairs) > 0.98


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = [(r["doc_id"], 1 - r["quality"] if held_out(r["doc_id"]) else r["quality"], 0) for r in labels.collect()]
    a = quality.score_quality(docs, labels).collect()
    b = quality.score_quality(docs, spark.createDataFrame(turned, "doc_id long, quality int, toxic int")).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in a} == {r["doc_id"]: round(r["score"], 9) for r in b}


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 0, 0), (7, 1, None), (None, 1, 0), (8, None, 0), (5, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(odd, labels).count() == odd.count()
    assert quality.score_quality(none, labels).count() == 0
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    ones = labels.where("quality = 1 and doc_id = 5")
    assert {r["score"] for r in quality.score_quality(odd, ones).collect()} <= {1.0, 0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def isotonic(values, weights):
    """By the definition: the largest over starts of the least over ends of the mean in between."""
    def mean(a, b):
        return sum(v * w for v, w in zip(values[a : b + 1], weights[a : b + 1])) / sum(weights[a : b + 1])

    return [max(min(mean(a, b) for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]


def test_fit_is_the_direct_solution(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1) and not held_out(r["doc_id"])}
    rows = [([float(v) for v in quality.statistics(r["text"])], float(known[r["doc_id"]])) for r in docs.collect() if r["doc_id"] in known]
    got = quality.fit(spark.createDataFrame(rows, "stats array<double>, label double").repartition(7), features=64, bins=60, seed=3)

    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    d, n = x.shape[1], len(x)
    rng = np.random.default_rng(3)
    frequencies, phases = rng.normal(size=(d, 64)) / (1.5 * np.sqrt(d)), rng.uniform(0, 2 * np.pi, 64)
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-3), -8, 8)
    phi = np.column_stack([np.cos(z @ frequencies + phases) * np.sqrt(2 / 64), np.ones(n)])
    # ridge as least squares with a row of its own for each weight but the constant's
    tied = np.vstack([phi, np.sqrt(1e-4 * n) * np.eye(65)[:64]])
    weights = np.linalg.lstsq(tied, np.append(y, np.zeros(64)), rcond=None)[0]
    raw = phi @ weights
    assert got.raw(x) == pytest.approx(raw, abs=1e-6)

    bins = np.round((np.clip(raw, -0.5, 1.5) + 0.5) / 2 * 59).astype(int)
    present = sorted(set(bins.tolist()))
    share = [y[bins == b].mean() for b in present]
    many = [int((bins == b).sum()) for b in present]
    want = np.array(isotonic(share, many))
    centers = np.array([-0.5 + b * 2 / 59 for b in present])
    at = np.interp(centers, got.knots, got.values)
    assert at == pytest.approx(0.98 * want + 0.02 * (centers + 0.5) / 2, abs=1e-9)
    assert (np.diff(got.values) >= 0).all()


@pytest.mark.parametrize("seed", range(10))
def test_isotonic_by_definition(seed):
    rng = np.random.default_rng(seed)
    v, w = rng.integers(0, 5, 14) / 4, rng.integers(1, 6, 14).astype(float)
    assert quality.pool_adjacent_violators(v, w) == pytest.approx(isotonic(v.tolist(), w.tolist()))


def test_isotonic():
    v = quality.pool_adjacent_violators(np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.8]), np.array([1.0, 1, 1, 2, 1, 1]))
    assert v == pytest.approx([0.1, 0.35, 0.35, 0.35, 0.85, 0.85])


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    m = quality.QualityModel(np.zeros(d), np.ones(d), rng.normal(size=(d, 8192)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, 8192), np.zeros(8193), np.zeros(2), np.zeros(2))
    x = rng.normal(size=(30, d))
    z = m.features(x)
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - exact).max() < 0.06


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_licenses(text):
    """Best containment of each license over every window of the operator's widths."""
    words, best = plain_words(text), {}
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            tw = plain_words(t)
            width = min(len(tw), 5)
            want = {tuple(tw[i : i + width]) for i in range(len(tw) - width + 1)}
            stride = max(len(tw) // 4, 1)
            length = len(tw) + stride - 1
            for at in range(0, max(len(words), 1), stride):
                w = words[at : at + length]
                have = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
                share = len(want & have) / len(want)
                if share >= 0.8:
                    best[name] = max(best.get(name, 0), share)
    return best


def test_licenses(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rng = random.Random(4)
    filler = "alpha beta gamma delta epsilon zeta eta theta".split()
    extra = []
    for k, (name, texts) in enumerate(licenses.TEMPLATES.items()):
        for t in texts:
            noise = " ".join(rng.choices(filler, k=rng.randrange(60)))
            extra.append((10_000 + len(extra), f"{noise}\n{t.upper()}\n{noise}"))
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            extra.append((10_000 + len(extra), f"{noise} {' '.join(w)} {noise}"))
    rows += extra
    want = {(i, name): share for i, t in rows for name, share in brute_licenses(t).items()}
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx(want) and len(want) > 30
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(spark.createDataFrame([(None, "All rights reserved.")], "doc_id long, text string")).first()["doc_id"] is None


def test_bands_meet_at_the_stated_similarity():
    assert (1 - licenses.LEAST_JACCARD**licenses.ROWS) ** licenses.BANDS < 1e-6


def edits_inside(item, text):
    """Least edits from the item to some stretch of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("tail", [False, True])
def test_banded_edits(tail):
    rng = random.Random(5)
    cases = []
    for _ in range(400):
        item = "".join(rng.choices("abc", k=rng.randrange(1, 25)))
        text = "".join(rng.choices("abc", k=rng.randrange(0, 40)))
        cases.append((item, text, rng.randrange(6)))
    index = decontaminate.Index(list(range(len(cases))), [c[0] for c in cases])
    index.budget = np.array([c[2] for c in cases])
    index.from_tail = np.full(len(cases), tail)
    buffer, low, high = "\0" * 99, [], []
    for _, text, _ in cases:
        low.append(len(buffer))
        buffer += text
        high.append(len(buffer))
        buffer += "\0" * 99
    # a stretch reaches as far as the item is long, and then as far as the text is
    high = np.maximum(np.array(high), np.array(low) + [len(c[0]) for c in cases])
    got = decontaminate.edits_within(index, decontaminate.codes(buffer).astype(np.uint32), np.arange(len(cases)), np.array(low), high)
    assert got.tolist() == [min(edits_inside(item, text), budget + 1) for item, text, budget in cases]


def test_contaminated_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    letters = "abcdefghijklmnop"

    def prose(n):
        return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(n))

    items = [(k, prose(n)) for k, n in enumerate([3, 10, 20, 40, 60, 25, 25])] + [(90, None), (91, ""), (92, "?!"), (93, "tiny"), (None, "an item without any id at all, yet it counts")]
    items[6] = (6, items[5][1])
    rows = []
    for d in range(60):
        text = prose(rng.randrange(80))
        k = rng.randrange(7)
        piece = list(items[k][1])
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(piece))
            piece[at : at + 1] = rng.choice([[], [rng.choice(letters)], [piece[at], rng.choice(letters)]])
        if d % 3:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + " " + "".join(piece).upper() + "... " + text[at:]
        rows.append((d, text))
    rows += [(100, "A TINY thing"), (101, None), (102, ""), (None, "An ITEM, without any id at all -- yet it counts!"), (103, items[3][1]), (103, items[3][1])]
    want = Counter()
    for d, t in rows:
        p = decontaminate.plain(t)
        for k, x in items:
            q = decontaminate.plain(x)
            if q:
                budget = decontaminate.edit_budget(len(q)) if len(q) >= decontaminate.Q else 0
                e = edits_inside(q, p) if len(q) >= decontaminate.Q else (0 if q in p else 99)
                if e <= budget:
                    want[d, k, e] += 1
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_chars": 150}):
        got = Counter((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated(docs, bench, **options).collect())
        assert got == want and len(want) > 30
    index = decontaminate.Index([k for k, x in items if decontaminate.plain(x)], [decontaminate.plain(x) for k, x in items if decontaminate.plain(x)])
    for limits in ({"BUFFER_CHARS": 97}, {"POSTINGS": 20, "CELLS": 60}, {"BUFFER_CHARS": 97, "POSTINGS": 3, "CELLS": 1}):  # pieces shorter than an item, lists in parts
        for name, value in limits.items():
            monkeypatch.setattr(decontaminate, name, value)
        found = decontaminate.find_items(index, [decontaminate.plain(t) for _, t in rows])
        assert Counter((d, index.ids[i], e) for (d, _), f in zip(rows, found) for i, e in f.items()) == want
        monkeypatch.undo()
    clean = [r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()]
    assert Counter(clean) == Counter(d for d, _ in rows if d not in {d for d, k, _ in want if k != 93})  # "tiny" is too short to convict


def test_short_items_are_whole_words(spark):
    plain = decontaminate.plain
    index = decontaminate.Index([1, 2, 3], ["no", "a", "is known"])
    texts = ["nothing is known here", "No!", "is unknown", "this is known", "is known", "", "a-no", "banana"]
    assert [sorted(f) for f in decontaminate.find_items(index, [plain(t) for t in texts])] == [[2], [0], [], [2], [2], [], [0, 1], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([("x", "no"), ("y", "a"), ("z", "is known"), ("w", "ba na"), (None, "No."), ("x", "no")], "item_id string, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == Counter([(0, "z"), (1, "x"), (1, None), (3, "z"), (4, "z"), (6, "x"), (6, "y"), (6, None)])
    assert decontaminate.keep_clean(docs, bench).count() == len(texts)


def test_repeats_and_shared_stems_against_brute_force():
    rng = random.Random(8)

    def word():
        return "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8)))

    stem = "which of the following statements is the best answer to"
    items = [f"{stem} {' '.join(word() for _ in range(6))}" for _ in range(12)] + [f"{' '.join(word() for _ in range(6))} {stem}" for _ in range(6)]
    items += ["ha " * 20 + "ha", "abcab" * 12, "x" * 40]
    texts = [" ".join([stem] * 6), "ha " * 60, "abcab" * 30 + "ab", "x" * 39 + " " + "x" * 60, "x" * 38]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            t = list(rng.choice([*items, stem]))
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["q"], [t[at], "q"]])
            parts.append("".join(t))
        texts.append(decontaminate.plain(" ".join(parts)))
    index = decontaminate.Index(list(range(len(items))), items)
    assert index.from_tail[:12].all() and not index.from_tail[12:18].any()
    met = 0
    for t, f in zip(texts, decontaminate.find_items(index, texts)):
        want = {i: e for i, x in enumerate(items) if (e := edits_inside(x, t)) <= index.budget[i]}
        assert f == want, t
        met += len(want)
    assert met > 80


def test_many_items_of_one_stem_stay_quick():
    import time

    rng = random.Random(9)

    def words(n):
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n))

    stem = "which of the following statements is the best answer to"
    items = [f"{stem} {words(5)}" for _ in range(10_000)]
    index = decontaminate.Index(list(range(len(items))), items)
    planted = rng.sample(range(len(items)), 40)
    text = " ".join(f"{stem} {words(8)}" for _ in range(100)) + " " + " ".join(items[i][:-7] + "Q" + items[i][-6:] for i in planted)
    began = time.time()
    (found,) = decontaminate.find_items(index, [decontaminate.plain(text)])
    assert found == dict.fromkeys(planted, 1)
    assert time.time() - began < 60
    began = time.time()
    few = decontaminate.Index(list(range(100)), items[:100])
    (found,) = decontaminate.find_items(few, [" ".join([stem] * 2000)])
    assert found == {} and time.time() - began < 60


def test_contamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "some benchmark passage of words that nobody has")], "item_id long, text string")
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0 and decontaminate.keep_clean(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.keep_clean(odd, bench).columns == odd.columns
