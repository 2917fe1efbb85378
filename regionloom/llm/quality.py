"""Quality scores: random Fourier features, ridge by summed normal equations, isotonic calibration.

1. A fixed list of statistics is computed from each whole text, once, and kept as
   a narrow table (`document_statistics`).
2. Random Fourier features turn the standardised statistics into ``D`` cosines
   whose inner products approximate a Gaussian kernel.
3. Each partition of the labelled rows adds up its own normal equations
   ``(Phi'Phi, Phi'y)``; partitions' sums are added in two levels, and the driver
   solves one ``D x D`` ridge system.  Memory depends on ``D`` only.
4. Ridge scores of the labelled rows are counted into fixed bins; pooling adjacent
   violators over the bins gives a monotone map from score to probability.

Everything that is fitted comes from all labelled rows that are not held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shipping
from . import store

STATISTICS = (
    "log_words", "mean_word", "distinct_words", "top_word", "stop_words", "short_words", "upper", "digit", "symbol", "sentence_ends",
    "exclaims", "bars", "commas", "capital_words", "log_lines", "line_words", "repeated_lines", "repeated_pairs", "letters", "longest_run",
)

#: Frequent function words of four languages (fixed values).
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "el la de que y en un ser se no haber por con su para como estar tener le lo todo pero más hacer o poder los las del "
    "le les des et à il un du ne est une pas qui dans ce que pour sur au par se plus avec son nous vous elle sont".split()
)

_WORD_EDGE = ".,;:!?\"'()[]{}"


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; a null text is an empty one."""
    text = text or ""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    counted = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    plain = [w.strip(_WORD_EDGE).lower() for w in words]
    # one pass over the characters in C: everything outside the classes is deleted
    upper = len(re.findall(r"[^\W\d_a-zß-öø-ÿ]", text))
    digits = len(re.findall(r"\d", text))
    letters = len(re.findall(r"[^\W\d_]", text))
    symbols = sum(map(text.count, "#*$%&<>=~^@\\{}[]_"))
    run = best = 0
    last = None
    for w in words:
        run = run + 1 if w == last else 1
        best, last = max(best, run), w
    return [
        np.log1p(len(words)),
        min(sum(map(len, words)) / n, 40.0),
        len(counted) / n,
        max(counted.values(), default=0) / n,
        sum(map(STOP_WORDS.__contains__, plain)) / n,
        sum(len(w) <= 3 for w in plain) / n,
        upper / max(letters, 1),
        digits / chars,
        min(symbols / n, 4.0),
        min(sum(map(text.count, ".?")) / n, 2.0),
        min(text.count("!") / n, 4.0),
        min(text.count("|") / n, 2.0),
        min(text.count(",") / n, 2.0),
        sum(w[:1].isupper() for w in words) / n,
        np.log1p(len(lines)),
        min(n / max(len(lines), 1), 400.0) / 100,
        1 - len(set(lines)) / max(len(lines), 1),
        1 - len(pairs) / max(len(words) - 1, 1) if len(words) > 1 else 0.0,
        letters / chars,
        np.log1p(best),
    ]


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats``: one row per input row, whatever its other columns."""

    shipping.ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), _measured()(F.col(text_col)).alias("stats"))


def _measured():
    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    return measured


def is_held_out(doc_id: F.Column, *, folds: int = 3, fold: int = 1) -> F.Column:
    """Whether crc32 of the id as text falls into the fold that isn't learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs; a few hundred kilobytes at most."""

    center: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def constant_model(value: float) -> QualityModel:
    """Gives every text the same score: what is learned from no rows, or from one class only."""
    d = len(STATISTICS)
    return QualityModel(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(2), np.array([0.0, 1.0]), np.array([value, value]))


def pool_adjacent_violators(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` under ``weights``."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.array([])


def fit(
    labelled: DataFrame, *, features: int = 256, bandwidth: float = 1.5, ridge: float = 1e-4, bins: int = 2000, seed: int = 7, groups: int = 16
) -> QualityModel:
    """Learn from rows ``stats, label`` (label 0 or 1).

    ``bandwidth`` is the kernel's width in units of the square root of the number
    of statistics; ``ridge`` is per labelled row.  All rows given are used.
    """
    d = len(STATISTICS)
    moments = labelled.agg(
        F.count("*").alias("n"),
        F.sum("label").alias("ones"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)],
    ).first()
    n, ones = moments["n"], moments["ones"] or 0
    if n == 0 or ones in (0, n):
        return constant_model(ones / n if n else 0.5)
    rng = np.random.default_rng(seed)
    model = QualityModel(
        np.array([moments[f"m{i}"] for i in range(d)]),
        np.maximum([moments[f"s{i}"] for i in range(d)], 1e-3),
        rng.normal(size=(d, features)) / (bandwidth * np.sqrt(d)),
        rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1),
        np.array([0.0, 1.0]),
        np.array([0.0, 1.0]),
    )
    share = labelled.sparkSession.sparkContext.broadcast(model)
    width = features + 2  # cosines, constant, label

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = np.array(batch["stats"].tolist())
                a = np.column_stack([share.value.features(x), np.ones(len(x)), batch["label"].to_numpy(float)])
                total += a.T @ a
        yield pd.DataFrame({"sums": [total.tobytes()], "part": [int(rng_part())]})

    def rng_part() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId() % groups

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for parts in batches:
            for b in parts["sums"]:
                total = np.frombuffer(b) if total is None else total + np.frombuffer(b)
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    by_partition = labelled.select("stats", "label").mapInPandas(summed, "sums binary, part int")
    # Partitions' sums are added as they stream by, then at most `groups` rows of fixed size reach the driver.
    sums = by_partition.repartition(groups, "part").mapInPandas(added, "sums binary").collect()
    normal = np.sum([np.frombuffer(r["sums"]) for r in sums], axis=0).reshape(width, width)
    gram, target = normal[:-1, :-1], normal[:-1, -1]
    penalty = np.diag(np.append(np.full(features, ridge * n), 0.0))
    weights = np.linalg.solve(gram + penalty, target)
    ridged = QualityModel(model.center, model.scale, model.frequencies, model.phases, weights, model.knots, model.values)

    low, high = -0.5, 1.5
    raw = labelled.select("label", _by_model(ridged, "raw")(F.col("stats")).alias("raw"))
    position = (F.least(F.greatest(F.col("raw"), F.lit(low)), F.lit(high)) - low) / (high - low) * (bins - 1)
    counts = raw.groupBy(F.round(position).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("ones")).collect()
    counts.sort(key=lambda r: r["bin"])
    pooled = pool_adjacent_violators(np.array([r["ones"] / r["n"] for r in counts], float), np.array([r["n"] for r in counts], float))
    centers = np.array([low + r["bin"] * (high - low) / (bins - 1) for r in counts])
    # A slight slope keeps the ridge's order inside a pooled block and beyond the ends.
    knots = np.concatenate([[low - 10], centers, [high + 10]])
    steady = np.concatenate([[pooled[0]], pooled, [pooled[-1]]])
    slope = (np.clip(knots, low, high) - low) / (high - low)
    return QualityModel(model.center, model.scale, model.frequencies, model.phases, weights, knots, 0.98 * steady + 0.02 * slope)


def _by_model(model: QualityModel, what: str):
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for stats in batches:
            yield pd.Series(getattr(model, what)(np.array(stats.tolist()).reshape(len(stats), len(STATISTICS))))

    return F.pandas_udf(compute, "double")


def label_rows(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One ``doc_id, label`` per labelled id: rows lacking either are left out, an id labelled both ways is 0."""
    return (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0.0, 1.0))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fit_options
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``score`` lies in 0..1 and rises with the likelihood of label 1; ``predicted``
    is 1 from 0.5 on.  Only statistics of the text enter a score.  Rows whose id
    falls into the held-out fold are never learned from.  Null and empty texts are
    scored like any text; null ids and repeated rows are kept; without any usable
    label all scores are 0.5, with one class only they are that class.
    """
    stats = store.keep(document_statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    known = label_rows(labels, label_col=label_col).where(~is_held_out(F.col("doc_id")))
    labelled = store.keep(stats.join(known, "doc_id").select("stats", "label"), "labelled")
    model = fit(labelled, **fit_options)
    scored = stats.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), _by_model(model, "score")(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with their columns as they were.

    Statistics are computed once, and written beside the rows for the second pass.
    Null and empty texts are scored like any text, repeated rows and null ids each on
    their own; without any usable label all scores are 0.5 and all rows stay.
    Columns may have any name; an empty table gives an empty result.
    """
    shipping.ship(docs.sparkSession)
    own = [docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(docs.columns)]
    measured = store.keep(docs.select(*own, docs[id_col].alias("doc_id"), _measured()(docs[text_col]).alias("stats")), "measured")
    known = label_rows(labels).where(~is_held_out(F.col("doc_id")))
    labelled = store.keep(measured.select("doc_id", "stats").join(known, "doc_id").select("stats", "label"), "labelled")
    good = measured.where(_by_model(fit(labelled, **options), "score")(F.col("stats")) >= 0.5)
    return good.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
