"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document are standardised and mapped by cosines of random projections, whose products approximate a
Gaussian kernel. Each partition sums its part of the normal equations, from which the ridge weights follow. Two fits,
each on one half of the labelled rows, score the other half; a monotone map from these scores to labels calibrates the
fit on all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..workers import map_arrow
from .divergence import CLASSES, text_counts
from .shared import as_bytes, cut

FEATURES, SCALE, RIDGE, BINS, SEED = 256, 0.8, 1.0, 1000, 11
#: Raw scores are binned between these.
LOW, HIGH = -1.0, 2.0
STATISTICS = 21
#: Partitions whose sums one task adds up.
FAN_IN = 8


def statistics(text: bytes) -> list[float]:
    """Shape of a text, from all of it: lengths, shares of character classes, marks, repeated lines and words."""
    n, word_chars, symbols, dup_lines, repeat_words, classes, common = text_counts(text)
    chars, words, lines = max(sum(classes), 1), max(n, 1), text.count(b"\n") + 1
    letters = max(classes[0] + classes[1] + classes[7], 1)
    shares = [c / chars for c in classes]
    return [
        np.log1p(n), np.log1p(lines), word_chars / words, *shares, classes[1] / letters, symbols / words, dup_lines / lines, repeat_words / words,
        1 - common[-1] / words, text.count(b"!") / words, text.count(b"|") / words, text.count(b".") / words, text.count(b",") / words, lines / words,
    ]


assert len(statistics(b"")) == 3 + len(CLASSES) + 10 == STATISTICS


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (21 numbers) of every row's whole text; null text is empty."""
    import pyarrow as pa

    schema = docs.select("doc_id").withColumn("stats", F.array().cast("array<double>")).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([statistics(t) for t in as_bytes(some.column("text"))], pa.list_(pa.float64()))], names=schema.names)

    return map_arrow(docs.select("doc_id", "text"), measure, schema)


@dataclass
class Fourier:
    """The map from statistics to random Fourier features, a constant first."""

    mean: np.ndarray
    spread: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        n = len(self.mean)
        w = rng.normal(size=(n, FEATURES)) / (SCALE * np.sqrt(n))
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(x @ w + shift)])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def _normal_equations(rows: DataFrame, features: Fourier) -> dict[int, np.ndarray]:
    """For each fold Z'[Z y], summed in each partition, then in a tree of ``FAN_IN`` partitions to a task.

    One matrix for each fold reaches the driver, however many partitions there are; no task holds more than ``FAN_IN``
    of each. Sums are taken in the order of their bytes, so reruns agree.
    """
    import pyarrow as pa

    size = FEATURES + 1

    def told(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["fold", "sums"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y, fold = features(_matrix(batch.column("stats"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for f in np.unique(fold):
                part = z[fold == f]
                sums[int(f)] = sums.get(int(f), 0) + part.T @ np.hstack([part, y[fold == f, None]])
        if sums:
            yield told(sums)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        parts = [x for batch in batches for x in zip(batch.column("fold").to_pylist(), batch.column("sums").to_pylist(), strict=True)]
        for f, s in sorted(parts):
            sums[f] = sums.get(f, 0) + np.frombuffer(s)
        if sums:
            yield told(sums)

    schema = "fold int, sums binary"
    parts, n = map_arrow(rows.select("stats", "y", "fold"), partial, schema), rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN_IN)
        parts = map_arrow(parts.repartition(n), merge, schema)
    return {r[0]: np.frombuffer(bytes(r[1])).reshape(size, size + 1) for r in parts.collect()}


def solve(sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    penalty = ridge * np.eye(len(sums))
    penalty[0, 0] = 1e-9
    return np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest values that don't fall, in squares weighted by ``weights``: pool adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


@dataclass
class Model:
    features: Fourier
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        # a thousandth of the raw score keeps apart what the calibration makes equal
        return np.clip(0.999 * np.interp(raw, self.at, self.value) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from ``labels`` (doc_id, quality); several labels of one id count as its largest. None without labels.

    Rows whose crc32 of doc_id as text leaves 1 when divided by 3 are not used.
    """
    import pyarrow as pa

    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3).cast("int")
    rows = cut(stats.join(known.withColumn("fold", fold).where("fold <> 1"), "doc_id").select("stats", "y", "fold"))
    terms = [f(F.element_at("stats", i + 1)) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]
    found = rows.agg(F.count("*"), *terms).first()
    if not found[0]:
        return None
    mean, spread = np.array(found[1::2], float), np.array(found[2::2], float)
    features = Fourier(mean, np.where(spread > 1e-9, spread, 1.0))
    sums = _normal_equations(rows, features)
    weights = solve(sum(sums.values()))
    crossed = {f: solve(sums[2 - f]) if 2 - f in sums else weights for f in sums}

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, folds = features(_matrix(batch.column("stats"))), batch.column("fold").to_numpy()
            raw = np.zeros(len(z))
            for f, w in crossed.items():
                raw[folds == f] = z[folds == f] @ w
            bins = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), batch.column("y")], names=["bin", "y"])

    table = map_arrow(rows, cross, "bin int, y double").groupBy("bin").agg(F.avg("y"), F.count("*")).orderBy("bin").collect()
    bins, value, weight = (np.array(c, float) for c in zip(*table, strict=True))
    return Model(features, weights, LOW + (bins + 0.5) * (HIGH - LOW) / BINS, isotonic(value, weight))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Reads doc_id and text; the id only says which rows are held out, and other columns, whatever their names, are ignored.
    Texts are measured whole, whatever their length. Null and empty texts are scored by their statistics like any other; a
    null doc_id is not held out and has no label; without any label every score is 0.5. Repeated rows repeat, and each
    counts in the fit if its id has a label. An empty table gives no rows.
    """
    import pyarrow as pa

    stats = cut(with_statistics(docs))
    model = fit(stats, labels)
    schema = docs.select("doc_id").schema.add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model(_matrix(batch.column("stats"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = map_arrow(stats, score, schema)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
