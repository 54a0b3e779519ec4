"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text becomes a fixed vector of document statistics.  Cosines of random
projections of the standardised vector approximate a Gaussian kernel, so ridge
regression on them is kernel regression with sums of fixed size: every partition
adds up its part of the normal equations, Spark adds the parts row by row, and
the driver solves one system of ``features`` unknowns.  Scores are calibrated by
isotonic regression on scores that each labelled row gets from the half of the
labelled rows it is not in; that regression sees one row per score bin.

What reaches the driver is bounded by ``features`` squared and ``bins``, whatever
the number of documents.  No labelled row is left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.quality_rules import SPACE, SYMBOLS, repeat_words
from sparkloom.runtime import materialise

_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", SPACE, b"\n", SYMBOLS, b"!", b".,", b"?;:'\"()-", bytes(range(128, 256)))
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _TABLE[list(_c), _i] = 1
STATS = 25
_PIECE = 1 << 16


def statistics(text: str | None) -> list[float]:
    """``STATS`` numbers that describe a whole text; an empty one has only zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * (STATS - 1) + [math.log1p(size)]
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (hist @ _TABLE / size).tolist()
    p = hist[hist > 0] / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    sizes = np.fromiter(map(len, words), np.int64, n)
    packed = zlib.compressobj(1)
    zipped = sum(len(packed.compress(raw[i : i + _PIECE])) for i in range(0, size, _PIECE)) + len(packed.flush())
    ends = sum(1 for x in lines if x.rstrip(SPACE)[-1:] in b".!?")
    marks = raw.translate(None, bytes(x for x in range(256) if x not in SYMBOLS))
    return shares + [
        float(-(p * np.log2(p)).sum()), float(sizes.mean()), float(sizes.std()), len(counts) / n,
        counts.most_common(1)[0][1] / n, len(counts) / math.sqrt(n), 1 - len(set(lines)) / len(lines), ends / len(lines),
        math.log1p(n / len(lines)), repeat_words(words) / n, min(zipped / size, 2.0), math.log1p(n),
        len(set(marks)) / len(SYMBOLS), sum(1 for w in words if w.isupper()) / n, math.log1p(size),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, x): hash of the text and statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "h", "x"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray  # calibrated value at raw scores, linear in between
    levels: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -3, 3)  # beyond the training data the kernel knows nothing
        out = np.cos(z @ self.waves + self.phase) * math.sqrt(2 / self.waves.shape[1])
        return np.hstack([out, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # a hundredth of the raw score keeps the order of texts in the same pool
        return 0.99 * np.interp(raw, self.cuts, self.levels) + 0.01 * np.clip(raw, 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), STATS)


def _normal_equations(train: DataFrame, model: Model, rows_each: int = 16) -> np.ndarray:
    """Sums over the rows of each half: [half, features + 1, features + 2], the last column for the labels."""
    size = len(model.phase) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size, size + 1))
        for b in batches:
            x, y, half = _matrix(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2))
            for i in range(0, len(x), 4096):
                z = model.map(x[i : i + 4096])
                for h in (0, 1):
                    own = half[i : i + 4096] == h
                    sums[h] += z[own].T @ np.column_stack([z[own], y[i : i + 4096][own]])
        keys = [(h, r) for h in (0, 1) for r in range(0, size, rows_each)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in keys], pa.int32()), pa.array([r for _, r in keys], pa.int32()),
             pa.array([sums[h, r : r + rows_each].tobytes() for h, r in keys], pa.binary())], names=["half", "first", "part"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, float) for p in t["part"].to_pylist())
        return pa.table({"half": t["half"][:1], "first": t["first"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    kind = "half int, first int, part binary"
    parts = train.select("x", F.col("y").cast("double"), "half").mapInArrow(partial, kind).groupBy("half", "first").applyInArrow(add, kind)
    out = np.zeros((2, size, size + 1))
    for half, first, part in parts.collect():
        rows = np.frombuffer(part, float).reshape(-1, size + 1)
        out[half, first : first + len(rows)] = rows
    return out


def _solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    a, b = sums[:, :-1].copy(), sums[:, -1]
    penalty = np.full(len(a), ridge)
    penalty[-1] = 1e-9
    a[np.diag_indices_from(a)] += penalty
    return np.linalg.solve(a, b)


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression of values in order, by pooling neighbours that violate it."""
    stack: list[list[float]] = []
    for v, w in zip(value, weight):
        stack.append([v, w, 1])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            v2, w2, n2 = stack.pop()
            v1, w1, n1 = stack.pop()
            stack.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([s[0] for s in stack], [s[2] for s in stack])


def fit(train: DataFrame, feature_count: int = 256, ridge: float = 0.5, bins: int = 1024, seed: int = 7) -> Model:
    """Fit on ``train`` (x, y 0 or 1, half 0 or 1); rows with a NULL label are left out by the caller.

    Without rows the score is 0.5 everywhere; with one class it is that class.
    """
    rng = np.random.default_rng(seed)
    waves = rng.standard_normal((STATS, feature_count)) / math.sqrt(STATS)
    phase = rng.uniform(0, 2 * math.pi, feature_count)
    stat = train.agg(F.count(F.lit(1)), F.avg("y"), *[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(STATS)]).first()
    zero = np.zeros(feature_count + 1)
    if not stat[0]:
        return Model(np.zeros(STATS), np.ones(STATS), waves, phase, zero, np.array([0.0]), np.array([0.5 / 0.99]))
    mean, spread = np.array(stat[2 : 2 + STATS]), np.array(stat[2 + STATS :])
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), waves, phase, zero, np.array([0.0]), np.array([float(stat[1])]))
    if stat[1] in (0.0, 1.0):
        return model
    sums = _normal_equations(train, model)
    other = np.stack([_solve(sums[1 - h], ridge) for h in (0, 1)])  # row h: fitted without half h
    low, high = -0.5, 1.5

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, half = model.map(_matrix(b.column(0))), np.asarray(b.column(2))
            raw = np.clip((z * other[half]).sum(axis=1), low, high)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum((raw - low) / (high - low) * bins, bins - 1).astype(np.int32)), b.column(1)], names=["bin", "y"])

    got = train.select("x", F.col("y").cast("int"), "half").mapInArrow(crossed, "bin int, y int").groupBy("bin").agg(F.count(F.lit(1)), F.sum("y")).orderBy("bin").collect()
    place = np.array([low + (r[0] + 0.5) * (high - low) / bins for r in got])
    weight, ones = np.array([float(r[1]) for r in got]), np.array([float(r[2]) for r in got])
    prior = float(stat[1])
    model.cuts, model.levels = place, pool_adjacent((ones + prior) / (weight + 1), weight + 1)
    model.weights = _solve(sums[0] + sums[1], ridge)
    return model


def score(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", **options,
) -> DataFrame:
    """(doc_id, h, score): probability of label 1 for every row of ``docs``, empty texts too; ``h`` is the hash of the text.

    ``usable`` is a condition on ``doc_id`` that says which labels may be learned
    from.  NULL labels and labels without a document teach nothing; repeated
    labels and documents count as often as they occur; rows with a NULL id are
    scored.  Only the text enters the score.
    """
    rows = materialise(features(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    if usable is not None:
        known = known.where(usable)
    train = materialise(rows.join(known, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")), "labelled")
    model = fit(train, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column(2))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.clip(s, 0, 1), pa.float64())], names=["doc_id", "h", "score"])

    return rows.mapInArrow(run, "doc_id long, h long, score double")
