"""Hard negatives by whole-number inner products, searched through one-bit codes.

A vector x is turned by a seeded rotation and kept as the signs of its components, a
unit vector b (signs over the root of the dimension), with its alignment a = <x, b>
and what is left, r = |x - a b|.  An anchor y keeps its turned components as bit
planes, so <b, y> is a few popcounts, exact but for a rounding of known size.  Then

    <x, y> = a <b, y> + <x - a b, y>,   |<x - a b, y>| <= r * sqrt(|y|^2 - <b, y>^2)

(Cauchy-Schwarz, as x - a b is orthogonal to b): an interval that always holds.  Rows
whose interval cannot reach the best scores found so far are left out; all others are
scored in whole numbers, so the result is exact and the codes only save work.

Anchors are the given set, a share of the rows; they meet all rows block by block, and
a block passes on only its best rows of each anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import pieces
from sparkloom.runtime import materialise

_PLANES = 6  # bits of an anchor's components
_CHUNK = 128  # anchors compared at once
_SCORED = 1 << 16  # pairs scored at once


def rotation(size: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, size: int, dtype=np.int64) -> np.ndarray:
    """Rows of a list column, filled up with zeros to one length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(-1, size).astype(dtype)
    out = np.zeros((len(column), size), dtype)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def _encoder(size: int, scale: int):
    """Integer components, one-bit code, alignment and rest of each vector."""
    words = -(-size // 64)

    def run(batches):
        turn = rotation(size)
        for b in batches:
            x = np.floor(scale * _matrix(b.column("vec"), size, np.float64))
            if np.abs(x).max(initial=0) >= 2.0**31 or (x * x).sum(axis=1).max(initial=0) >= 2.0**54:
                raise ArithmeticError("components are too large for whole-number scores")
            y = x @ turn
            align = np.abs(y).sum(axis=1) / np.sqrt(size)
            rest = np.sqrt(np.maximum((x * x).sum(axis=1) - align * align, 0.0))
            bits = np.zeros((len(x), words * 64), bool)
            bits[:, :size] = y > 0
            code = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), b.column("anchor"), _lists(x.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(align), pa.array(rest)],
                names=["id", "label", "anchor", "vec", "code", "align", "rest"])

    return run


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


class _Rows:
    """One block of rows or anchors as arrays."""

    def __init__(self, t: pa.Table, size: int, labels: np.ndarray):
        t = t.combine_chunks()
        self.row, self.id, self.label = t["row"].to_numpy(), t["id"].to_numpy(), labels
        self.vec = _matrix(t["vec"].chunk(0), size)
        self.code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint64).reshape(len(t), -1)
        self.align, self.rest = t["align"].to_numpy(), t["rest"].to_numpy()


def _labels(*tables: pa.Table) -> list[np.ndarray]:
    """The label columns as numbers that agree between the tables."""
    all_ = pa.chunked_array([c for t in tables for c in t["label"].chunks], tables[0].schema.field("label").type)
    codes = all_.combine_chunks().dictionary_encode().indices.to_numpy()
    return np.split(codes, np.cumsum([len(t) for t in tables])[:-1])


def intervals(anchors: np.ndarray, turn: np.ndarray, code: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, low, high) of the inner product of every anchor with every coded row."""
    size = len(turn)
    y = anchors @ turn
    low = y.min(axis=1, keepdims=True)
    step = np.maximum((y.max(axis=1, keepdims=True) - low) / (2**_PLANES - 1), 1e-300)
    level = np.rint((y - low) / step).astype(np.uint8)
    lost = np.linalg.norm(y - (low + step * level), axis=1)  # rounding of the planes
    set_ = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    hit = np.zeros((len(y), len(code)), np.int64)
    bits = np.zeros((len(y), code.shape[1] * 64), np.uint8)
    for k in range(_PLANES):
        bits[:, :size] = level >> k & 1
        plane = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        for w in range(code.shape[1]):
            hit += np.bitwise_count(plane[:, w, None] & code[None, :, w]).astype(np.int64) << k
    whole = low[:, 0] * size + step[:, 0] * level.sum(axis=1, dtype=np.int64)
    dot = (2 * (low * set_[None, :] + step * hit) - whole[:, None]) / np.sqrt(size)  # <b, y> but for ``lost``
    norm = np.linalg.norm(y, axis=1)
    slack = (lost + 1e-9 * (1 + norm))[:, None]
    near = np.maximum(np.abs(dot) - slack, 0.0)
    wide = align[None, :] * slack + rest[None, :] * np.sqrt(np.maximum((norm * norm)[:, None] - near * near, 0.0)) * (1 + 1e-9) + 1e-6
    estimate = align[None, :] * dot
    return estimate, estimate - wide, estimate + wide


def _score(a: np.ndarray, x: np.ndarray, need: np.ndarray, out: np.ndarray) -> None:
    """Exact scores where they are needed and not known yet."""
    i, j = np.nonzero(need)
    for lo in range(0, len(i), _SCORED):
        s = slice(lo, lo + _SCORED)
        out[i[s], j[s]] = np.einsum("ij,ij->i", a[i[s]], x[j[s]])


_UNKNOWN = np.iinfo(np.int64).min


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; the smallest number where there are fewer columns."""
    if values.shape[1] < k:
        return np.full(len(values), _UNKNOWN)
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k]


def _likely(estimate: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The k allowed columns of highest estimate in each row."""
    if estimate.shape[1] <= k:
        return allowed
    worth = np.where(allowed, estimate, -np.inf)
    top = np.argpartition(worth, estimate.shape[1] - k, axis=1)[:, -k:]
    out = np.zeros_like(allowed)
    np.put_along_axis(out, top, True, axis=1)
    return out & allowed


def _inside(score: np.ndarray, may: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
    """Known scores of which a hundredfold lies between the bounds."""
    known = may & (score != _UNKNOWN)
    hundred = 100 * np.where(known, score, 0)
    return known & (hundred >= floor) & (hundred <= ceiling)


def _best(score: np.ndarray, ids: np.ndarray, inside: np.ndarray, k: int):
    """(row, column) of the k best of each row among ``inside``: highest score, then smallest id."""
    i, j = np.nonzero(inside)
    order = np.lexsort((ids[j], -score[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[place < k], j[place < k]


def _positives(size: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            own, all_ = _labels(left, right)
            a, x = _Rows(left, size, own), _Rows(right, size, all_)
            turn = rotation(size)
            for lo in range(0, len(a.id), _CHUNK):
                s = slice(lo, lo + _CHUNK)
                allowed = (a.label[s, None] == x.label) & (a.id[s, None] != x.id)
                estimate, _, high = intervals(a.vec[s].astype(float), turn, x.code, x.align, x.rest)
                score = np.full(allowed.shape, _UNKNOWN)
                first = _likely(estimate, allowed, k)
                _score(a.vec[s], x.vec, first, score)
                need = allowed & ~first & (high >= _kth(score, k)[:, None])
                _score(a.vec[s], x.vec, need, score)
                i, j = _best(score, x.id, first | need, k)
                parts.append((a.row[s][i], x.id[j], score[i, j]))
        return pa.table(dict(zip(("row", "positive_id", "positive_score"), map(np.concatenate, zip(*parts)))))

    return run


def _negatives(size: int, k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            own, all_ = _labels(left, right)
            a, x = _Rows(left, size, own), _Rows(right, size, all_)
            bounds = left["scores"].to_pylist()
            turn = rotation(size)
            for lo in range(0, len(a.id), _CHUNK):
                s = slice(lo, lo + _CHUNK)
                allowed = a.label[s, None] != x.label
                estimate, least, most = intervals(a.vec[s].astype(float), turn, x.code, x.align, x.rest)
                score = np.full(allowed.shape, _UNKNOWN)
                want = np.zeros((len(allowed), max(map(len, bounds[s]), default=0)), np.int64)
                real = np.zeros(want.shape, bool)
                for n, b in enumerate(bounds[s]):
                    want[n, : len(b)], real[n, : len(b)] = b, True
                for p in range(want.shape[1]):
                    floor, ceiling = low * want[:, p, None], high * want[:, p, None]
                    may = allowed & real[:, p, None] & (100 * most >= floor) & (100 * least <= ceiling)
                    first = _likely(np.where(100 * estimate > ceiling, -np.inf, estimate), may, 2 * k)
                    _score(a.vec[s], x.vec, first & (score == _UNKNOWN), score)
                    reached = _kth(np.where(_inside(score, may, floor, ceiling), score, _UNKNOWN), k)
                    _score(a.vec[s], x.vec, may & (score == _UNKNOWN) & (most >= reached[:, None]), score)
                    i, j = _best(score, x.id, _inside(score, may, floor, ceiling), k)
                    parts.append((a.row[s][i], np.full(len(i), p), x.id[j], score[i, j]))
        return pa.table(dict(zip(("row", "p", "negative_id", "negative_score"), map(np.concatenate, zip(*parts)))))

    return run


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90, scale: int = 256, block_rows: int = 8192, block_anchors: int = 2048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Each component x counts as floor(``scale`` * x); a score is the inner product.  The
    positives of an anchor are the best ``positives`` other rows of its label; with each
    go the best ``negatives`` rows of other labels whose score lies between ``low`` and
    ``high`` hundredths of the positive's.  Higher scores come first, then smaller ids.

    Rows with a NULL id, label or vector, or with a NULL, NaN or infinite component take
    no part.  Shorter vectors count as filled up with zeros.  Repeated rows are rows of
    their own, but a row is no partner of rows with its own id; an anchor without
    positives or without negatives in reach has no row; an empty table gives an empty
    result; other columns are ignored.  Components of 2^31 / ``scale`` and more, and
    vectors whose scores might leave 64 bits, raise an error.
    """
    v = F.col(vector_col).cast("array<double>")
    plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), v.alias("vec"))
    plain = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    size = max(1, plain.agg(F.max(F.size("vec"))).first()[0] or 1)
    coded = plain.mapInArrow(_encoder(size, scale), "id long, label string, anchor boolean, vec array<int>, code binary, align double, rest double")
    rows = materialise(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    asked = rows.where("anchor")
    n, m = rows.count(), asked.count()
    strips, groups = pieces(n, block_rows), pieces(m, block_anchors)
    fields = ["row", "id", "label", "vec", "code", "align", "rest"]
    deal = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    copy = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    right = rows.select(*fields, deal(strips).alias("strip"), copy(groups).alias("group")).groupBy("strip", "group")

    def meet(left: DataFrame, fn, schema: str) -> DataFrame:
        left = left.withColumns({"strip": copy(strips), "group": deal(groups)})
        left = left.select(*[F.col(c).alias(c) for c in left.columns])  # names of its own: both sides come from the same rows
        return left.groupBy("strip", "group").cogroup(right).applyInArrow(fn, schema)

    each = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    near = meet(asked.select(*fields), _positives(size, positives), "row long, positive_id long, positive_score long")
    near = near.withColumn("place", F.row_number().over(each)).where(F.col("place") <= positives)
    near = materialise(near.select("row", (F.col("place") - 1).cast("long"), "positive_id", "positive_score").toDF("row", "p", "positive_id", "positive_score"), "positives")
    scores = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("p", "positive_score"))).alias("s")).select("row", F.col("s.positive_score").alias("scores"))
    far = meet(asked.select(*fields).join(scores, "row"), _negatives(size, negatives, low, high), "row long, p long, negative_id long, negative_score long")
    best = Window.partitionBy("row", "p").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = asked.select("row", F.col("id").alias("anchor_id")).join(near, "row")
    return far.join(named, ["row", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
