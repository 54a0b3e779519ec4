"""Exact nearest neighbours without a cross join.

Points belong to the cell of the nearest of some pivots, whose number grows with the
square root of the rows, and whole cells are packed into blocks of bounded size; a cell
too large for one is cut.  A query is first compared with its own cell, which gives a
true bound on its k-th distance.  Then every block of queries meets every block of
points: the triangle inequality rules out cells and stretches of cells that lie beyond
the bound, which shrinks as rows are found, and what is left is screened in single
precision before distances are computed from differences.  A row is copied once per
block of the other side, never per visited cell.

How much is ruled out depends on the intrinsic dimension of the data: points spread in
three dimensions lose more than nine tenths of all comparisons; in 64 independent
dimensions all distances are alike and an exact search meets nearly every pair.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.linalg import matrix_of
from sparkloom.runtime import materialise

METRICS = ("l1", "l2", "linf")
_SPREAD = 8  # blocks of each side at least, where the rows suffice for them


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between two small blocks of rows, computed from differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for lo in range(0, len(a), step):
        d = a[lo:lo + step, None, :] - b[None, :, :]
        if metric == "l2":
            out[lo:lo + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
        elif metric == "l1":
            out[lo:lo + step] = np.abs(d).sum(axis=2)
        else:
            out[lo:lo + step] = np.abs(d).max(axis=2)
    return out


def choose_pivots(corpus: DataFrame, key: str, vector: str, count: int, metric: str) -> np.ndarray:
    """Farthest-first choice from a bounded, hash-ordered sample."""
    rows = corpus.select(vector).orderBy(F.xxhash64(key), key).limit(20 * count).collect()
    pool = np.array([r[0] for r in rows], dtype="float64")
    chosen = [0]
    near = distances(pool, pool[:1], metric)[:, 0]
    while len(chosen) < min(count, len(pool)):
        far = int(near.argmax())
        if near[far] == 0.0:
            break
        chosen.append(far)
        near = np.minimum(near, distances(pool, pool[far:far + 1], metric)[:, 0])
    return pool[chosen]


def _to_cells(key: str, vector: str, pivots: np.ndarray, metric: str):
    def run(batches):
        for b in batches:
            x = matrix_of(b.column(vector), pivots.shape[1])
            d = distances(x, pivots, metric)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column(vector), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell])],
                names=["id", "vec", "cell", "reach"])

    return run


_SCREENED = 2048  # queries screened at once


class _Screen:
    """A cheap measure that is never above the distance by more than a known error; squares for l2.

    Only pairs within the bound by this measure are computed from differences.  l2 takes
    products in single precision, linf the first dimensions that rule out most pairs, l1
    steps so short that 16 bits hold their sum, where sum |x - y| = 2 sum max(x, y) - sum x - sum y.
    """

    def __init__(self, q: np.ndarray, c: np.ndarray, metric: str):
        peak = max(np.abs(q).max(initial=0.0), np.abs(c).max(initial=0.0))
        kind = np.float32 if peak < 1e15 else np.float64
        self.metric, size = metric, q.shape[1]
        self.error = (size + 8) * 2 * float(np.finfo(kind).eps)
        levels = 65_535 // max(1, size)
        self.step = 0.0
        if metric == "l1" and levels >= 256 and np.isfinite(q).all() and np.isfinite(c).all():
            # values beyond the ends are drawn in, which makes no distance larger
            low, high = np.quantile(c[:: max(1, len(c) // 2000)], [0.001, 0.999])
            self.step = (high - low) / levels
        if self.step > 0:
            steps = lambda x: np.rint((np.clip(x, low, high) - low) / self.step).clip(0, levels).astype(np.uint16)
            self.q, self.c = steps(q), steps(c)
            self.qn, self.cn = (x.sum(axis=1, dtype=np.int64) for x in (self.q, self.c))
            self.error = size + 2  # half a step for each end in each dimension, and the rounding of the bound
        else:
            self.q, self.c = q.astype(kind), c.astype(kind)
            norm = {"l2": lambda x: np.einsum("ij,ij->i", x, x), "l1": lambda x: np.abs(x).sum(axis=1), "linf": lambda x: np.abs(x).max(axis=1)}[metric]
            self.qn, self.cn = norm(q), norm(c)

    def near(self, rows: np.ndarray, a: int, b: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of all pairs of ``rows[i]`` and row ``a + j`` that may lie within the bound."""
        q, c = self.q[rows], self.c[a:b]
        if self.metric == "l2":
            d = q @ c.T
            d *= -2
            d += self.cn[a:b].astype(d.dtype)
            limit = bound * bound * (1 + 1e-9) - self.qn[rows] + self.error * (self.qn[rows] + self.cn[a:b].max())
            return np.nonzero(d <= limit.astype(d.dtype)[:, None])
        q = np.ascontiguousarray(q.T)
        one = np.empty((32, len(rows)), q.dtype)
        found = []
        for lo in range(0, len(c), 32):  # so few rows that both tiles stay in the cache
            part = one[:len(c) - lo]
            sums = np.zeros_like(part)
            if self.step > 0:
                limit = (bound / self.step + self.error + self.qn[rows]) / 2
                for x, y in zip(q, c[lo:lo + 32].T):
                    np.maximum(x[None, :], y[:, None], out=part)
                    np.add(sums, part, out=sums)
                top = np.minimum(limit[None, :] + self.cn[a + lo:a + lo + len(part), None] / 2, 65_535).astype(np.uint16)
                j, i = np.nonzero(sums <= top)
            else:
                limit = (bound * (1 + 1e-9) + self.error * (self.qn[rows] + self.cn[a:b].max())).astype(q.dtype)
                add = np.add if self.metric == "l1" else np.maximum
                for n, (x, y) in enumerate(zip(q, c[lo:lo + 32].T), 1):
                    np.subtract(x[None, :], y[:, None], out=part)
                    np.abs(part, out=part)
                    add(sums, part, out=sums)
                    if add is np.maximum and n % 8 == 0 and 32 * np.count_nonzero(sums <= limit) < sums.size:
                        break
                j, i = np.nonzero(sums <= limit)
            found.append((i, j + lo))
        return tuple(map(np.concatenate, zip(*found)))


class _Found:
    """The nearest rows found so far of every query of a block, and the bound they give."""

    def __init__(self, bound: np.ndarray, k: int):
        self.d, self.id = np.full((len(bound), k), np.inf), np.zeros((len(bound), k), np.int64)
        self.k, self.bound = k, bound.copy()

    def merge(self, i: np.ndarray, cid: np.ndarray, d: np.ndarray) -> None:
        if not len(i):
            return
        seen = np.unique(i)
        held = np.isfinite(self.d[seen])
        i = np.concatenate([np.broadcast_to(seen[:, None], held.shape)[held], i])
        cid, d = np.concatenate([self.id[seen][held], cid]), np.concatenate([self.d[seen][held], d])
        order = np.lexsort((cid, d, i))
        i, cid, d = i[order], cid[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        first = place < self.k
        self.d[i[first], place[first]], self.id[i[first], place[first]] = d[first], cid[first]
        self.bound[seen] = np.minimum(self.bound[seen], self.d[seen, -1])


def _exact(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows side by side, computed from differences."""
    d = q - c
    if metric == "l2":
        return np.sqrt(np.einsum("ij,ij->i", d, d))
    return np.abs(d).sum(axis=1) if metric == "l1" else np.abs(d).max(axis=1)


def _search(left: pa.Table, right: pa.Table, pivots: np.ndarray, metric: str, k: int, own: bool) -> tuple[_Found, int]:
    """The k nearest rows of ``right`` within the bound of each query of ``left``; with ``own`` in its own cell only."""
    size = pivots.shape[1]
    q, qcell, qreach = matrix_of(left["vec"].combine_chunks(), size), left["cell"].to_numpy(), left["reach"].to_numpy()
    right = right.sort_by([("cell", "ascending"), ("reach", "ascending")])
    c, cid, ccell, reach = matrix_of(right["vec"].combine_chunks(), size), right["id"].to_numpy(), right["cell"].to_numpy(), right["reach"].to_numpy()
    found, screen, compared = _Found(left["bound"].to_numpy(), k), _Screen(q, c, metric), 0
    for cell in np.unique(ccell):
        lo, hi = np.searchsorted(ccell, [cell, cell + 1])
        rows = np.flatnonzero(qcell == cell) if own else np.arange(len(q))
        d = distances(q[rows], pivots[cell:cell + 1], metric)[:, 0]
        slack = found.bound[rows] * (1 + 1e-9) + 1e-9
        # a point of a cell is nearer to its pivot than to the query's pivot, hence the second bound
        visit = (d - reach[hi - 1] <= slack) & (reach[lo] - d <= slack) & ((d - qreach[rows]) / 2 <= slack)
        rows, d = rows[visit], d[visit]
        order = np.argsort(d, kind="stable")
        rows, d = rows[order], d[order]
        for at in range(0, len(rows), _SCREENED):  # queries of like distance to the pivot share a stretch of the cell
            some, near = rows[at:at + _SCREENED], d[at:at + _SCREENED]
            slack = found.bound[some] * (1 + 1e-9) + 1e-9
            a, end = lo + int(np.searchsorted(reach[lo:hi], (near - slack).min(), "left")), lo + int(np.searchsorted(reach[lo:hi], (near + slack).max(), "right"))
            while a < end:
                b = min(end, a + (1024 if np.isfinite(found.bound[some]).all() else max(k, 64)))
                i, j = screen.near(some, a, b, found.bound[some])
                compared += len(some) * (b - a)
                for p in range(0, len(i), 1 << 16):
                    x, y = some[i[p:p + (1 << 16)]], a + j[p:p + (1 << 16)]
                    exact = _exact(q[x], c[y], metric)
                    keep = exact <= found.bound[x] * (1 + 1e-9) + 1e-9
                    found.merge(x[keep], cid[y[keep]], exact[keep])
                a = b
    return found, compared


def _bounds(pivots: np.ndarray, metric: str, k: int):
    """Queries with the distance of the k-th row of their own cell as a bound."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bound = left["bound"].to_numpy()
        if len(left) and len(right):
            bound = _search(left, right, pivots, metric, k, True)[0].bound
        return pa.table([*[left[c] for c in ("id", "vec", "cell", "reach")], pa.array(bound, pa.float64())], names=["id", "vec", "cell", "reach", "bound"])

    return run


_FOUND = "qid bigint, cid bigint, distance double, compared bigint"


def _best(pivots: np.ndarray, metric: str, k: int, counted: bool):
    """The k nearest of a block of rows for a block of queries; with ``counted`` one row that counts the pairs met."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        if len(left) and len(right):
            found, compared = _search(left, right, pivots, metric, k, False)
            if counted:
                rows = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.array([compared]))
            else:
                i, j = np.nonzero(np.isfinite(found.d))
                rows = (left["id"].to_numpy()[i], found.id[i, j], found.d[i, j], np.zeros(len(i), np.int64))
        return pa.table([pa.array(x) for x in rows], names=["qid", "cid", "distance", "compared"])

    return run


def _pack(sizes: dict[int, int], least: int, block: int) -> dict[int, list[int]]:
    """cell -> bins of at most about ``block`` rows; a cell of more than a bin's share is cut into pieces of its own."""
    share = max(1, min(block, -(-sum(sizes.values()) // least)))
    pieces = sorted(((-(-n // -(-n // share)), cell) for cell, n in sizes.items() for _ in range(-(-n // share))), reverse=True)
    loads = [(0, b) for b in range(-(-sum(n for n, _ in pieces) // share))]
    heapq.heapify(loads)
    bins: dict[int, list[int]] = {}
    for n, cell in pieces:
        load, b = heapq.heappop(loads)
        bins.setdefault(cell, []).append(b)
        heapq.heappush(loads, (load + n, b))
    return {cell: sorted(set(b)) for cell, b in bins.items()}


def _nearest(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("qid").orderBy("distance", "cid")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def knn_join(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, metric: str = "l2",
             pivots: int | None = None, block: int = 40_000, include_self: bool = True, counted: bool = False) -> DataFrame:
    """The k nearest corpus rows of each query row: ``qid, cid, distance, rank``.

    Keys are bigint.  Ties go to the smaller corpus key.  The result is exact.
    ``counted`` returns the number of pairs met instead.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    want = k if include_self else k + 1
    cols = [F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias(vector)]
    same = queries is corpus
    queries, corpus = queries.select(*cols), corpus.select(*cols)
    centre = choose_pivots(corpus, key, vector, pivots or max(16, math.isqrt(corpus.count())), metric)
    kind = "id bigint, vec array<double>, cell int, reach double"
    cells = materialise(corpus.mapInArrow(_to_cells(key, vector, centre, metric), kind), "cells")
    asked = cells if same else materialise(queries.mapInArrow(_to_cells(key, vector, centre, metric), kind), "asked")
    # of copies of a vector no more than ``want`` can come out, those of the smallest keys
    nth = F.row_number().over(Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("id"))
    cells = materialise(cells.withColumn("_nth", nth).where(F.col("_nth") <= want).drop("_nth"), "distinct")

    sizes = {r.cell: r.n for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pivot
    rows, asks = sum(sizes.values()), asked.count()
    bins = _pack(sizes, min(_SPREAD, -(-rows // 1000)), block)
    count = 1 + max((b for x in bins.values() for b in x), default=0)
    parts = max(1, -(-asks // block), min(_SPREAD, asks // 1000))
    spark = cells.sparkSession
    where = F.broadcast(spark.createDataFrame([(c, b) for c, b in bins.items()], "cell int, bins array<int>"))
    pick = lambda salt: F.element_at("bins", F.pmod(F.xxhash64("id", F.lit(salt)), F.size("bins")).cast("int") + 1).alias("bin")
    dealt = materialise(cells.join(where, "cell").select("id", "vec", "cell", "reach", pick(0)), "dealt")
    tasks = min(2000, 4 * count * parts)

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        by = ["bin", "part"]
        left, right = (d.repartition(tasks, *by) for d in (left, right))  # a pair of blocks is little data and much work
        return left.groupBy(*by).cogroup(right.groupBy(*by))

    # Own cell first, or one piece of it.  Its rows bound the k-th distance.
    home = asked.join(where, "cell", "left").select("id", "vec", "cell", "reach", F.lit(float("inf")).alias("bound"), F.coalesce(pick(1), F.lit(0)).alias("bin"))
    loads = home.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    loads = F.broadcast(materialise(loads, "loads"))  # one row per bin
    start = home.join(loads, "bin").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).drop("n")
    near = dealt.join(loads, "bin").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    bounded = materialise(meet(start, near).applyInArrow(_bounds(centre, metric, want), kind + ", bound double"), "bounds")

    left = bounded.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    right = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = meet(left, right).applyInArrow(_best(centre, metric, want, counted), _FOUND)
    if counted:
        return found.agg(F.sum("compared").alias("compared"))
    found = found.drop("compared")
    if not include_self:
        found = found.filter("qid <> cid")
    return _nearest(found, k)


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Vectors divided by their norm; zero vectors are left out."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    scaled = df.withColumn("_norm", norm).filter(F.col("_norm") > 0)
    return scaled.withColumn(vector, F.transform(v, lambda x: x / F.col("_norm"))).drop("_norm")


def cosine_neighbours(df: DataFrame, key: str, vector: str, k: int, **options) -> DataFrame:
    """k most similar other rows by cosine: on unit vectors the order of distances."""
    unit = unit_vectors(df, vector)
    near = knn_join(unit, unit, key, vector, k, "l2", include_self=False, **options)
    return near.select("qid", "cid", "rank", (1 - F.col("distance") * F.col("distance") / 2).alias("cosine"))


def closest_pairs(df: DataFrame, key: str, vector: str, n: int, **options) -> DataFrame:
    """The n most similar pairs.  Each of them is among the n neighbours of both ends."""
    near = cosine_neighbours(df, key, vector, n, **options).filter("qid < cid")
    return near.orderBy(F.desc("cosine"), "qid", "cid").limit(n).select(F.col("qid").alias("a"), F.col("cid").alias("b"), "cosine")


def knn_votes(neighbours: DataFrame, labels: DataFrame, key: str, label: str, sizes: list[int]) -> DataFrame:
    """Majority label among the first k neighbours for several k at once; ties go to the smaller label."""
    tagged = neighbours.join(labels.select(F.col(key).alias("cid"), label), "cid")
    each = tagged.withColumn("k", F.explode(F.lit([int(s) for s in sizes]))).filter(F.col("rank") <= F.col("k"))
    votes = each.groupBy("qid", "k", label).agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy("qid", "k").agg(F.min(F.struct((-F.col("_n")).alias("v"), F.col(label))).alias("m"))
    return best.select("qid", "k", F.col(f"m.{label}").alias("predicted"))
