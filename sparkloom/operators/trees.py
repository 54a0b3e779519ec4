"""Extremely randomised trees, grown level by level.

At every open node some features are drawn, and for each a cut point between the least
and the greatest value it has there; the best of these cuts is taken.  All draws depend
on the seed, the tree and the node alone.  All trees grow a level together in two passes
over the rows: one for the extremes, one for class counts on both sides of each cut.
Partitions add up their own rows before anything is shuffled; the driver sees extremes
and class counts of open nodes and holds the forest: at most ``trees`` times two to the
power of ``depth`` nodes, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.linalg import matrix_of
from sparkloom.runtime import few_values

ROOT = 1  # nodes of a tree are numbered as in a heap: the children of n are 2n and 2n + 1


def draws(seed: int, tree: int, node: int, size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a node and, for each, where its cut lies between the extremes."""
    rng = np.random.default_rng([seed, tree, node])
    return rng.permutation(size)[:count], rng.random(count)


def impurity(counts: np.ndarray) -> np.ndarray:
    """Rows times Gini impurity; class counts are on the last axis."""
    n = counts.sum(axis=-1)
    return n - np.divide((counts * counts).sum(axis=-1), n, out=np.zeros(n.shape), where=n > 0)


def best_cut(counts: np.ndarray, least: int) -> int:
    """The cut (first axis) with the smallest impurity of both sides (second axis); -1 if none leaves enough on both."""
    cost = impurity(counts.astype(float)).sum(axis=1)
    cost[(counts.sum(axis=2) < least).any(axis=1)] = np.inf
    at = int(cost.argmin()) if len(cost) else -1
    return at if at >= 0 and np.isfinite(cost[at]) else -1


@dataclass
class Forest:
    """Cuts and class counts of all nodes; ``transform`` adds a prediction."""

    labels: list[float]
    cuts: dict[tuple[int, int], tuple[int, float]] = field(default_factory=dict)  # (tree, node) -> feature, point
    counts: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)  # of every node
    trees: int = 0

    def places(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node each row has come to."""
        node = np.full(len(x), ROOT)
        groups = [(ROOT, np.arange(len(x)))]
        while groups:
            n, rows = groups.pop()
            cut = self.cuts.get((tree, n))
            if cut is None or not len(rows):
                node[rows] = n
                continue
            left = x[rows, cut[0]] <= cut[1]
            groups += [(2 * n, rows[left]), (2 * n + 1, rows[~left])]
        return node

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the class shares in the leaf of each row."""
        out = np.zeros((len(x), len(self.labels)))
        for t in range(self.trees):
            nodes, at = np.unique(self.places(x, t), return_inverse=True)
            c = np.array([self.counts[t, int(n)] for n in nodes], float)
            out += (c / c.sum(axis=1, keepdims=True))[at]
        return out / self.trees

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction``: the label with the greatest mean share, ties to the smaller label."""
        labels, shares = np.array(self.labels), self.shares

        @F.pandas_udf("double")
        def predict(v: pd.Series) -> pd.Series:
            return pd.Series(labels[shares(np.stack(v.to_numpy())).argmax(axis=1)], dtype="float64")

        return df.select("*", predict(vector_to_array("features")).alias("prediction"))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The forest as a table."""
        rows = [(t, n, *(self.cuts.get((t, n)) or (None, None)), c.tolist()) for (t, n), c in sorted(self.counts.items())]
        return spark.createDataFrame([(t, n, None if f is None else int(f), None if p is None else float(p), c) for t, n, f, p, c in rows],
                                     "tree int, node bigint, feature int, point double, counts array<bigint>")


@dataclass(frozen=True)
class ExtraTrees:
    """An estimator for rows with ``features`` (a vector) and ``label``; rows with a NULL in either are left out.

    ``features`` cuts are drawn at a node, the root of the number of features by default.
    A node stays whole at the given depth, with one class, with fewer than twice ``least``
    rows, or if no drawn cut leaves ``least`` rows on both sides.
    """

    depth: int
    trees: int = 100
    features: int | None = None
    least: int = 1
    seed: int = 7

    def fit(self, df: DataFrame) -> Forest:
        rows = df.where("features is not null and label is not null").select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).persist()
        forest = Forest(few_values(rows, "y"), trees=self.trees)
        first = rows.first()
        if first is None:
            rows.unpersist()
            raise ValueError("no row to learn from")
        size = len(first.x)
        count = self.features or math.ceil(math.sqrt(size))
        whole = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
        for t in range(self.trees):
            forest.counts[t, ROOT] = np.array([whole[y] for y in forest.labels])
        for level in range(self.depth):
            open_ = [k for k, c in forest.counts.items() if 1 << level <= k[1] < 2 << level and np.count_nonzero(c) > 1 and c.sum() >= 2 * self.least]
            if not open_ or not self._grow(rows, forest, open_, size, count):
                break
        rows.unpersist()
        return forest

    def _grow(self, rows: DataFrame, forest: Forest, open_: list[tuple[int, int]], size: int, count: int) -> bool:
        """One level of all trees."""
        drawn = {k: draws(self.seed, *k, size, count) for k in open_}
        places, labels = forest.places, np.array(forest.labels)
        trees = sorted({t for t, _ in open_})

        def each(x):
            """(tree, node, rows) of every open node that a batch reaches."""
            for t in trees:
                at = places(x, t)
                order = np.argsort(at, kind="stable")
                nodes, start = np.unique(at[order], return_index=True)
                for n, own in zip(nodes.tolist(), np.split(order, start[1:])):
                    if (t, n) in drawn:
                        yield t, n, own

        def extremes(batches):
            found = {}
            for b in batches:
                x = matrix_of(b.column("x"), size)
                for t, n, own in each(x):
                    v = x[np.ix_(own, drawn[t, n][0])]
                    low, high = v.min(axis=0), v.max(axis=0)
                    old = found.get((t, n))
                    found[t, n] = (low, high) if old is None else (np.minimum(old[0], low), np.maximum(old[1], high))
            yield pa.RecordBatch.from_pydict({"tree": pa.array([k[0] for k in found], pa.int32()), "node": pa.array([k[1] for k in found], pa.int64()),
                                              "low": pa.array([v[0] for v in found.values()], pa.list_(pa.float64())), "high": pa.array([v[1] for v in found.values()], pa.list_(pa.float64()))})

        edge = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(count)]).alias(c)
        span = rows.select("x").mapInArrow(extremes, "tree int, node bigint, low array<double>, high array<double>").groupBy("tree", "node").agg(edge(F.min, "low"), edge(F.max, "high"))
        points = {(r.tree, r.node): np.array(r.low) + drawn[r.tree, r.node][1] * (np.array(r.high) - np.array(r.low)) for r in span.collect()}  # a node each

        def sides(batches):
            found = {k: np.zeros((count, 2, len(labels)), np.int64) for k in points}
            for b in batches:
                x, y = matrix_of(b.column("x"), size), np.searchsorted(labels, b.column("y").to_numpy())
                for t, n, own in each(x):
                    right = x[np.ix_(own, drawn[t, n][0])] > points[t, n]
                    for c in range(len(labels)):
                        here = right[y[own] == c]
                        found[t, n][:, 1, c] += here.sum(axis=0)
                        found[t, n][:, 0, c] += (~here).sum(axis=0)
            rows_ = [(*k, i, n) for k, v in found.items() if v.any() for i, n in enumerate(v)]
            t, n, i, c = zip(*rows_) if rows_ else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"tree": pa.array(t, pa.int32()), "node": pa.array(n, pa.int64()), "cut": pa.array(i, pa.int32()),
                                              "n": pa.array([x.ravel() for x in c], pa.list_(pa.int64()))})

        whole = F.array(*[F.sum(F.col("n")[i]) for i in range(2 * len(labels))]).alias("n")
        sums: dict[tuple[int, int], np.ndarray] = {}
        for r in rows.mapInArrow(sides, "tree int, node bigint, cut int, n array<bigint>").groupBy("tree", "node", "cut").agg(whole).collect():  # a cut of a node each
            sums.setdefault((r.tree, r.node), np.zeros((count, 2, len(labels)), np.int64))[r.cut] = np.array(r.n).reshape(2, -1)
        grown = False
        for (tree, node), n in sums.items():
            at = best_cut(n, self.least)
            if at < 0:
                continue
            grown = True
            forest.cuts[tree, node] = int(drawn[tree, node][0][at]), float(points[tree, node][at])
            forest.counts[tree, 2 * node], forest.counts[tree, 2 * node + 1] = n[at]
        return grown
