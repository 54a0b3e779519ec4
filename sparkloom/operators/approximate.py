"""Approximate nearest neighbours through hash tables of random planes, probed by margin.

Each table cuts the rows by random planes through their mean; the signs of a row are
its bucket.  A bucket that is still too large is cut again by new planes through its
own mean, so a dense group falls apart at its own scale and no bucket needs a cap.
Copies of a vector are one spot from the start.

A query asks more buckets than its own: all whose planes it can cross at a cost, the
sum of its squared distances to those planes in units of the bucket's spread, within
a reach.  The number of tables and the reach come from a bounded sample, as the cost at
which the wanted share of true neighbours is met.  Buckets and probes meet by an equality join, and
candidates are ranked by their true distance.

Nothing on the driver grows with the rows: it sees one mean, the sample and counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.linalg import matrix_of
from sparkloom.operators.neighbours import distances, unit_vectors
from sparkloom.runtime import materialise

_BITS = 12  # planes of one cut at most
_DEPTH = 50  # cuts after which rows count as inseparable and are compared in blocks
_SENT = 8192  # rows that leave a task at once
_SAMPLE = 8192  # rows from which the reach is measured


def _planes(seed: int, table: int, level: int, size: int) -> np.ndarray:
    """Random unit directions, the same in every task; a cut uses as many as it needs."""
    p = np.random.default_rng([seed, table, level]).standard_normal((size, _BITS))
    return p / np.linalg.norm(p, axis=0)


def _margins(b: pa.RecordBatch, size: int, seed: int, level: int):
    """Per table: places, and distances to the planes in units of the spread."""
    x, centre = matrix_of(b.column("vec"), size), matrix_of(b.column("centre"), size)
    scale, tables = b.column("spread").to_numpy(), b.column("tab").to_numpy()
    for t in np.unique(tables):
        at = np.flatnonzero(tables == t)
        yield at, (x[at] - centre[at]) @ _planes(seed, int(t), level, size) / scale[at, None]


def _assign(size: int, seed: int, level: int):
    """Rows of a node with the bucket they fall into."""
    def run(batches):
        for b in batches:
            key = np.zeros(len(b), np.int64)
            bits = b.column("bits").to_numpy()
            for at, m in _margins(b, size, seed, level):
                key[at] = ((m > 0) & (np.arange(_BITS) < bits[at, None])) @ (1 << np.arange(_BITS))
            node = [f"{n}.{k}" for n, k in zip(b.column("node").to_pylist(), key.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(node), b.column("tab"), b.column("id"), b.column("vec")], names=["node", "tab", "id", "vec"])

    return run


def _probe(size: int, seed: int, level: int, reach: float):
    """Every bucket of a node that a query reaches."""
    def run(batches):
        for b in batches:
            bits, names = b.column("bits").to_numpy(), b.column("node").to_pylist()
            for at, m in _margins(b, size, seed, level):
                for n in np.unique(bits[at]):
                    own = np.flatnonzero(bits[at] == n)
                    flips = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(float)
                    step = max(1, 2_000_000 >> int(n))
                    for lo in range(0, len(own), step):
                        rows = own[lo:lo + step]
                        home = (m[rows, :n] > 0) @ (1 << np.arange(n))
                        q, flip = np.nonzero((m[rows, :n] ** 2) @ flips.T <= reach)
                        for p in range(0, len(q), _SENT):  # a vector leaves once per bucket
                            where, key = at[rows[q[p:p + _SENT]]], home[q[p:p + _SENT]] ^ flip[p:p + _SENT]
                            node = [f"{names[w]}.{k}" for w, k in zip(where.tolist(), key.tolist())]
                            take = pa.array(where)
                            yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), b.column("tab").take(take), b.column("id").take(take), b.column("vec").take(take)], names=["node", "tab", "id", "vec"])

    return run


def _reach(sample: np.ndarray, rows: int, wanted: float, k: int, tables: list[int], seed: int, level: int, bits: int) -> tuple[int, float]:
    """Number of tables, and the cost within which one of them has the wanted share of the k nearest rows.

    As many of the sample stand for the k nearest of all rows as its share of the rows
    says, one at least.  Of the numbers of tables the one is taken that lets a query
    meet the fewest rows of the sample.
    """
    if len(sample) < 3:
        return tables[0], math.inf
    asked = sample[:: max(1, len(sample) // 256)]
    d = np.concatenate([distances(asked[i:i + 16], sample, "l2") for i in range(0, len(asked), 16)])
    d[d == 0] = np.inf  # itself
    near = np.argsort(d, axis=1, kind="stable")[:, : max(1, round(k * min(1.0, len(sample) / rows)))]
    spread = math.sqrt(sample.var(axis=0).mean()) or 1.0
    cost = np.empty((max(tables), len(asked), len(sample)), np.float32)
    for t in range(max(tables)):
        planes = _planes(seed, t, level, sample.shape[1])[:, :bits]
        side = ((sample - sample.mean(axis=0)) @ planes > 0).astype(float)
        mine = (asked - sample.mean(axis=0)) @ planes / spread
        square, home = mine**2, (mine > 0).astype(float)
        # sum of the squares where the signs differ
        cost[t] = (square * home).sum(axis=1)[:, None] + (square * (1 - 2 * home)) @ side.T
    found = {n: float(np.quantile(np.take_along_axis(cost[:n].min(axis=0), near, axis=1), wanted)) * (1 + 1e-6) + 1e-6 for n in tables}
    best = min(tables, key=lambda n: (cost[:n] <= found[n]).sum())
    return best, found[best]


def _closest(size: int, k: int):
    """The k nearest rows of each query among all buckets of one shelf that it asks for."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        compared = 0
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            names = pa.chunked_array([*left["node"].chunks, *right["node"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            asked, held = names[:len(left)], names[len(left):]
            by_left, by_right = np.argsort(asked, kind="stable"), np.argsort(held, kind="stable")
            q, c = matrix_of(left["vec"].chunk(0), size), matrix_of(right["vec"].chunk(0), size)
            qid, cid = left["id"].to_numpy(), right["id"].to_numpy()
            for n in np.unique(asked):
                ql = by_left[slice(*np.searchsorted(asked[by_left], [n, n + 1]))]
                cl = by_right[slice(*np.searchsorted(held[by_right], [n, n + 1]))]
                for lo in range(0, len(ql) if len(cl) else 0, 256):
                    rows = ql[lo:lo + 256]
                    d = distances(q[rows], c[cl], "l2")
                    best = np.lexsort((np.broadcast_to(cid[cl], d.shape), d), axis=1)[:, :k]
                    compared += d.size
                    found.append((np.repeat(qid[rows], best.shape[1]), cid[cl][best].ravel(), np.take_along_axis(d, best, axis=1).ravel()))
        q, c, d = map(np.concatenate, zip(*found))
        order = np.lexsort((c, d, q))
        q, c, d = q[order], c[order], d[order]
        new = np.ones(len(q), bool)  # tables meet the same row more than once, at the same distance
        new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        q, c, d = q[new], c[new], d[new]
        first = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
        counted = np.zeros(np.count_nonzero(first), np.int64)
        counted[:1] = compared
        return pa.table({"qid": q[first], "sid": c[first], "distance": d[first], "compared": counted})

    return run


def approximate_join(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, recall: float = 0.95, tables: list[int] = [1, 2, 4, 8], bucket: int = 256,
                     include_self: bool = True, seed: int = 7, counted: bool = False) -> DataFrame:
    """About the k nearest corpus rows of each query row by Euclidean distance: ``qid, cid, distance, rank``.

    Distances are exact and ranks are those among the rows found; ``recall`` is the share
    of true neighbours for which probes are made, with one of the numbers of ``tables``.  Keys are bigint, ties go to the smaller
    key, rows with a NULL key or vector take no part.  Vectors have one length.  Results do
    not change between runs.  ``counted`` returns the number of distances computed instead.
    """
    want = k if include_self else k + 1
    clean = lambda df: df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    # copies are one spot, named by its smallest key; of its keys no more than ``want`` can ever come out
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    first = clean(corpus).withColumn("n", nth).where(F.col("n") <= want)
    spots = materialise(first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vec", "ids"), "spots")
    whole = spots.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("size")).first()
    asked = clean(queries)
    if not whole.n:
        empty = asked.limit(0).select(F.col("id").alias("qid"), F.col("id").alias("cid"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
        return empty.agg(F.count("qid").alias("compared")) if counted else empty
    size, limit = whole["size"], 4 * bucket
    levels = max(1, math.ceil(math.log2(max(2, whole.n / bucket)) / _BITS))
    per_cut = recall ** (1 / (levels + 1))  # one cut more than even rows need

    def sampled(rows: DataFrame) -> np.ndarray:
        return np.array([r[0] for r in rows.select("vec").orderBy(F.xxhash64("id"), "id").limit(_SAMPLE).collect()], float)

    bits = F.least(F.lit(_BITS), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / bucket)))).cast("int").alias("bits")
    planes = lambda n: min(_BITS, max(1, math.ceil(math.log2(n / bucket))))
    tables, reach = _reach(sampled(spots), whole.n, per_cut, k, tables, seed, 0, planes(whole.n))

    def measured(rows: DataFrame, by: list[str]) -> DataFrame:
        """Mean and spread of the rows of each node."""
        stats = rows.groupBy(*by).agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("vec")).alias("s"))
        v = vector_to_array("s.variance")
        spread = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / size)
        return stats.select(*by, vector_to_array("s.mean").alias("centre"), spread.alias("spread"), F.col("s.count").alias("n")).select(*by, "centre", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0).alias("spread"), bits)

    each = F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))
    roots = measured(spots, []).withColumn("tab", each).withColumn("node", F.col("tab").cast("string")).drop("tab")
    roots = materialise(roots, "roots")
    kind = "node string, tab int, id bigint, vec array<double>"
    inner, open_, ask = roots, spots.select("id", "vec").withColumn("tab", each), asked.withColumn("tab", each)
    open_, ask = (d.withColumn("node", F.col("tab").cast("string")).select("node", "tab", "id", "vec") for d in (open_, ask))
    leaves, visits, level = [], [], 0
    while True:
        made = materialise(open_.join(inner, "node").mapInArrow(_assign(size, seed, level), kind), "buckets")
        sizes = materialise(made.groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("deep", (F.col("n") > limit) & F.lit(level < _DEPTH)), "sizes")
        probes = ask.join(inner, "node").mapInArrow(_probe(size, seed, level, reach), kind).join(sizes, "node")
        probes = materialise(probes, "probes")
        visits.append(probes.where("not deep").drop("deep"))
        leaves.append(made.join(sizes.where("not deep").drop("deep"), "node"))
        level += 1
        large = sizes.where("deep").orderBy(F.desc("n"), "node").first()
        if large is None:
            break
        # neighbours further in lie closer: the largest node shows how far to reach there
        reach = _reach(sampled(made.where(F.col("node") == large.node)), large.n, per_cut, k, [1], seed, level, planes(large.n))[1]
        open_ = made.join(sizes.where("deep").select("node"), "node")
        ask = probes.where("deep").drop("deep", "n")
        inner = materialise(measured(open_, ["node"]), "inner")
    visits, leaves = (d[0] if len(d) == 1 else _union(d) for d in (visits, leaves))

    # a shelf holds many buckets, so that a query brings back few rows; blocks bound both sides of
    # a task: a shelf that many queries ask for, and one with a bucket that cannot be cut
    shelves = max(1, math.ceil(whole.n * tables / (16 * limit)))
    shelf = F.pmod(F.xxhash64("node"), F.lit(shelves)).alias("shelf")
    loads = visits.groupBy(shelf).agg(F.ceil(F.count(F.lit(1)) / (64 * limit)).cast("int").alias("blocks"), F.ceil(F.max("n") / (16 * limit)).cast("int").alias("cuts"))
    loads = materialise(loads, "loads")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    copy = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.withColumn("shelf", shelf).join(loads, "shelf").withColumn("part", deal("blocks")).withColumn("cut", copy("cuts")).select("shelf", "part", "cut", "node", "id", "vec")
    right = leaves.withColumn("shelf", shelf).join(loads, "shelf").withColumn("part", copy("blocks")).withColumn("cut", deal("cuts")).select("shelf", "part", "cut", "node", "id", "vec")
    left, right = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (left, right))
    by = ["shelf", "part", "cut"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_closest(size, want), "qid bigint, sid bigint, distance double, compared bigint")
    if counted:
        return met.agg(F.sum("compared").alias("compared"))
    best = met.groupBy("qid", "sid").agg(F.min("distance").alias("distance"))
    place = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy("distance", c))
    best = best.withColumn("rank", place("sid")).where(F.col("rank") <= want)
    found = best.join(spots.select(F.col("id").alias("sid"), "ids"), "sid").select("qid", F.explode("ids").alias("cid"), "distance")
    if not include_self:
        found = found.where("qid <> cid")
    return found.withColumn("rank", place("cid")).where(F.col("rank") <= k).select("qid", "cid", "distance", "rank")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def approximate_cosine(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, **options) -> DataFrame:
    """About the k most similar other rows by cosine: ``qid, cid, rank, cosine``; zero vectors take no part."""
    near = approximate_join(unit_vectors(queries, vector), unit_vectors(corpus, vector), key, vector, k, include_self=False, **options)
    return near.select("qid", "cid", "rank", (1 - F.col("distance") * F.col("distance") / 2).alias("cosine"))
