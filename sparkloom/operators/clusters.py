"""Clustering: k-means from pyspark.ml and by batches, mixtures by sums per partition, grid DBSCAN, spectral, and the choice by name."""

from __future__ import annotations

import itertools
import math
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import linalg, reshape
from sparkloom.operators.eigen import leading_vectors
from sparkloom.operators.linalg import matrix_of
from sparkloom.operators.neighbours import knn_join
from sparkloom.runtime import cut_lineage, materialise, scratch_path


def _scatter(points: DataFrame) -> tuple[int, int, np.ndarray]:
    """Rows, dimensions and the sum of squared deviations of a ``features`` column."""
    v = points.select(vector_to_array("features").alias("v"))
    size = len(v.first()["v"])
    sums = np.zeros((size + 1, size))
    i, j, s, counts = linalg.columns_of(linalg.outer_sums(v, "v", size).select("i", "j", "s", "n"))
    sums[i, j], n = s, int(counts.max())
    sums[:size] = np.triu(sums[:size]) + np.triu(sums[:size], 1).T
    mean = sums[-1] / n
    return n, size, sums[:size] - n * np.outer(mean, mean)


def inertia_curve(df: DataFrame, sizes: list[int], seed: int = 7) -> DataFrame:
    """k-means cost for each number of clusters."""
    df = df.select("features").persist()
    rows = []
    for k in sizes:
        if k == 1:
            rows.append((1, float(np.trace(_scatter(df)[2]))))
        else:
            rows.append((k, float(KMeans(k=k, seed=seed, maxIter=100).fit(df).summary.trainingCost)))
    df.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, cost double")


COVARIANCES = ("spherical", "diagonal", "full")


def _log_densities(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for k, (mean, cov) in enumerate(zip(means, covs)):
        if cov.ndim == 2:
            low = np.linalg.cholesky(cov)
            z = np.linalg.solve(low, (x - mean).T)
            out[:, k] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum()
        else:
            out[:, k] = -0.5 * ((x - mean) ** 2 / cov).sum(axis=1) - 0.5 * np.log(cov).sum()
    return out - 0.5 * x.shape[1] * math.log(2 * math.pi)


def _expectation(size: int, weights: np.ndarray, means: np.ndarray, covs: np.ndarray):
    """Per partition and component: weight, sums, sums of squares or products, and (component -1) the log likelihood."""
    def run(batches):
        n, s, q, total, rows = np.zeros(len(means)), np.zeros_like(means), np.zeros_like(covs), 0.0, 0
        for b in batches:
            x = matrix_of(b.column(0), size)
            logs = np.log(weights) + _log_densities(x, means, covs)
            top = logs.max(axis=1, keepdims=True)
            all_ = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
            r = np.exp(logs - all_[:, None])
            total += all_.sum()
            rows += len(x)
            n += r.sum(axis=0)
            s += r.T @ x
            for k in range(len(means)):
                q[k] += (x * r[:, k:k + 1]).T @ x if covs.ndim == 3 else r[:, k] @ (x * x)
        yield pa.RecordBatch.from_pydict({"k": pa.array([-1, *range(len(means))], pa.int32()),
                                          "v": pa.array([[rows, total], *[np.r_[n[k], s[k], q[k].ravel()].tolist() for k in range(len(means))]], pa.list_(pa.float64()))})

    return run


def _add_lists(t: pa.Table) -> pa.Table:
    v = t["v"].combine_chunks()
    total = np.asarray(v.flatten()).reshape(len(v), -1).sum(axis=0)
    return pa.table({"k": t["k"][:1], "v": pa.array([total], pa.list_(pa.float64()))})


def fit_mixture(points: DataFrame, size: int, means: np.ndarray, kind: str, rounds: int = 100, tolerance: float = 1e-5, ridge: float = 1e-6):
    """Expectation-maximisation from given means; one pass over ``points`` (one array column) per round.

    What reaches the driver is bounded by components times size squared.
    """
    k = len(means)
    stat = points.agg(*[F.var_pop(F.col(points.columns[0])[i]) for i in range(size)]).first()
    spread = np.array(stat, float) + ridge
    covs = np.stack([np.diag(spread) if kind == "full" else spread] * k)
    if kind == "spherical":
        covs[:] = spread.mean()
    weights, before = np.full(k, 1 / k), -np.inf
    for _ in range(rounds):
        parts = points.mapInArrow(_expectation(size, weights, means, covs), "k int, v array<double>").groupBy("k").applyInArrow(_add_lists, "k int, v array<double>")
        sums = np.zeros((k + 1, 1 + size + covs[0].size))
        for r in parts.collect():
            sums[r.k + 1, : len(r.v)] = r.v
        n, like = sums[0, 0], sums[0, 1]
        if like - before < tolerance * abs(like):
            break
        before = like
        held = np.maximum(sums[1:, 0], 1e-9)
        weights, means = np.maximum(held / n, 1e-300), sums[1:, 1:1 + size] / held[:, None]
        if kind == "full":
            covs = sums[1:, 1 + size:].reshape(k, size, size) / held[:, None, None] - np.einsum("ki,kj->kij", means, means) + ridge * np.eye(size)
        else:
            covs = np.maximum(sums[1:, 1 + size:] / held[:, None] - means ** 2, 0.0) + ridge
            if kind == "spherical":
                covs = np.repeat(covs.mean(axis=1, keepdims=True), size, axis=1)
    free = {"spherical": 1, "diagonal": size, "full": size * (size + 1) // 2}[kind]
    return float(like), int(n), k * (size + free) + k - 1, weights, means, covs


def _criteria(like: float, n: int, p: int) -> tuple[float, float, float]:
    return like, 2.0 * p - 2 * like, p * math.log(n) - 2 * like


def mixture_choice(df: DataFrame, key: str, vector: str, size: int, counts: list[int], kinds: tuple[str, ...], starts: int = 2) -> DataFrame:
    """AIC and BIC of Gaussian mixtures; of ``starts`` seeded starts the likeliest is kept."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == size).persist()
    seeds = [(k, s) for k in counts for n in range(starts if k > 1 else 1) if len(s := seed_centres(rows, size, k, 7 + n)) == k]
    with ThreadPool(4) as pool:  # fits are separate chains of jobs
        found = pool.starmap(lambda kind, k, s: (kind, k, fit_mixture(rows.select("v"), size, s, kind)[:3]), [(kind, *s) for kind in kinds for s in seeds])
    rows.unpersist()
    best = {}
    for kind, k, fit in found:
        best[kind, k] = max(best.get((kind, k), fit), fit, key=lambda r: r[0])
    out = [(*name, *_criteria(*fit)) for name, fit in best.items()]
    return df.sparkSession.createDataFrame(sorted(out), "covariance string, k int, log_likelihood double, aic double, bic double")


def mixture_of_classes(df: DataFrame, vector: str, label: str, size: int, kinds: tuple[str, ...]) -> DataFrame:
    """One component per class, started at the class means; accuracy of the component as a guess of the class."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(v.alias("v"), F.col(label).alias("y")).filter((F.size("v") == size) & F.col("y").isNotNull()).persist()
    means = rows.groupBy("y").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(size)]).alias("m")).orderBy("y").collect()  # one row per class
    classes, start = [r.y for r in means], np.array([r.m for r in means])
    out = []
    for kind in kinds:
        like, n, p, weights, centres, covs = fit_mixture(rows.select("v"), size, start, kind)

        def guess(batches):
            for b in batches:
                best = (np.log(weights) + _log_densities(matrix_of(b.column(0), size), centres, covs)).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), b.column(1)], names=["k", "y"])

        y_type = rows.schema["y"].dataType.simpleString()
        hit = rows.mapInArrow(guess, f"k int, y {y_type}").agg(F.avg((F.get(F.lit(classes), F.col("k")) == F.col("y")).cast("int"))).first()[0]
        out.append((kind, len(classes), float(hit), *_criteria(like, n, p)))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "covariance string, k int, accuracy double, log_likelihood double, aic double, bic double")


# ---- DBSCAN on a grid -----------------------------------------------------------------

def _offsets(dims: int) -> list[tuple[int, ...]]:
    """Cells that can hold a point within one radius when cells have side radius / sqrt(dims)."""
    reach = math.ceil(math.sqrt(dims))
    steps = range(-reach, reach + 1)
    return [o for o in itertools.product(steps, repeat=dims)
            if sum(max(0, abs(x) - 1) ** 2 for x in o) < dims]


def _near_counts(eps: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy()) if len(right) else None
        hits = np.zeros(len(a), dtype="int64")
        if b is not None:
            for lo in range(0, len(a), 512):
                d = a[lo:lo + 512, None, :] - b[None, :, :]
                hits[lo:lo + 512] = (np.einsum("ijk,ijk->ij", d, d) <= eps * eps) @ right["w"].to_numpy()
        return pd.DataFrame({"id": left["id"], "hits": hits})

    def guarded(left, right):
        if not len(left):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "hits": pd.Series(dtype="int64")})
        return run(left, right)

    return guarded


def _cell_links(eps: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": pd.Series(dtype="str"), "b": pd.Series(dtype="str")})
        if not len(left) or not len(right):
            return empty
        b = np.stack(right["v"].to_numpy())
        target = right["home"].iloc[0]
        found = []
        for home, rows in left.groupby("home"):
            a = np.stack(rows["v"].to_numpy())
            for lo in range(0, len(a), 512):
                d = a[lo:lo + 512, None, :] - b[None, :, :]
                if (np.einsum("ijk,ijk->ij", d, d) <= eps * eps).any():
                    found.append(home)
                    break
        return pd.DataFrame({"a": found, "b": [target] * len(found)}) if found else empty

    return run


def _nearest_core(eps: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "cluster": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return empty
        a, b = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        label = right["cluster"].to_numpy()
        out = np.full(len(a), np.iinfo("int64").max)
        for lo in range(0, len(a), 512):
            d = a[lo:lo + 512, None, :] - b[None, :, :]
            near = np.einsum("ijk,ijk->ij", d, d) <= eps * eps
            out[lo:lo + 512] = np.where(near, label[None, :], np.iinfo("int64").max).min(axis=1)
        keep = out < np.iinfo("int64").max
        return pd.DataFrame({"id": left["id"].to_numpy()[keep], "cluster": out[keep]})

    return run


def connected_components(edges: DataFrame, nodes: DataFrame, counted: list | None = None) -> DataFrame:
    """Smallest node name reachable from each node: ``node, root``.

    A round takes the smallest label around a node, hands it to the node's old label as
    well, so that whole trees hook onto each other, and then the label of the label.
    Rounds grow with the logarithm of a chain (1,000 nodes in random order: about ten).
    ``counted`` gets an entry for each round.
    """
    both = cut_lineage(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = cut_lineage(labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")))
        hooks = step.groupBy(F.col("old").alias("node")).agg(F.min("root").alias("hook"))
        step = step.join(hooks, "node", "left").select("node", "old", F.least("root", F.coalesce("hook", "root")).alias("root"))
        jump = step.select(F.col("node").alias("_n"), F.col("root").alias("_j"))
        labels = cut_lineage(step.join(jump, step.root == jump._n, "left").select("node", "old", F.least("root", F.coalesce("_j", "root")).alias("root")))
        if counted is not None:
            counted.append(1)
        if labels.where("root <> old").isEmpty():
            return labels.select("node", "root")


def dbscan(df: DataFrame, key: str, vector: str, dims: int, eps: float, least: int, block: int = 5000) -> DataFrame:
    """Density clustering of low-dimensional points: ``id, cluster`` with -1 for noise.

    A cell's diagonal is the radius, so a cell with ``least`` points holds only core
    points of one cluster and needs no distances inside.  Other points meet the
    neighbouring cells block by block; clusters are components of the cell graph.
    A border point joins the smallest cluster it touches.  Copies of a position are
    one weighted spot until the end, so any number of them costs one comparison.
    """
    side = eps / math.sqrt(dims)
    v = F.col(vector).cast("array<double>")
    cell = F.transform(F.slice(v, 1, dims), lambda x: F.floor(x / side))
    rows = cut_lineage(df.select(F.col(key).cast("bigint").alias("id"), F.slice(v, 1, dims).alias("v"), cell.alias("c"))
                      .withColumn("home", F.array_join(F.col("c").cast("array<string>"), "|")))
    pts = cut_lineage(rows.groupBy("home", "c", "v").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("id")))
    sizes = pts.groupBy("home").agg(F.sum("w").alias("n"))
    near = F.array(*[F.array(*[F.lit(int(x)).cast("bigint") for x in o]) for o in _offsets(dims)])

    def neighbours_of(d: DataFrame) -> DataFrame:
        spots = d.withColumn("_o", F.explode(near))
        return spots.withColumn("cell", F.array_join(F.zip_with("c", "_o", lambda a, b: a + b).cast("array<string>"), "|")).drop("_o")

    def blocked(d: DataFrame, by: str) -> DataFrame:
        counts = d.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
        return d.join(counts, by).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def meet(left: DataFrame, right: DataFrame, fn, schema: str) -> DataFrame:
        """``left`` (with ``cell``) against the blocks of ``right`` (with ``home``)."""
        target = blocked(right, "home").withColumnRenamed("home", "cell")
        target = target.withColumn("home", F.col("cell"))
        n = target.select("cell", "blocks").distinct()
        source = left.join(n, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # A second cut bounds the left side of a task as well.
        source = source.select(*[F.col(c).alias(c) for c in source.columns])
        per = source.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
        source = source.join(per, ["cell", "part"]).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
        target = target.join(per, ["cell", "part"]).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        keys = ["cell", "part", "cut"]
        target = target.select(*[F.col(c).alias(c) for c in target.columns])
        keep = [c for c in ("id", "v", "home", "cluster") if c in source.columns]
        have = [c for c in ("v", "home", "cluster", "w") if c in target.columns]
        return source.select(*keys, *keep).groupBy(*keys).cogroup(target.select(*keys, *have).groupBy(*keys)).applyInPandas(fn, schema)

    with_size = pts.join(sizes, "home")
    full, thin = with_size.filter(F.col("n") >= least).drop("n"), with_size.filter(F.col("n") < least).drop("n")
    counted = meet(neighbours_of(thin), pts, _near_counts(eps), "id bigint, hits bigint")
    dense = counted.groupBy("id").agg(F.sum("hits").alias("hits")).filter(F.col("hits") >= least).select("id")
    core = cut_lineage(full.unionByName(thin.join(dense, "id", "left_semi").select(*full.columns)))
    cells = core.select(F.col("home").alias("node")).distinct()
    links = meet(neighbours_of(core).filter(F.col("cell") > F.col("home")), core, _cell_links(eps), "a string, b string")
    roots = connected_components(links.distinct(), cells)
    first = core.join(roots, core.home == roots.node).select("id", "v", "c", "home", "root")
    names = first.groupBy("root").agg(F.min("id").alias("cluster"))
    cored = cut_lineage(first.join(names, "root").drop("root"))
    rest = pts.join(cored.select("id"), "id", "left_anti")
    border = meet(neighbours_of(rest), cored, _nearest_core(eps), "id bigint, cluster bigint").groupBy("id").agg(F.min("cluster").alias("cluster"))
    outside = rest.select("id").join(border, "id", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"))
    labels = cored.select("id", "cluster").unionByName(outside)
    spots = pts.select("home", "v", "id").join(labels, "id").select("home", "v", "cluster")
    return rows.select("id", "home", "v").join(spots, ["home", "v"]).select("id", "cluster")


def neighbour_graph(df: DataFrame, key: str, vector: str, neighbours: int) -> tuple[DataFrame, DataFrame]:
    """(cells, nodes) of half the identity plus half the normalised graph of nearest neighbours; its eigenvalues lie in [0, 1]."""
    near = materialise(knn_join(df, df, key, vector, neighbours, include_self=False), "neighbours")
    pairs = near.select(F.least("qid", "cid").alias("i"), F.greatest("qid", "cid").alias("j"), (1 / (1 + F.col("distance"))).alias("w"))
    pairs = pairs.groupBy("i", "j").agg(F.max("w").alias("w"))
    both = materialise(pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), "graph")
    degree = both.groupBy("i").agg(F.sum("w").alias("d"))
    scaled = both.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("e")), "j").select("i", "j", (F.col("w") / F.sqrt(F.col("d") * F.col("e")) / 2).alias("v"))
    nodes = df.select(F.col(key).cast("bigint").alias("node")).distinct()
    return scaled.unionByName(nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.5).alias("v"))), nodes


def spectral_clusters(df: DataFrame, key: str, vector: str, k: int, neighbours: int = 10, tolerance: float = 1e-5, seed: int = 7) -> DataFrame:
    """k-means on the leading eigenvectors of the neighbour graph, each row scaled to length one: ``id, cluster``.

    Only ``neighbours`` edges per row exist.  The vectors are tables and are iterated until
    they have converged to ``tolerance``; it raises if they do not.
    """
    cells, nodes = neighbour_graph(df, key, vector, neighbours)
    _, x = leading_vectors(cells, nodes, k, tolerance, spare=k + 4)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b))
    points = materialise(x.select(F.col("node").alias("id"), F.transform("x", lambda v: F.when(norm > 0, v / norm).otherwise(0.0)).alias("x")), "embedded")
    points = points.select("id", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=100).fit(points).transform(points).select("id", F.col("prediction").cast("bigint").alias("cluster"))


# ---- k-means by seeded batches, and seeds for it and for mixtures ---------------------------

def _nearest_centres(centres: np.ndarray):
    """Place of the nearest centre and squared distance for each row of a matrix."""
    square = (centres * centres).sum(axis=1)

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, far = np.empty(len(x), int), np.empty(len(x))
        for lo in range(0, len(x), 4096):
            p = x[lo:lo + 4096]
            at[lo:lo + 4096] = (square - 2 * p @ centres.T).argmin(axis=1)
            d = p - centres[at[lo:lo + 4096]]
            far[lo:lo + 4096] = np.einsum("ij,ij->i", d, d)
        return at, far

    return run


def _batch_sums(size: int, centres: np.ndarray):
    """Per centre: rows, sums and cost, added up in a partition; ``part`` keeps the order of later additions."""
    def run(batches):
        nearest, n, s, cost, part = _nearest_centres(centres), np.zeros(len(centres)), np.zeros_like(centres), np.zeros(len(centres)), 0
        for b in batches:
            x = matrix_of(b.column("v"), size)
            at, far = nearest(x)
            n += np.bincount(at, minlength=len(n))
            cost += np.bincount(at, far, minlength=len(n))
            np.add.at(s, at, x)
            part = b.column("part")[0].as_py()
        keep = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"k": pa.array(keep, pa.int32()), "part": pa.array([part] * len(keep), pa.int32()), "n": pa.array(n[keep]), "cost": pa.array(cost[keep]), "s": pa.array(s[keep].tolist(), pa.list_(pa.float64()))})

    return run


def _centre_sums(points: DataFrame, size: int, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows and sums of each centre, and the whole cost; a row per centre reaches the driver."""
    found = points.withColumn("part", F.spark_partition_id()).mapInArrow(_batch_sums(size, centres), "k int, part int, n double, cost double, s array<double>")

    def add(t: pa.Table) -> pa.Table:
        order = np.argsort(t["part"].to_numpy(), kind="stable")
        s = np.stack(t["s"].to_numpy())[order].sum(axis=0)
        return pa.table({"k": t["k"][:1], "n": pa.array([t["n"].to_numpy()[order].sum()]), "cost": pa.array([t["cost"].to_numpy()[order].sum()]), "s": pa.array([s], pa.list_(pa.float64()))})

    n, s, cost = np.zeros(len(centres)), np.zeros_like(centres), 0.0
    for r in sorted(found.groupBy("k").applyInArrow(add, "k int, n double, cost double, s array<double>").collect()):
        n[r.k], s[r.k] = r.n, r.s
        cost += r.cost
    return n, s, cost


def seed_centres(points: DataFrame, size: int, k: int, seed: int, rounds: int = 5) -> np.ndarray:
    """k starting centres by oversampling (k-means||) from ``points`` (id, v).

    Each round draws about 2k rows with a chance in proportion to their squared distance
    from all rows drawn so far; the draw depends on the key and the seed alone.  What was
    drawn, about ``rounds`` times 2k rows, is weighed by the rows nearest to it and clustered
    on the driver; of ten tries the cheapest counts.
    """
    uniform = lambda n: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(n)), F.lit(1 << 40)) + 0.5) / (1 << 40)
    first = points.orderBy(uniform(0), "id").select("v").first()
    if first is None:
        return np.zeros((0, size))
    drawn = np.array([first.v], float)
    for n in range(1, rounds + 1):
        _, _, cost = _centre_sums(points, size, drawn)
        if cost <= 0:
            break
        nearest, share = _nearest_centres(drawn), 2 * k / cost

        def draw(batches):
            for b in batches:
                far = nearest(matrix_of(b.column("v"), size))[1]
                keep = pa.array(b.column("u").to_numpy() < share * far)
                yield pa.RecordBatch.from_arrays([b.column("v").filter(keep), b.column("id").filter(keep)], names=["v", "id"])

        more = points.select("id", "v", uniform(n).alias("u")).mapInArrow(draw, "v array<double>, id bigint").orderBy("id").collect()  # about 2k rows
        if more:
            drawn = np.vstack([drawn, np.array([r.v for r in more], float)])
    drawn = np.unique(drawn, axis=0)
    weight, _, _ = _centre_sums(points, size, drawn)
    rng = np.random.default_rng(seed)
    best = min((_thinned(drawn, weight, k, rng) for _ in range(10)), key=lambda found: found[0])
    return best[1]


def _thinned(rows: np.ndarray, weight: np.ndarray, k: int, rng) -> tuple[float, np.ndarray]:
    """(cost, centres): k of a few weighted rows, drawn by squared distance and then improved; no more than there are rows."""
    chosen = [int(rng.choice(len(rows), p=weight / weight.sum()))]
    far = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(rows)):
        pull = weight * far
        pull = pull if pull.sum() > 0 else far
        if pull.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(rows), p=pull / pull.sum())))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    centres, before = rows[chosen].copy(), math.inf
    while True:
        at, far = _nearest_centres(centres)(rows)
        cost = float(weight @ far)
        if not cost < before * (1 - 1e-9):
            return cost, centres
        before = cost
        held = np.bincount(at, weight, minlength=len(centres))
        moved = np.stack([np.bincount(at, weight * rows[:, j], minlength=len(centres)) for j in range(rows.shape[1])], axis=1)
        here = held > 0
        centres[here] = moved[here] / held[here, None]


def minibatch_kmeans(df: DataFrame, key: str, vector: str, k: int, batches: int = 10, epochs: int = 5, seed: int = 7) -> tuple[np.ndarray, DataFrame]:
    """Centres moved by one seeded batch after the other, and ``id, cluster`` of all rows.

    Rows are dealt to ``batches`` files by a hash of their key, so a step reads its own
    batch and nothing else.  Each centre has a learning rate of its own: the share of its
    rows in this batch among all it has seen.  Sums of a batch are added in a fixed order,
    so reruns agree.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null")
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "batches")
    rows.withColumn("batch", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches)).cast("int")).repartition("batch", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("batch", "id").write.partitionBy("batch").parquet(path)
    dealt = spark.read.schema("id bigint, v array<double>, batch int").parquet(path)
    first = dealt.first()
    if first is None:
        return np.zeros((0, 0)), rows.select("id", F.lit(0).cast("bigint").alias("cluster")).limit(0)
    size = len(first.v)
    centres = seed_centres(dealt.select("id", "v"), size, k, seed)
    seen = np.zeros(len(centres))
    for step in range(epochs * batches):
        n, s, _ = _centre_sums(dealt.where(F.col("batch") == step % batches).select("v"), size, centres)
        seen += n
        here = n > 0
        centres[here] += (s[here] - n[here, None] * centres[here]) / seen[here, None]
    nearest = _nearest_centres(centres)

    def assign(batches_):
        for b in batches_:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(nearest(matrix_of(b.column("v"), size))[0], pa.int64())], names=["id", "cluster"])

    return centres, rows.mapInArrow(assign, "id bigint, cluster bigint")


def cluster_by(name: str, df: DataFrame, key: str, vector: str, k: int, **options) -> DataFrame:
    """Cluster rows with the algorithm of the given name: ``id, cluster``.

    "Ward" is bisecting k-means, which also cuts where the sum of squares falls most but
    from the whole down; agglomeration from single rows up needs all pairs.
    """
    if name == "MiniBatchKMeans":
        return minibatch_kmeans(df, key, vector, k, **options)[1]
    if name in ("KMeans", "Ward"):
        model = BisectingKMeans(k=k, seed=7) if name == "Ward" else KMeans(k=k, seed=7)
        points = df.select(F.col(key).cast("bigint").alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
        return model.fit(points).transform(points).select("id", F.col("prediction").cast("bigint").alias("cluster"))
    if name == "SpectralClustering":
        return spectral_clusters(df, key, vector, k, **options)
    if name == "DBSCAN":
        return dbscan(df, key, vector, **options)
    raise ValueError(f"{name} has no distributed form here")


# ---- profiles to clusters ------------------------------------------------------------------

class ProfileClusters:
    """Scaling, components and centres learnt from weekly profiles; all of bounded size."""

    def __init__(self, mean, scale, basis, centres):
        self.mean, self.scale, self.basis, self.centres = mean, scale, basis, centres

    def assign(self, profiles: DataFrame, entity: str, vector: str) -> DataFrame:
        mean, scale, basis, centres = self.mean, self.scale, self.basis, self.centres

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            x = (np.stack(v.to_numpy()) - mean) / scale @ basis.T
            d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
            return pd.Series(d.argmin(axis=1).astype("int32"))

        return profiles.select(entity, nearest(vector).alias("cluster"))


def cluster_train(profiles: DataFrame, entity: str, vector: str, size: int, k: int, share: float = 0.9) -> ProfileClusters:
    """Profiles scaled per slot, reduced to the components that explain ``share``, then k-means."""
    stats = profiles.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    mean, scale = np.zeros(size), np.ones(size)
    for r in stats:
        mean[r.i], scale[r.i] = r.m, r.s if r.s and r.s > 0 else 1.0

    def constant(v):
        return F.lit([float(x) for x in v])

    scaled = profiles.select(entity, F.zip_with(F.zip_with(F.col(vector), constant(mean), lambda a, b: a - b), constant(scale), lambda a, b: a / b).alias("z")).persist()
    fit = linalg.fit_components(scaled, "z", size)
    basis = fit.vectors[:fit.keep(share)]
    reduced = linalg.project_residuals(scaled, "z", np.zeros(size), basis)
    columns = [f"coeff_{i + 1}" for i in range(len(basis))]
    points = reshape.columns_to_vector(reduced.select(entity, *columns), columns)
    model = KMeans(k=k, seed=7).fit(points)
    scaled.unpersist()
    return ProfileClusters(mean, scale, basis, np.array(model.clusterCenters()))


def cluster_assign(model: ProfileClusters, entities: DataFrame, own: DataFrame, by_type: DataFrame, entity: str, kind: str) -> DataFrame:
    """Cluster of each entity by its own profile, else by its type's, else by an empty one."""
    fine = model.assign(own, entity, "vector")
    coarse = model.assign(by_type, kind, "vector")
    spark: SparkSession = entities.sparkSession
    blank = model.assign(spark.createDataFrame([(0, [0.0] * len(model.mean))], "none int, vector array<double>"), "none", "vector").first()["cluster"]
    f = fine.withColumnRenamed("cluster", "_f")
    c = coarse.withColumnRenamed("cluster", "_c")
    return entities.join(f, entity, "left").join(c, kind, "left").select(entity, F.coalesce("_f", "_c", F.lit(int(blank))).alias("cluster"))


def centres_of(df: DataFrame, k: int, seed: int = 7) -> list[list[float]]:
    """Sorted k-means centres."""
    return sorted([float(x) for x in c] for c in KMeans(k=k, seed=seed).fit(df).clusterCenters())
