"""Eigenvectors of tables, and what is built on them."""

import pathlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import clusters, eigen, linalg
from sparkloom.operators.linalg import matrix_of
from sparkloom.plans.catalog import load
from sparkloom.plans.registry import Tables
from sparkloom.runtime import scratch_path


def tables(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame(pa.table({"i": i, "j": j, "v": m[i, j]})), spark.range(len(m)).withColumnRenamed("id", "node")


def vectors(df):
    rows = sorted(df.collect())
    return np.array([r.x for r in rows])


@pytest.mark.parametrize("n, count", [(1, 1), (2, 1), (3, 2), (40, 3), (200, 2)])
def test_equals_dense(spark, n, count):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, n))
    m = m + m.T + np.diag(np.r_[[9.0 * n, -7.0 * n, 5.0 * n][: min(n, 3)], np.zeros(max(0, n - 3))])
    values, x = eigen.leading_vectors(*tables(spark, m), count)
    want, dense = np.linalg.eigh(m)
    order = np.argsort(-np.abs(want))[:count]
    x = vectors(x)
    assert np.allclose(values, want[order], rtol=1e-9) and np.allclose(x @ x.T, dense[:, order] @ dense[:, order].T, atol=1e-6)


def test_nodes_without_cells_and_zero_matrix(spark):
    m = np.zeros((6, 6))
    m[1, 2] = m[2, 1] = 3.0
    cells, nodes = tables(spark, m)
    values, x = eigen.leading_vectors(cells, nodes, 2)
    assert np.allclose(sorted(values), [-3, 3]) and np.allclose(vectors(x)[[0, 3, 4, 5]], 0, atol=1e-9)
    values, _ = eigen.leading_vectors(cells.where("v = 0"), nodes, 1)
    assert np.allclose(values, 0)


def test_unconverged_vectors_never_come_out(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(120, 120))
    with pytest.raises(RuntimeError, match="did not converge"):
        eigen.leading_vectors(*tables(spark, m + m.T), 1, rounds=2)


def test_two_hundred_thousand_entities(spark):
    """Groups of like entities of growing strength; the vectors stay tables throughout."""
    n, size = 200_000, 100
    nodes = spark.range(n).withColumnRenamed("id", "node").repartition(8)
    g = F.floor(F.col("node") / size)
    strength = F.when(g == 1234, 5.0).otherwise(1.0)
    ring = nodes.select(F.col("node").alias("i"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 31)])).alias("k"), strength.alias("v"))
    ring = ring.select("i", (F.floor(F.col("i") / size) * size + (F.col("i") + F.col("k")) % size).alias("j"), "v")
    pairs = ring.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v")
    got = eigen.spectral_order(pairs, "v")
    assert got.count() == n
    top = got.where("position > %d" % (n - size)).agg(F.min("entity"), F.max("entity"), F.min("loading"), F.max("loading")).first()
    assert top[:2] == (123_400, 123_499) and np.allclose(top[2:], 0.1, atol=1e-6)


def test_spectral_clusters_of_five_hundred_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5, 16))[np.arange(500) % 5] * 3 + rng.normal(size=(500, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>")
    cells, nodes = clusters.neighbour_graph(df, "id", "v", 10)
    m = np.zeros((500, 500))
    for r in cells.collect():
        m[r.i, r.j] = r.v
    assert np.allclose(m, m.T) and np.linalg.eigvalsh(m)[[0, -1]].round(9).tolist() >= [0, 1]
    values, found = eigen.leading_vectors(cells, nodes, 5, 1e-7)
    want, dense = np.linalg.eigh(m)
    found = vectors(found)
    assert np.allclose(values, want[::-1][:5], atol=1e-9) and np.allclose(found @ found.T, dense[:, -5:] @ dense[:, -5:].T, atol=1e-4)
    got = {r.id: r.cluster for r in clusters.spectral_clusters(df, "id", "v", 5).collect()}
    assert len({(i % 5, got[i]) for i in range(500)}) == 5


def test_products_are_summed_per_partition():
    rng = np.random.default_rng(6)
    s, a = rng.normal(size=(50, 3)), rng.normal(size=(50, 3))
    lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_pydict({"node": np.arange(50), "s": lists(s), "a": lists(a)})
    out = next(eigen._products(3)(iter([batch.slice(0, 20), batch.slice(20)])))
    assert np.allclose(out.column("g").to_numpy().reshape(3, 3), s.T @ s) and np.allclose(out.column("h").to_numpy().reshape(3, 3), s.T @ a)
    mixed = next(eigen._combine(3, np.ones((3, 2)))(iter([batch])))
    assert np.allclose(matrix_of(mixed.column("s"), 2), s @ np.ones((3, 2)))


def test_rounds_leave_no_files_behind(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=(n, 3))
    v = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
    cells = spark.createDataFrame(pa.table({"i": np.repeat(np.arange(n), n), "j": np.tile(np.arange(n), n), "v": v.ravel()}))
    folder = pathlib.Path(scratch_path(spark, "size").removeprefix("file:")).parent
    steps = lambda: {p.name for p in folder.iterdir() if p.name.partition("-")[0] in ("step", "residuals")}
    before = steps()
    values, _ = eigen.leading_vectors(cells, spark.range(n).select(F.col("id").alias("node")), 2)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(v))[::-1][:2])
    assert len(steps() - before) <= 4  # the last of each, for the block and its check


@pytest.mark.parametrize("days", [12, 60])  # counts looked up, counts priced one by one
def test_blocks_equal_pairs(spark, days):
    rng = np.random.default_rng(days)
    rows = [(e * 5, d, int(rng.random() < 0.5)) for e in range(70) for d in range(days) if rng.random() < 0.6]
    rows += [(1, 1000, 1), (2, None, 1), (3, None, 0), (None, 0, 1), (4, 2000, None), (6, 2000, 1)]  # alone on its day, no day, no entity, no flag
    df = spark.createDataFrame(rows, "e bigint, d int, f int")
    pairs = linalg.overlap_significance(df, "e", "d", "f", 4)
    blocks = linalg.overlap_significance(df, "e", "d", "f", 4, 16, in_blocks=True)
    ends = sorted(r.node for r in blocks.places.collect())
    known = pairs.collect()
    assert ends == sorted({x for r in known for x in (r.i, r.j)}) and {4, 6} <= set(ends) and not {1, 2, 3} & set(ends)
    at, m = {e: k for k, e in enumerate(ends)}, np.zeros((len(ends), len(ends)))
    for r in known:
        m[at[r.i], at[r.j]] = m[at[r.j], at[r.i]] = r.log_p or 0.0
    x = rng.normal(size=(len(ends), 3))
    v = spark.createDataFrame([(e, x[at[e]].tolist()) for e in ends], "node bigint, x array<double>")
    got = {r.node: r.y for r in eigen.multiply(blocks, v, 2).collect()}
    assert np.count_nonzero(m) and np.allclose([got[e] for e in ends], m @ x[:, :2], rtol=1e-12, atol=1e-12)
    order = [{r.entity: r.loading for r in eigen.spectral_order(p, "log_p").collect()} for p in (pairs, blocks)]
    assert order[0].keys() == order[1].keys() and all(abs(order[0][e] - order[1][e]) < 1e-7 for e in order[0])


def test_the_query_writes_no_cells(spark, tmp_path):
    """200 segments that all share days: none of their 19,900 pairs is written, and the vector is that of the dense matrix."""
    n, days = 200, 25
    s = F.pmod(F.xxhash64("u", "d"), F.lit(80)).cast("double")
    rows = spark.range(n).withColumnRenamed("id", "u").select("u", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("d"))
    rows = rows.select(F.monotonically_increasing_id().alias("event_id"), F.expr("timestamp'2024-01-01 01:00:00' + make_interval(0, 0, 0, d)").alias("ts"), F.col("u").alias("user_id"), s.alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    folder = pathlib.Path(scratch_path(spark, "size").removeprefix("file:")).parent
    cells = lambda: {p.name for p in folder.iterdir() if p.name.startswith("cells-")}
    before = cells()
    got = {r.segment_id: r.loading for r in load()["spectral_order"].run(Tables(spark, str(tmp_path))).collect()}
    assert cells() == before
    f = np.zeros((n, days), int)
    for r in rows.collect():
        f[r.user_id, r.ts.day - 1] = r.value > 40
    own = f.sum(1)
    m = linalg.overlap_log_p(np.full(n * n, days), np.repeat(own, n), np.tile(own, n), (f @ f.T).ravel()).reshape(n, n)
    np.fill_diagonal(m, 0)
    values, dense = np.linalg.eigh(m)
    want = dense[:, np.abs(values).argmax()]
    want = want * np.sign(want[np.abs(want).argmax()])
    assert np.allclose([got[k] for k in range(n)], want, atol=1e-6)
