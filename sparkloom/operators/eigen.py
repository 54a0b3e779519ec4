"""Leading eigenvectors of a symmetric matrix that is a table, kept as tables themselves.

A block of vectors is improved in the space of itself, its residuals and its last step
(a locally optimal block method).  A round multiplies the residuals by the matrix, one
join and one grouping, adds up the inner products of all columns, and combines the
columns row by row.  The driver sees these products only, a square matrix of three
times the block's width, whatever the number of entities.  The matrix is a table of its
cells or, where nearly every pair has one, ``BlockPairs`` whose cells are made anew for
each product and are neither written nor moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.linalg import BlockPairs, matrix_of
from sparkloom.runtime import global_row_number, materialise, release

_STATE = "node bigint, s array<double>, a array<double>"


def multiply(cells: DataFrame | BlockPairs, vectors: DataFrame, width: int) -> DataFrame:
    """(node, y): the matrix of ``cells`` (i, j, v), all cells given, times a block of ``vectors`` (node, x)."""
    if isinstance(cells, BlockPairs):
        return _multiply_blocks(cells, vectors, width)
    each = cells.join(vectors, cells.j == vectors.node).groupBy("i").agg(*[F.sum(F.col("v") * F.col("x")[c]).alias(f"y{c}") for c in range(width)])
    return each.select(F.col("i").alias("node"), F.array(*[f"y{c}" for c in range(width)]).alias("y"))


def _multiply_blocks(m: BlockPairs, vectors: DataFrame, width: int) -> DataFrame:
    """Two blocks meet with their parts of the vectors; the parts of the product are added up by block."""
    parts = vectors.join(m.places, "node").groupBy("block").agg(F.collect_list(F.struct("at", F.slice("x", 1, width).alias("x"))).alias("s"))
    a, b = (parts.select(F.col("block").alias(x), F.col("s.at").alias(f"at{x}"), F.flatten("s.x").alias(f"x{x}")) for x in "ab")
    met = m.table.join(a, "a").join(b, "b").repartition(m.parts, "a", "b")
    each = met.mapInArrow(_block_parts(m.strips, m.width, width), "block bigint, y array<double>")
    added = each.groupBy("block").applyInArrow(_added(m.width, width), "block bigint, at int, y array<double>")
    return added.join(m.places, ["block", "at"]).select("node", "y")


def _block_parts(strips, size: int, width: int, held: int = 256):
    """Products of two blocks and their parts of the vectors, both ways, added up while at most ``held`` blocks are met."""
    def out(sums: dict[int, np.ndarray]):
        for block, y in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([y.ravel()], pa.list_(pa.float64()))], names=["block", "y"])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(len(batch)):
                row, x = batch.slice(k, 1), {}
                for side in "ab":
                    x[side] = np.zeros((size, width))
                    x[side][row.column(f"at{side}").flatten().to_numpy()] = matrix_of(row.column(f"x{side}"), width)
                row = row.drop_columns(["ata", "xa", "atb", "xb"]).to_pylist()[0]
                a, b = (sums.setdefault(row[side], np.zeros((size, width))) for side in "ab")
                for lo, v in strips(row):
                    hi = lo + len(v)
                    a[lo:hi] += v @ x["b"]
                    b += v.T @ x["a"][lo:hi]
                if len(sums) > held:
                    yield from out(sums)
                    sums = {}
        yield from out(sums)

    return run


def _added(size: int, width: int):
    """A block's part of the product, as rows."""
    def run(t: pa.Table) -> pa.Table:
        y = sum(matrix_of(c, size * width).sum(0) for c in t["y"].chunks).reshape(size, width)
        ends = pa.array(np.arange(size + 1, dtype=np.int32) * width)
        return pa.table({"block": pa.array(np.full(size, t["block"][0].as_py())), "at": pa.array(np.arange(size, dtype=np.int32)), "y": pa.ListArray.from_arrays(ends, pa.array(y.ravel()))})

    return run


def _start(width: int) -> Column:
    """Pseudorandom entries that depend on the entity and the column alone."""
    return F.array(*[F.xxhash64("node", F.lit(c)).cast("double") / F.lit(2.0**63) for c in range(width)])


def _products(width: int):
    """Inner products of all columns of s with one another and with those of a, summed per partition."""
    def run(batches):
        g, h = np.zeros((width, width)), np.zeros((width, width))
        for b in batches:
            s, a = matrix_of(b.column("s"), width), matrix_of(b.column("a"), width)
            g += s.T @ s
            h += s.T @ a
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(g.ravel()), pa.array(h.ravel())], names=["i", "j", "g", "h"])

    return run


def _combine(width: int, mix: np.ndarray):
    """Every row's columns times a small matrix."""
    def run(batches):
        for b in batches:
            out = [matrix_of(b.column(c), width) @ mix for c in ("s", "a")]
            ends = pa.array(np.arange(len(b) + 1, dtype=np.int32) * mix.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("node"), *[pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in out]], names=["node", "s", "a"])

    return run


def _best(g: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, mix): the ``width`` vectors of largest |eigenvalue| in the space of the columns."""
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    lengths, turn = np.linalg.eigh(g * np.outer(scale, scale))
    keep = lengths > 1e-12 * lengths.max()
    base = scale[:, None] * turn[:, keep] / np.sqrt(lengths[keep])
    inner = base.T @ ((h + h.T) / 2) @ base
    values, vectors = np.linalg.eigh(inner)
    order = np.argsort(-np.abs(values), kind="stable")[:width]
    return values[order], base @ vectors[:, order]


def leading_vectors(cells: DataFrame | BlockPairs, nodes: DataFrame, count: int, tolerance: float = 1e-8, spare: int = 4, rounds: int = 300) -> tuple[np.ndarray, DataFrame]:
    """Eigenvalues of largest magnitude and their vectors: (values, table of ``node`` and ``x``).

    ``cells`` has (i, j, v) for every non-zero cell, both halves, or makes them by blocks;
    ``nodes`` has ``node``, every entity once.  It ends when what is left of each wanted vector, |A x - value x|,
    is below ``tolerance`` times the largest value, checked with a fresh product, and
    raises if ``rounds`` do not suffice: an unconverged vector never comes out.
    """
    size = nodes.count()
    width = min(size, count + spare)
    count = min(count, width)
    if isinstance(cells, DataFrame):
        cells = materialise(cells.select("i", "j", "v"), "cells")
    x = nodes.select("node", _start(width).alias("x"))
    done = 0
    while True:
        # the block alone, with a fresh product
        y = multiply(cells, x, width)
        zero = F.array(*[F.lit(0.0)] * width)
        state = kept = materialise(x.join(y, "node", "left").select("node", F.col("x").alias("s"), F.coalesce("y", zero).alias("a")), "block")
        g, h = _summed(state, width)
        values, mix = _best(g, h, width)
        state, held = state.mapInArrow(_combine(width, mix), _STATE), width
        first = True
        while True:
            # residuals of the block, which are the first columns of the state
            own = values.tolist() + [0.0] * (width - len(values))
            rest = F.array(*[F.col("a")[c] - F.lit(own[c]) * F.col("s")[c] for c in range(len(values))])
            open_ = materialise(state.withColumn("x", rest), "residuals")
            left = open_.agg(*[F.sum(F.col("x")[c] * F.col("x")[c]).alias(f"r{c}") for c in range(count)]).first()
            small = tolerance * max(1e-300, abs(values[0]))
            if all((r or 0.0) ** 0.5 <= small for r in left):
                break
            done += 1
            if done > rounds:
                raise RuntimeError(f"eigenvectors did not converge in {rounds} rounds: {[float((r or 0.0) ** 0.5) for r in left]} is left")
            y = multiply(cells, open_.select("node", "x"), len(values))
            none = F.array(*[F.lit(0.0)] * len(values))
            state = open_.join(y, "node", "left").select("node", F.concat("s", "x").alias("s"), F.concat("a", F.coalesce("y", none)).alias("a"))
            # [block, last step, residuals]; what they were made of is read no more
            state, held = materialise(state, "step"), held + len(values)
            release(kept)
            release(open_)
            kept = state
            g, h = _summed(state, held)
            before = len(values)
            values, mix = _best(g, h, min(width, held))
            step = mix.copy()
            step[:before] = 0  # the part that is not in the old block
            state, held = state.mapInArrow(_combine(held, np.hstack([mix, step])), _STATE), 2 * mix.shape[1]
            first = False
        x = state.select("node", F.slice("s", 1, len(values)).alias("x"))
        if first or all((r or 0.0) ** 0.5 <= 10 * small for r in _left(cells, x, values, count)):
            return values[:count], materialise(x.select("node", F.slice("x", 1, count).alias("x")), "vectors")
        width = len(values)


def _summed(state: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    g, h = np.zeros((width, width)), np.zeros((width, width))
    for r in state.mapInArrow(_products(width), "i bigint, j bigint, g double, h double").groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # width squared numbers
        g[r.i, r.j], h[r.i, r.j] = r.g, r.h
    return g, h


def _left(cells: DataFrame | BlockPairs, x: DataFrame, values: np.ndarray, count: int):
    """Squared lengths of A x - value x, with a product of its own."""
    x = materialise(x, "found")
    y = multiply(cells, x, count)
    zero = F.array(*[F.lit(0.0)] * count)
    both = x.join(y, "node", "left").withColumn("y", F.coalesce("y", zero))
    part = lambda c: F.col("y")[c] - F.lit(float(values[c])) * F.col("x")[c]
    return both.agg(*[F.sum(part(c) * part(c)).alias(f"r{c}") for c in range(count)]).first()


def spectral_order(pairs: DataFrame | BlockPairs, value: str, which: int = 1, tolerance: float = 1e-9) -> DataFrame:
    """Entities in the order of an eigenvector of their similarity matrix, by |eigenvalue|: ``entity, loading, position``.

    ``pairs`` has each pair (i, j) once, or makes them by blocks; missing, NULL and NaN
    similarities are 0.  The matrix and the vectors stay tables; the sign makes the
    largest entry positive.
    """
    cells, ends = (_by_blocks if isinstance(pairs, BlockPairs) else _by_cells)(pairs, value)
    _, x = leading_vectors(cells, ends, which, tolerance)
    loading = x.select(F.col("node").alias("entity"), F.col("x")[which - 1].alias("loading"))
    top = loading.agg(F.max_by("loading", F.struct(F.abs("loading"), -F.col("entity")))).first()[0]
    if top is not None and top < 0:
        loading = loading.withColumn("loading", -F.col("loading"))
    return global_row_number(loading, ["loading", "entity"], "position").select("entity", "loading", F.col("position").cast("int").alias("position"))


def _by_blocks(pairs: BlockPairs, value: str) -> tuple[BlockPairs, DataFrame]:
    if value != pairs.value:
        raise ValueError(f"the blocks hold {pairs.value}, not {value}")
    return pairs, pairs.places.select("node")


def _by_cells(pairs: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    known = pairs.select("i", "j", F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and v <> 0")
    ends = pairs.select(F.col("i").alias("node")).union(pairs.select(F.col("j").alias("node"))).distinct()
    return known.unionByName(known.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")), ends
