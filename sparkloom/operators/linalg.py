"""Gap-aware linear algebra on vector columns.

Per-partition sums of outer products are computed with numpy on Arrow batches and
added up by Spark.  What reaches the driver is bounded by the square of the vector
length, never by the number of rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.sequence import label_encode
from sparkloom.operators.setops import union_all
from sparkloom.runtime import cut_lineage, global_row_number, join_keys, materialise


def matrix_of(array: pa.Array, size: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; NULL entries become NaN."""
    flat = array.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(-1, size)


def columns_of(df: DataFrame) -> list[np.ndarray]:
    """Columns of a result of bounded size as arrays; NULL becomes NaN."""
    return [c.to_numpy() for c in df.toArrow().itercolumns()]


def _partials(read: Callable[[pa.RecordBatch], np.ndarray], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n, c = np.zeros((size, size)), np.zeros((size, size)), np.zeros((size, size))
        e, ne, rows = np.zeros(size), np.zeros(size), 0
        for batch in batches:
            x = read(batch)
            here = ~np.isnan(x)
            x, m = np.where(here, x, 0.0), here.astype("float64")
            s += x.T @ x
            n += m.T @ m
            c += x.T @ m
            e += x.sum(axis=0)
            ne += m.sum(axis=0)
            rows += len(x)
        if rows:
            upper = range(size)
            d = c.T
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(np.arange(-1, size), pa.int32()),
                "s": pa.array([e, *(s[i, i:] for i in upper)], pa.list_(pa.float64())),
                "n": pa.array([ne, *(n[i, i:] for i in upper)], pa.list_(pa.float64())),
                "c": pa.array([e, *(c[i, i:] for i in upper)], pa.list_(pa.float64())),
                "d": pa.array([e, *(d[i, i:] for i in upper)], pa.list_(pa.float64())),
            })

    return run


def outer_sums(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Sums over the rows in which both entries are present, for i <= j.

    ``s`` = x_i x_j, ``n`` = rows, ``c`` = x_i, ``d`` = x_j.  Row -1 holds the
    plain sums and counts per position.
    """
    rows = df.filter(F.size(vector) == size).select(F.col(vector).cast("array<double>").alias(vector))
    return _add_up(rows, lambda batch: matrix_of(batch.column(vector), size), size)


def _add_up(rows: DataFrame, read: Callable, size: int) -> DataFrame:
    kinds = ", ".join(f"{x} array<double>" for x in "sncd")
    parts = rows.mapInArrow(_partials(read, size), "i int, " + kinds)
    long = parts.select("i", F.posexplode(F.arrays_zip("s", "n", "c", "d")).alias("p", "v"))
    at = (F.greatest(F.col("i"), F.lit(0)) + F.col("p")).alias("j")
    return long.groupBy("i", at).agg(F.sum("v.s").alias("s"), F.sum("v.n").cast("bigint").alias("n"),
                                     F.sum("v.c").alias("c"), F.sum("v.d").alias("d"))


def pair_moments(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(i, j, n, cov, corr) for i <= j from the rows in which both entries are present: sample covariance and Pearson correlation.

    Partitions add up products of whole blocks of rows, so any number of positions takes
    one pass after the means; NULL where fewer than two rows, or no variance, leave it undefined.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(v.alias("v")).where(F.size("v") == size)
    means = {r.p: r.m for r in rows.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).collect()}  # one per position
    shift = np.array([means.get(i) or 0.0 for i in range(size)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c, q = (np.zeros((size, size)) for _ in range(4))
        for b in batches:
            x = matrix_of(b.column("v"), size) - shift
            m = (~np.isnan(x)).astype("float64")
            x = np.where(m > 0, x, 0.0)
            n, s, c, q = n + m.T @ m, s + x.T @ x, c + x.T @ m, q + (x * x).T @ m
        for i in range(size):  # a row of the triangle each
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32())} | {k: pa.array([a.tolist()], pa.list_(pa.float64())) for k, a in
                                             (("n", n[i, i:]), ("s", s[i, i:]), ("a", c[i, i:]), ("b", c[i:, i]), ("aa", q[i, i:]), ("bb", q[i:, i]))})

    kinds = ("n", "s", "a", "b", "aa", "bb")
    parts = rows.mapInArrow(run, "i int, " + ", ".join(f"{k} array<double>" for k in kinds))
    long = parts.select("i", F.posexplode(F.arrays_zip(*kinds)).alias("p", "z"))
    t = long.groupBy("i", (F.col("i") + F.col("p")).alias("j")).agg(*[F.sum(f"z.{k}").alias(k) for k in kinds])
    apart = F.col("s") - F.try_divide(F.col("a") * F.col("b"), "n")
    spread = lambda x: F.col(x + x) - F.try_divide(F.col(x) * F.col(x), "n")
    return t.select("i", "j", F.col("n").cast("bigint").alias("n"), F.when(F.col("n") > 1, apart / (F.col("n") - 1)).alias("cov"),
                    F.when(F.col("n") > 1, F.try_divide(apart, F.sqrt(F.greatest(spread("a"), F.lit(0.0)) * F.greatest(spread("b"), F.lit(0.0))))).alias("corr"))


def both_triangles(pairs: DataFrame, *values: str) -> DataFrame:
    """Rows for i <= j completed by their mirror images."""
    here = F.struct(F.col("i").alias("i"), F.col("j").alias("j"))
    there = F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    ends = F.when(F.col("i") == F.col("j"), F.array(here)).otherwise(F.array(here, there))
    return pairs.select(F.explode(ends).alias("e"), *values).select("e.i", "e.j", *values)


def nan_covariance(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Covariance of every position pair from the rows where both are present."""
    sums = cut_lineage(outer_sums(df, vector, size))  # size squared numbers, read three times
    means = sums.filter("i = -1").select(F.col("j").alias("k"), F.try_divide("s", "n").alias("mean"))
    pairs = both_triangles(sums.filter("i >= 0"), "s", "n")
    a = means.select(F.col("k").alias("i"), F.col("mean").alias("mean_i"))
    b = means.select(F.col("k").alias("j"), F.col("mean").alias("mean_j"))
    return pairs.join(a, "i").join(b, "j").select(
        "i", "j", "n", "mean_i", "mean_j", (F.try_divide("s", "n") - F.col("mean_i") * F.col("mean_j")).alias("cov"))


class Components:
    """Mean, eigenvalues and eigenvectors: arrays of the vector length."""

    def __init__(self, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.mean, self.values, self.vectors = mean, values, vectors

    def keep(self, share: float) -> int:
        """Number of leading components that explain at least ``share``."""
        cum = np.cumsum(self.values) / self.values.sum()
        return int(np.searchsorted(cum, share - 1e-12) + 1)

    def table(self, spark) -> DataFrame:
        total = float(self.values.sum())
        rows = [(k, float(v), float(v) / total, [float(x) for x in vec])
                for k, (v, vec) in enumerate(zip(self.values, self.vectors), 1)]
        return spark.createDataFrame(rows, "component int, eigenvalue double, share double, vector array<double>")


def fit_components(df: DataFrame, vector: str, size: int) -> Components:
    """Eigenvectors of the gap-aware covariance, largest eigenvalue first.

    The sign is fixed: the entry of largest magnitude is positive.
    """
    cov, mean = np.zeros((size, size)), np.zeros(size)
    i, j, c, m = columns_of(nan_covariance(df, vector, size).select("i", "j", "cov", "mean_i"))
    cov[i, j], mean[i] = np.nan_to_num(c), np.nan_to_num(m)
    values, vecs = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(values)[::-1]
    values, vecs = values[order], vecs.T[order]
    signs = np.sign(vecs[np.arange(size), np.abs(vecs).argmax(axis=1)])
    return Components(mean, values, vecs * signs[:, None])


def project_residuals(df: DataFrame, vector: str, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """Coefficients on an orthonormal basis and the energy left after each step.

    Gaps take the mean, so they add nothing to a coefficient.  ``res_mean`` is the
    energy left by the mean relative to the vector; ``res_k`` is what the first k
    basis vectors leave, relative to what the mean left.
    """
    size, k = len(mean), len(basis)
    others = [f for f in df.schema.fields if f.name != vector]

    def run(batches):
        for batch in batches:
            x = matrix_of(batch.column(vector), size)
            x = np.where(np.isnan(x), mean, x)
            total = (x * x).sum(axis=1)
            rest = x - mean
            coeff = rest @ basis.T
            left = [(rest * rest).sum(axis=1)]
            for i in range(k):
                rest = rest - np.outer(coeff[:, i], basis[i])
                left.append((rest * rest).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                res = [left[0] / total] + [e / left[0] for e in left[1:]]
            cols = [batch.column(f.name) for f in others] + [pa.array(coeff[:, i]) for i in range(k)]
            cols += [pa.array(total)] + [pa.array(r, from_pandas=True) for r in res]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [f.name for f in others] + [f"coeff_{i + 1}" for i in range(k)] + ["total_energy", "res_mean"] + [f"res_{i + 1}" for i in range(k)]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in others] + [f"{n} double" for n in names[len(others):]]
    ready = df.filter(F.size(vector) == size).withColumn(vector, F.col(vector).cast("array<double>"))
    return ready.mapInArrow(run, ", ".join(kinds))


def reconstruct(coefficients: list[Column], mean: np.ndarray, basis: np.ndarray) -> Column:
    """mean + sum of coefficient times basis vector, as an array."""
    def constant(v):
        return F.lit([float(x) for x in v])

    out = constant(mean)
    for c, v in zip(coefficients, basis):
        out = F.zip_with(out, F.transform(constant(v), _times(c)), lambda a, b: a + b)
    return out


def _times(c: Column):
    return lambda x: x * c


def two_way_effects(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """RMS of the values, and what is left after removing row or column means."""
    df = materialise(df.select(row, col, value), "effects")  # read three times below
    rows = df.groupBy(row).agg(F.avg(value).alias("_r"))
    cols = df.groupBy(col).agg(F.avg(value).alias("_c"))

    def rms(x):
        return F.sqrt(F.avg(x * x))

    v = F.col(value)
    out = join_keys(join_keys(df, rows, [row]), cols, [col]).agg(
        rms(v).alias("rms_total"), rms(v - F.col("_r")).alias("rms_minus_row"), rms(v - F.col("_c")).alias("rms_minus_col"))
    return out.withColumn("row_explained", 1 - F.pow(F.col("rms_minus_row") / F.col("rms_total"), F.lit(2))).withColumn(
        "col_explained", 1 - F.pow(F.col("rms_minus_col") / F.col("rms_total"), F.lit(2)))


def alternating_effects(df: DataFrame, row: str, col: str, value: str, rounds: int = 10) -> DataFrame:
    """Row and column means removed in turn; RMS left after each round.

    The values are written once, so what they come from is computed once; between
    rounds only the two effect tables change.
    """
    df = materialise(df.select(row, col, value), "effects")
    r = df.select(row).distinct().withColumn("_r", F.lit(0.0))
    c = df.select(col).distinct().withColumn("_c", F.lit(0.0))
    report = []
    for k in range(1, rounds + 1):
        r = cut_lineage(join_keys(df, c, [col]).groupBy(row).agg(F.avg(F.col(value) - F.col("_c")).alias("_r")))
        c = cut_lineage(join_keys(df, r, [row]).groupBy(col).agg(F.avg(F.col(value) - F.col("_r")).alias("_c")))
        rest = F.col(value) - F.col("_r") - F.col("_c")
        report.append(join_keys(join_keys(df, r, [row]), c, [col]).agg(F.lit(k).alias("round"), F.sqrt(F.avg(rest * rest)).alias("rms")))
    return union_all(*report)


def overlap_log_p(m: np.ndarray, n1: np.ndarray, n2: np.ndarray, l: np.ndarray) -> np.ndarray:
    """Normalised log probability of ``l`` common flags; counts repeat, so each
    log factorial is computed once per call."""
    table = np.array([math.lgamma(i + 1.0) for i in range(int(m.max(initial=0)) + 1)])
    plus = table[n1] + table[m - n1] + table[n2] + table[m - n2]
    minus = table[l] + table[n1 - l] + table[n2 - l] + table[m - n1 - n2 + l] + table[m]
    return (plus - minus) / m


@dataclass(frozen=True)
class BlockPairs:
    """A symmetric matrix of entities whose cells are never a table: a task makes those of two blocks from a short row.

    ``table`` has one row (a, b, ...) for every two blocks, a <= b, that have cells; ``places`` has (node, block, at) of
    every entity with a cell.  ``strips`` yields (first row, cells) of such a row, some matrix rows at a time; of a
    block with itself only the cells above the diagonal are filled.  ``parts``: partitions to deal the rows to.
    """

    table: DataFrame
    places: DataFrame
    width: int
    value: str
    strips: Callable[[dict], Iterator[tuple[int, np.ndarray]]]
    parts: int


#: Up to so many combinations of counts (44 common days) are priced once and looked up.
_PRICED = 1 << 22


def _price_all(k: int, least: int) -> np.ndarray:
    """``overlap_log_p`` at ((m k + n1) k + n2) k + l for all counts under ``k``; 0 where it has no value."""
    out = np.zeros((k, k**3))
    n1, n2, l = (x.ravel() for x in np.indices((k, k, k)))
    for m in range(max(least, 1), k):
        real = np.flatnonzero((n1 <= m) & (n2 <= m) & (l <= np.minimum(n1, n2)) & (l >= n1 + n2 - m))
        out[m, real] = overlap_log_p(np.full(len(real), m), n1[real], n2[real], l[real])
    return out.ravel()


@functools.lru_cache(maxsize=4)
def _prices(k: int, least: int) -> np.ndarray:
    return _price_all(k, least)


def _digits(pa_: np.ndarray, fa: np.ndarray, pb: np.ndarray, fb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product has all four counts of a pair as digits to the base of one more than the days: below 2 ** 24, and so exact."""
    k = len(pa_) + 1
    return np.vstack([pa_, fa]).T.copy(), np.vstack([k**3 * pb + k * fb, k**2 * pb + fb])


def _as_floats(rows: list[bytes], width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, -(-width // 8)), axis=1, count=width, bitorder="little").astype(np.float32)


def _overlap_strips(width: int, least: int, rows: int = 256):
    """Log probabilities of two blocks of entities, from the bits of their common days."""
    def run(row: dict) -> Iterator[tuple[int, np.ndarray]]:
        pa_, fa, pb, fb = (_as_floats(row[side], width) for side in ("pa", "fa", "pb", "fb"))
        k = len(pa_) + 1
        looked_up = k**4 <= _PRICED
        if looked_up:
            left, right = _digits(pa_, fa, pb, fb)
            prices = _prices(k, least)
        for lo in range(0, width, rows):
            if looked_up:
                v = prices.take((left[lo:lo + rows] @ right).astype(np.intp), mode="clip")
            else:
                pl, fl = pa_[:, lo:lo + rows].T, fa[:, lo:lo + rows].T
                m = pl @ pb
                spot = np.flatnonzero(m >= max(least, 1))
                v = np.zeros(m.shape)
                v.ravel()[spot] = overlap_log_p(*((x.ravel()[spot]).astype("int64") for x in (m, fl @ pb, pl @ fb, fl @ fb)))
            yield lo, np.triu(v, lo + 1) if row["a"] == row["b"] else v

    return run


def _strip_pairs(width: int, least: int, rows: int = 256):
    """Pairs of two strips of blocks, from the bits of their common days and their names: counts and probability, some rows of two blocks at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days, names, day, same, prices = {"a": {}, "b": {}}, {"a": {}, "b": {}}, 0, False, {}
        for batch in batches:
            same = batch.num_rows > 0 and batch.column("a")[0].as_py() == batch.column("b")[0].as_py()
            for side in "ab":
                for nth, blocks in enumerate(batch.column(f"t{side}").to_pylist()):
                    for x in blocks or ():
                        for held, value in zip(days[side].setdefault(x["b"], ([], [], [])), (day + nth, x["p"], x["f"])):
                            held.append(value)
                block, lists = batch.column(f"k{side}").flatten().flatten()
                for x, entities in zip(block.to_pylist(), lists):
                    at, e = entities.values.flatten()
                    place = np.zeros(width, np.int64)
                    place[at.to_numpy()] = np.arange(len(at))
                    names[side][x] = e, place
            day += batch.num_rows
        for x in sorted(days["a"]):
            for y in sorted(days["b"]):
                _, i, j = np.intersect1d(days["a"][x][0], days["b"][y][0], return_indices=True)
                if not len(i) or (same and x > y):
                    continue
                (_, pa_, fa), (_, pb, fb) = days["a"][x], days["b"][y]
                pa_, fa, pb, fb = (_as_floats([v[k] for k in own], width) for v, own in ((pa_, i), (fa, i), (pb, j), (fb, j)))
                (ea, at_a), (eb, at_b) = names["a"][x], names["b"][y]
                k = len(i) + 1
                looked_up = k**4 <= min(_PRICED, len(ea) * len(eb))
                if looked_up:
                    left, right = _digits(pa_, fa, pb, fb)
                    if k not in prices:
                        prices[k] = _price_all(k, least)
                for lo in range(0, width, rows):
                    if looked_up:
                        met = (left[lo:lo + rows] @ right).astype(np.int32)
                        spot = np.flatnonzero(np.triu(met, lo + 1) >= k**3 if same and x == y else met >= k**3)
                        code = met.ravel()[spot]
                        log_p = prices[k][code]
                        m, n1, n2, l = code // k**3, code // k**2 % k, code // k % k, code % k
                    else:
                        pl, fl = pa_[:, lo:lo + rows].T, fa[:, lo:lo + rows].T
                        met = pl @ pb
                        spot = np.flatnonzero(np.triu(met, lo + 1) if same and x == y else met)
                        m, n1, n2, l = (c.ravel()[spot].astype("int64") for c in (met, fl @ pb, pl @ fb, fl @ fb))
                        log_p = overlap_log_p(m, n1, n2, l)
                    if len(spot):
                        r, c = np.divmod(spot, width)
                        yield pa.RecordBatch.from_arrays([
                            ea.take(pa.array(at_a[r + lo])), eb.take(pa.array(at_b[c])), *[pa.array(v, pa.int64()) for v in (m.astype(np.int64), n1.astype(np.int64), n2.astype(np.int64), l.astype(np.int64))],
                            pa.array(log_p, mask=m < least)], names=["i", "j", "m", "n1", "n2", "l", "log_p"])

    return run


def _bits(width: int):
    """Lists of places as bits."""
    def run(batches):
        for b in batches:
            out = []
            for c in ("p", "f"):
                lists, bits = b.column(c), np.zeros((len(b), width), np.uint8)
                bits[pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()] = 1
                out.append(pa.array([x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("b"), *out], names=["d", "b", "p", "f"])

    return run


def _days(numbered: DataFrame, width: int) -> DataFrame:
    """(d, b, p, f): a day is a row of bits per block, of the entities that have it and of those that it flags."""
    block, at = F.floor(F.col("_n") / width), (F.col("_n") % width).cast("int")
    kind = numbered.schema["_d"].dataType.simpleString()
    spots = numbered.where("_d is not null").groupBy(F.col("_d").alias("d"), block.alias("b")).agg(
        F.collect_set(at).alias("p"), F.collect_set(F.when(F.col("_f") == 1, at)).alias("f"))
    return materialise(spots.mapInArrow(_bits(width), f"d {kind}, b bigint, p binary, f binary"), "days")


def _overlap_blocks(numbered: DataFrame, least: int, width: int, pairs_each: int = 64) -> BlockPairs:
    """The matrix of ``log_p`` from numbered rows: two blocks keep the bits of the days that have both."""
    block, at = F.floor(F.col("_n") / width), (F.col("_n") % width).cast("int")
    spots = _days(numbered, width)
    a, b = (spots.select("d", F.col("b").alias(x), F.col("p").alias(f"p{x}"), F.col("f").alias(f"f{x}")) for x in "ab")
    met = a.join(b, "d").where("a <= b").groupBy("a", "b").agg(F.collect_list(F.struct("pa", "fa", "pb", "fb")).alias("s"))
    table = materialise(met.select("a", "b", *[F.col(f"s.{c}").alias(c) for c in ("pa", "fa", "pb", "fb")]), "blocks")
    shared = numbered.groupBy("_d").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi")).where("_lo < _hi").select("_d")
    places = numbered.join(shared, "_d").select(F.col("_e").alias("node"), block.alias("block"), at.alias("at")).distinct()
    n = table.count()
    parts = min(max(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / pairs_each)), max(n, 1))
    return BlockPairs(table, materialise(places, "places"), width, "log_p", _overlap_strips(width, least), parts)


def overlap_significance(df: DataFrame, entity: str, day: str, flag: str, least: int = 200, width: int = 1024, in_blocks: bool = False) -> DataFrame | BlockPairs:
    """Normalised log probability of the common flagged days of entity pairs that share a day.

    Entities are numbered by rank and cut into blocks of ``width``.  A day is one row of bits
    per block; blocks are gathered into strips, as many as keep all shuffle partitions busy,
    two strips meet on the days that have both, and the counts of their pairs are matrix
    products of ``width`` columns.  So neither a day nor the matrix of all entities is ever
    in one task, only pairs that share a day come out, and an entity's day is copied as two
    bits per strip.  Strips know their entities and price their pairs, some at a time, so
    that a pair is never moved; as their input is short beside what comes out of it, they
    are dealt over all shuffle partitions.  Of an entity that has a day more than once, the day is
    flagged if one of its rows is.

    ``in_blocks`` gives the matrix of ``log_p`` itself instead of a row per pair, for operators that multiply it
    (``eigen.spectral_order``); a day must then have an entity once.
    """
    spark, kind = df.sparkSession, df.select(F.col(entity)).schema[0].dataType.simpleString()
    rows = df.select(F.col(entity).alias("_e"), F.col(day).alias("_d"), F.col(flag).cast("int").alias("_f")).where("_e is not null")
    numbered, ranks = attach_number(rows)
    if in_blocks:
        return _overlap_blocks(numbered, least, width)
    spots, parts = _days(numbered, width), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = (spots.agg(F.max("b")).first()[0] or 0) + 1
    strip = F.floor(F.col("b") / min(16, max(1, blocks // math.ceil(4 * math.sqrt(parts)))))
    days = materialise(spots.groupBy("d", strip.alias("s")).agg(F.collect_list(F.struct("b", "p", "f")).alias("t")), "strips")
    names = ranks.groupBy(F.floor(F.col("_n") / width).alias("b")).agg(F.collect_list(F.struct((F.col("_n") % width).cast("int").alias("at"), F.col("_e").alias("e"))).alias("k"))
    names = materialise(names.groupBy(strip.alias("s")).agg(F.collect_list(F.struct("b", "k")).alias("k")), "names")
    (a, b), (ka, kb) = ([x.withColumnRenamed("s", side).withColumnRenamed(c, c + side) for side in "ab"] for x, c in ((days, "t"), (names, "k")))
    pairs = a.select("d", "a").join(b.select("d", "b"), "d").where("a <= b").select("a", "b").distinct()
    met = a.join(b, "d").where("a <= b").drop("d").unionByName(pairs.join(ka, "a").join(kb, "b"), allowMissingColumns=True).repartition(parts, "a", "b")
    return met.groupBy("a", "b").applyInArrow(_strip_pairs(width, least), f"i {kind}, j {kind}, m bigint, n1 bigint, n2 bigint, l bigint, log_p double")


def attach_number(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column ``_n``, the 0-based rank of ``_e`` among its distinct values, and the table of ``_e`` and ``_n``."""
    ranks = cut_lineage(global_row_number(df.select("_e").distinct(), ["_e"], "_n")).withColumn("_n", F.col("_n") - 1)
    return df.join(ranks, "_e"), ranks


def box_counts(series: DataFrame, key: str, index: str, value: str, boxes: int, strict: bool) -> DataFrame:
    """Occupied boxes of each series on a grid of ``boxes`` by ``boxes``.

    A box counts if it holds a value or if the values of its column lie on both
    sides of it; the lower edge is inclusive, the upper one open when ``strict``.
    """
    extent = series.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_y0"), F.max(value).alias("_y1"))
    h = (F.col("_y1") - F.col("_y0")) / boxes
    # Column k takes the indices from floor(k n / boxes) up to floor((k + 1) n / boxes).
    column = F.floor(((F.col(index) + 1) * boxes - 1) / F.col("_n"))
    spots = series.join(extent, key).filter(F.col("_y1") > F.col("_y0")).select(
        key, column.alias("_col"), F.col(value).alias("_v"), h.alias("_h"), F.col("_y0"),
        F.floor((F.col(value) - F.col("_y0")) / h).cast("int").alias("_box"))
    # each box once, then each column with the boxes that it holds, no more than the grid has
    held = spots.groupBy(key, "_col", "_box").agg(F.max("_v").alias("_top"), F.first("_h").alias("_h"), F.first("_y0").alias("_y0"))
    per_column = held.groupBy(key, "_col").agg(F.min("_box").alias("_lo"), F.max("_box").alias("_hi"), F.max("_top").alias("_top"),
                                               F.first("_h").alias("_h"), F.first("_y0").alias("_y0"), F.collect_list("_box").alias("_held"))
    edge = F.col("_y0") + F.col("_hi") * F.col("_h")
    reaches = F.col("_top") > edge if strict else F.col("_top") >= edge
    last = F.when(reaches, F.col("_hi") - 1).otherwise(F.col("_hi") - 2)
    # all boxes from the lowest up to the last one crossed, and those held outside of them
    outside = F.filter("_held", lambda b: (b < boxes) & ((b <= F.col("_lo")) | (b > F.col("_last"))))
    n = F.greatest(F.col("_last") - F.col("_lo"), F.lit(0)) + F.size(outside)
    return per_column.withColumn("_last", last).groupBy(key).agg(F.sum(n.cast("bigint")).alias("_n")).where("_n > 0").select(key, F.col("_n").alias("n_boxes"))


def box_count_dimension(series: DataFrame, key: str, index: str, value: str, large: int = 32, small: int = 2048) -> DataFrame:
    """Slope of log(boxes) between two grids; the finer grid closes the upper edge."""
    a = box_counts(series, key, index, value, large, True).withColumnRenamed("n_boxes", "n_large")
    b = box_counts(series, key, index, value, small, False).withColumnRenamed("n_boxes", "n_small")
    slope = (F.log("n_small") - F.log("n_large")) / (math.log(small) - math.log(large))
    return a.join(b, key).withColumn("dimension", slope)


def _linear(points: DataFrame, intercept: bool):
    """Least squares of ``y`` on ``x`` by normal equations, whose summary has exact t statistics and p-values."""
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(points.dropna())
    return LinearRegression(labelCol="y", fitIntercept=intercept, solver="normal", standardization=False).fit(rows).summary


def t_test_independent_p(df: DataFrame, value: str, first: Column) -> tuple[float, float]:
    """(t, p): the pooled comparison of two groups is the slope of a regression on membership."""
    s = _linear(df.select(F.col(value).cast("double").alias("y"), first.cast("double").alias("x")), True)
    return float(s.tValues[0]), float(s.pValues[0])


def t_test_paired_p(df: DataFrame, key: str, a: str, b: str) -> tuple[float, float]:
    """(t, p) of the mean difference.

    With x = 1 or -1 by key and y = x * difference, the slope through the origin is
    the mean difference and has its standard error.
    """
    x = F.when(F.xxhash64(key) % 2 == 0, 1.0).otherwise(-1.0)
    s = _linear(df.select(x.alias("x"), (x * (F.col(a) - F.col(b))).alias("y")), False)
    return float(s.tValues[0]), float(s.pValues[0])


def chi_square_p(df: DataFrame, row: str, col: str) -> tuple[float, int, float]:
    """(statistic, degrees of freedom, p) of two categorical columns, one row per observation."""
    coded = VectorAssembler(inputCols=["_row"], outputCol="features").transform(
        label_encode(df.select(F.col(row).alias("_row"), F.col(col).alias("_col")), ["_row", "_col"]).select(F.col("_row").cast("double").alias("_row"), F.col("_col").cast("double").alias("_col")))
    r = ChiSquareTest.test(coded, "features", "_col").first()
    return float(r.statistics[0]), int(r.degreesOfFreedom[0]), float(r.pValues[0])


def t_test_independent(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Pooled-variance comparison of the rows where ``first`` holds with the others."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    s = df.agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"),
               F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    return s.select("n1", "n2", dof.alias("dof"), ((F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))).alias("t"))


def t_test_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    s = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"))
    return s.select("n", (F.col("n") - 1).alias("dof"), (F.col("m") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def chi_square(df: DataFrame, row: str, col: str, count: str) -> DataFrame:
    """Independence statistic of a contingency table; cells with no rows included.

    sum (o - e)^2 / e over all cells equals total * (sum o^2 / (r c) - 1), so
    empty cells need not be created.
    """
    table = materialise(df.groupBy(row, col).agg(F.sum(count).alias("_o")), "contingency")  # the input is read once
    rows = table.groupBy(row).agg(F.sum("_o").alias("_r"))
    cols = table.groupBy(col).agg(F.sum("_o").alias("_c"))
    cells = join_keys(join_keys(table, rows, [row]), cols, [col])
    total = table.agg(F.sum("_o")).scalar()
    part = F.sum(F.col("_o").cast("double") * F.col("_o") / (F.col("_r").cast("double") * F.col("_c")))
    dof = (rows.agg(F.count(F.lit(1))).scalar() - 1) * (cols.agg(F.count(F.lit(1))).scalar() - 1)
    return cells.agg(part.alias("_s")).select((total * (F.col("_s") - 1)).alias("statistic"), dof.alias("dof"))


def fourier_project(series: DataFrame, index: str, value: str, length: int, top: int) -> DataFrame:
    """Coefficients on the orthonormal constant, sine and cosine basis up to ``top``.

    Basis values are computed next to each sample, so there is nothing to join.
    """
    angle = 2 * math.pi / length
    terms = F.explode(F.sequence(F.lit(0), F.lit(2 * top))).alias("term")
    rows = series.select(F.col(index).alias("_i"), F.col(value).alias("_v"), terms)
    f = F.ceil(F.col("term") / 2)
    phase = f * F.col("_i") * angle
    wave = F.when(F.col("term") == 0, F.lit(1 / math.sqrt(length))).when(
        F.col("term") % 2 == 1, F.sin(phase) * math.sqrt(2 / length)).otherwise(F.cos(phase) * math.sqrt(2 / length))
    return rows.groupBy("term").agg(F.sum(F.col("_v") * wave).alias("coefficient"))


def projection_error(series: DataFrame, value: str, coefficients: DataFrame) -> DataFrame:
    """L2 distance between a series and its projection, after each further frequency."""
    whole = series.agg(F.sum(F.col(value) * F.col(value))).scalar()
    w = Window.orderBy("frequency")  # one row per frequency
    per = coefficients.groupBy(F.ceil(F.col("term") / 2).cast("int").alias("frequency")).agg(
        F.sum(F.col("coefficient") * F.col("coefficient")).alias("_e"))
    return per.select("frequency", F.sqrt(F.greatest(F.lit(0.0), whole - F.sum("_e").over(w))).alias("error"))


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """Equal-width bins; a bin is named by its lower edge."""
    return df.groupBy((F.floor(F.col(column) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
