import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label string, score long, row string, rank int"


def brute(rows, every, positives=5, negatives=10, low=30, high=90, scale=256):
    ok = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, y in ok:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in ok]
        near = sorted((s, j) for s, j, z in scored if z == y and j != i)[:positives]
        for p, j in near:
            far = sorted((s, k) for s, k, z in scored if z != y and -low * p <= -100 * s <= -high * p)[:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(far, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x", 2) for i, v, y in rows], SCHEMA)


def mined(spark, rows, every, **options):
    return sorted(map(tuple, hard.mine(frame(spark, rows).repartition(3), F.col("vec_id") % every == 0, **options).collect()))


def clustered(seed, n, size, labels="abc"):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.3) for _ in range(size)] for _ in range(6)]
    return [(i, [c + rnd.gauss(0, 0.1) for c in rnd.choice(centres)], rnd.choice(labels)) for i in range(n)]


def test_equals_brute_force(spark):
    rows = clustered(1, 900, 48)
    got = mined(spark, rows, 20)
    assert got == brute(rows, 20) and len(got) > 1000


def test_blocks_do_not_matter(spark):
    rows = clustered(2, 300, 70, "ab")
    want = brute(rows, 10, 3, 4)
    for block, group in ((7, 3), (64, 1000), (10_000, 10_000)):
        assert mined(spark, rows, 10, positives=3, negatives=4, block_rows=block, block_anchors=group) == want


def test_rows_that_take_no_part_ties_and_repeats(spark):
    rows = clustered(3, 120, 8)
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 8, "a"), (200, None, "a"), (201, [1.0] * 7 + [None], "a"), (202, [nan] * 8, "b"), (203, [inf] + [0.0] * 7, "b"), (204, [1.0] * 8, None),
           (205, [], "a"), (206, [0.5, 0.25], "b"), (210, [0.0] * 8, "a")]
    tied = [(300 + i, rows[0][1], y) for i, y in enumerate("aabbccab" * 3)]
    again = [rows[10], rows[10], rows[11], rows[20]]
    assert mined(spark, rows + odd + tied + again, 10) == brute(rows + odd + tied + again, 10)


def test_few_rows(spark):
    assert mined(spark, [(0, [1.0], "a")], 1) == []
    assert hard.mine(frame(spark, [(0, [1.0], "a")]).limit(0), F.lit(True)).count() == 0
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.1], "a"), (2, [0.5, 0.0], "b"), (3, [-1.0, 0.0], "b")]
    assert mined(spark, rows, 5) == brute(rows, 5) == [(0, 1, 1, 2, 65536, 32768)]
    assert mined(spark, [r for r in rows if r[0]], 5) == []  # no anchor
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e9], "a"), (1, [1.0], "a")], 1)


@pytest.mark.parametrize("size", [1, 3, 64, 65, 200])
def test_intervals_hold(size):
    rng = np.random.default_rng(size)
    x = np.floor(256 * rng.standard_normal((300, size)) * rng.choice([0.001, 1, 50], (300, 1)))
    x[::50] = 0
    turn = hard.rotation(size)
    assert np.allclose(turn @ turn.T, np.eye(size))
    y = x @ turn
    align = np.abs(y).sum(axis=1) / np.sqrt(size)
    rest = np.sqrt(np.maximum((x * x).sum(axis=1) - align**2, 0))
    bits = np.zeros((300, -(-size // 64) * 64), bool)
    bits[:, :size] = y > 0
    code = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    estimate, low, high = hard.intervals(x[:120], turn, code, align, rest)
    exact = x[:120] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    if size >= 64:  # and they are intervals, not all that Cauchy-Schwarz alone allows
        norm = np.linalg.norm(x, axis=1)
        assert (high - low).mean() < 0.75 * 2 * np.outer(norm[:120], norm).mean()


def test_rows_out_of_reach_are_not_scored(monkeypatch):
    """On groups of like vectors most pairs are ruled out by their interval."""
    scored = []
    real = hard._score
    monkeypatch.setattr(hard, "_score", lambda a, x, need, out: (scored.append(np.count_nonzero(need)), real(a, x, need, out)))
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 64))
    vec = np.floor(256 * (centres[np.arange(2000) % 40] + 0.1 * rng.standard_normal((2000, 64)))).astype(np.int32)
    table = pa.table({"id": np.arange(2000), "label": [str(i % 2) for i in range(2000)], "anchor": [True] * 2000, "vec": hard._lists((vec / 256).astype(np.float64)).cast(pa.list_(pa.float64()))})
    coded = pa.Table.from_batches(list(hard._encoder(64, 256)(table.to_batches()))).append_column("row", pa.array(np.arange(2000)))
    found = hard._positives(64, 5)(coded.slice(0, 100), coded)
    assert found.num_rows == 500
    assert sum(scored) < 0.2 * 100 * 2000 / 2
