import random

import pytest

from sparkloom.llm import simhash
from tests.llm import brute


def expected(rows):
    fps = [brute.fingerprint(t) for _, t in rows]
    label = brute.components(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for (d, _), k in zip(rows, label):
        if d is not None:
            least[k] = min(least.get(k, d), d)
    return sorted(((d, f, least.get(k)) for (d, _), f, k in zip(rows, fps, label)), key=str)


def found(df):
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    words = [f"Wörd{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 120))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((rnd.choice([i, i, None]), rnd.choice([" ".join(w), "\t".join(w).upper(), None, "", " \n "])))
    rows += rows[:4] + [(500, "one"), (501, "One two"), (502, "x " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(simhash.near_duplicates(df)) == expected(rows)


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("hot", [2, 64])
def test_dense_cloud_loses_no_link(spark, bits, hot):
    rnd = random.Random(bits)
    centre = [rnd.getrandbits(64) for _ in range(4)]
    cloud = {c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) % (1 << 64) for c in centre for _ in range(70)}
    points = sorted(cloud, key=simhash._signed)
    df = spark.createDataFrame([(simhash._signed(p),) for p in points], "fp long")
    label = brute.components(points, lambda a, b: bin(a ^ b).count("1") <= bits)
    want = {simhash._signed(p): simhash._signed(points[k]) for p, k in zip(points, label)}
    got = {r.node: r.label for r in simhash.components(simhash.links(df, bits, hot_key=hot)).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_a_long_chain_is_one_component(spark, monkeypatch):
    rnd = random.Random(5)
    chain = [rnd.getrandbits(64)]
    while len(chain) < 1000:
        chain.append(chain[-1] ^ sum(1 << i for i in rnd.sample(range(64), rnd.choice([1, 2]))))
    rounds = []
    real = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name: rounds.append(name) or real(df, name))
    points = sorted({simhash._signed(p) for p in chain})
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
    assert got == {p: points[0] for p in points}
    assert rounds.count("labels") <= 20


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp int, label int, key int")
    assert simhash.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(2, "a b c d", 1, 2, 3), (1, "A  b c\td", 4, 5, 6)], empty.schema)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1}
