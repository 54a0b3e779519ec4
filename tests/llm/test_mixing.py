import random
import re

from pyspark.sql import functions as F

from sparkloom.llm import mixing
from tests.llm import brute


def documents(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["hot"] * 6 + ["a", "é", "Z", "zz", None])
        rows.append((rnd.choice([i, i, None]), rnd.choice(["w " * rnd.randint(0, 400), None if rnd.random() < 0.2 else "x\ty"]), source))
    return rows + rows[:5]


def sizes(rows):
    out = {}
    for _, t, s in rows:
        out[s] = out.get(s, 0) + len((t or "").split())
    return sorted(out.items(), key=str)


def taken(df):
    return sorted((tuple(r) for r in df.select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str)


def test_targets_and_limits(spark):
    rows = documents(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture = mixing.mix(df, block_words=16, shard_slots=64, piece_rows=50)
    got = taken(mixture.taken())
    want, size = brute.targets(sizes(rows)), dict(sizes(rows))
    assert sorted(((d, s, n) for d, s, n, *_ in got), key=str) == sorted(((d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows), key=str)
    total = {}
    for _, s, n, source_size, target, t in got:
        assert source_size == size[s] and abs(target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= t <= 2 * n
        total[s] = total.get(s, 0) + t
    for s in size:
        assert abs(total[s] - want[s]) <= 32
    assert taken(mixing.mix(df.repartition(7), block_words=16, shard_slots=64, piece_rows=50).taken()) == got  # reruns agree


def test_every_slot_is_filled_once_and_shards_vary(spark):
    rows = [(i, "w " * 50, s, 1) for i in range(300) for s in ("a",)] + [(1000 + i, "w " * 50, "b", 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    mixture = mixing.mix(df, weights=(1, 1), block_words=10, shard_slots=100)
    slots = mixture.pieces.select("slot", "shard", "rank", "epoch", "block").distinct()
    n = slots.count()
    assert n == slots.select("slot").distinct().count() == 4500
    used = slots.groupBy("rank", "block").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(used) == (1, 2)  # every block once or twice
    per = [r["count"] for r in slots.where("rank = 0").groupBy("shard").count().collect()]
    assert len(set(per)) > 3 and abs(sum(per) / len(per) - 50) < 5  # multinomial counts
    words = mixture.texts(df).agg(F.sum(F.size("words")), F.sum("n_words")).first()
    assert words[0] == words[1]


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()
        assert sorted(r[0] for r in got) == list(range(n))


def test_water_filling(spark):
    rnd = random.Random(4)
    for _ in range(8):
        rows = [(s, rnd.choice([0, 1, 5, 1000, 50])) for s in rnd.sample(["a", "b", "Ä", "B", "c", "d", None], rnd.randint(1, 7))]
        df = spark.createDataFrame(rows, "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        if sum(n for _, n in rows):
            want = brute.targets(rows)
            assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).taken().count() == 0
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.size, r.taken) for r in mixing.mix(df).taken().orderBy("doc_id").collect()] == [(1, 0, 0), (2, 0, 0)]


def test_no_python_in_the_plan(spark, monkeypatch):
    plans = []
    real = mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, label: (plans.append(df), real(df, label))[1])
    plans.append(mixing.mix(spark.createDataFrame(documents(spark, 60), "doc_id long, text string, source string")).taken())
    assert len(plans) > 3
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
