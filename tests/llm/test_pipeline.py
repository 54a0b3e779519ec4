"""The stages against plain Python versions, on documents with planted cases."""

import random

import pytest

import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.test_classifier import junk, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, k string, h string, label int, c0 int"


def write(spark, folder):
    rnd = random.Random(1)
    texts = {i: prose(rnd, rnd.randint(30, 120)) for i in range(80)}
    texts |= {i: junk(rnd, rnd.randint(20, 200)) for i in range(80, 120)}
    for i in range(120, 126):
        texts[i] = texts[i - 120]  # exact copies
    for i in range(126, 130):
        texts[i] = texts[i - 116].replace("e", "E")  # the same words for the fingerprint
    passage = prose(rnd, 60)
    for i in range(130, 136):
        texts[i] = prose(rnd, 40) + " " + passage + " " + prose(rnd, 40)
    items = [(f"b{i}", prose(rnd, 30)) for i in range(5)]
    for i in range(136, 140):
        texts[i] = prose(rnd, 20) + " " + items[i - 136][1] + " é " + prose(rnd, 20)
    rows = [(i, t, "en", f"src{i % 3}", len(t), 1, "k", None, 2, 3) for i, t in texts.items()]
    rows += [(200, None, None, None, None, None, None, None, None, None), (201, "", "en", "src1", 0, 1, "k", "h", 2, 3), (None, prose(rnd, 50), "en", None, 1, 1, "k", "h", 2, 3), rows[3], rows[3]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("planted"))
    rows, items = write(spark, folder)
    return folder, rows, items


def expected_near(rows):
    fps = [brute.fingerprint(r[1]) for r in rows]
    label = brute.components(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    best = {}
    for r, k in zip(rows, label):
        order = (r[0] is None, r[0] or 0)
        if k not in best or order < best[k][0]:
            best[k] = (order, r)
    return sorted((r for _, r in best.values()), key=str)


def expected_cut(rows):
    least = {}
    raw = [(r[1] or "").encode() for r in rows]
    for r, t in zip(rows, raw):
        for i in range(len(t) - 49):
            if r[0] is not None:
                least[t[i : i + 50]] = min(least.get(t[i : i + 50], r[0]), r[0])
    out = []
    for r, t in zip(rows, raw):
        gone = [False] * len(t)
        for i in range(len(t) - 49):
            first = least.get(t[i : i + 50])
            if first is not None and (r[0] is None or first < r[0]):
                gone[i : i + 50] = [True] * 50
        kept = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        if not any(gone):
            out.append(r)
        elif kept:
            out.append((r[0], kept, *r[2:4], len(kept), *r[5:]))
    return sorted(out, key=str)


def test_quality_stage(spark, planted):
    folder, rows, _ = planted
    got = pipeline.quality_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = rows_of(got)
    clean = [r for r in rows if r[1] and not r[1].startswith(("AAA", "BBB", "CCC"))]
    assert all(r in kept for r in clean) and not any(r[1] and r[1].startswith(("AAA", "BBB", "CCC")) for r in kept)


def test_each_stage_equals_brute_force(spark, planted):
    folder, rows, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    near = pipeline.near_duplicate_stage(spark, docs, folder)
    assert near.columns == docs.columns and rows_of(near) == expected_near(rows)
    kept = rows_of(near)
    cut = pipeline.repeat_stage(spark, spark.createDataFrame(kept, SCHEMA), folder)
    assert cut.schema == spark.createDataFrame([], SCHEMA).schema and rows_of(cut) == expected_cut(kept)
    assert rows_of(pipeline.repeat_stage(spark, docs, folder)) == expected_cut(rows)  # with copies still there
    clean = pipeline.decontamination_stage(spark, docs, folder)
    bad = {d for d, *_, c in brute.contamination([r[:2] for r in rows], items) if c}
    assert bad == {136, 137, 138, 139} and rows_of(clean) == sorted((r for r in rows if r[0] not in bad), key=str)


def test_whole_pipeline(spark, planted):
    folder, rows, _ = planted
    got = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    assert not set(got) & set(range(80, 130)) and not set(got) & {136, 137, 138, 139}
    assert set(range(80)) | set(range(130, 136)) <= set(got)
    want = brute.targets([(s, sum(r.size for r in got.values() if r.source == s)) for s in {r.source for r in got.values()}])
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.taken <= 2 * r.size for r in got.values())


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES])
def test_empty_documents(spark, planted, stage):
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, planted[0]).count() == 0
