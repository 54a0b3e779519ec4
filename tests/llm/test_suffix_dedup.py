import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import suffix_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def result(df):
    return sorted((tuple(r)[:5] for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_columns_sort_suffixes():
    rnd = random.Random(3)
    for _ in range(60):
        segs = ["".join(rnd.choice("ab\x00é") for _ in range(rnd.randint(0, 9))).encode() for _ in range(rnd.randint(1, 9))]
        seg, length, common = suffix_dedup.insert_columns(segs)
        rows = [segs[s][len(segs[s]) - n :] for s, n in zip(seg.tolist(), length.tolist())]
        assert rows == sorted(rows) and len(rows) == sum(len(s) + 1 for s in segs)
        for a, b, c in zip(rows, rows[1:], common[1:].tolist()):
            assert c == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("size, alphabet, hot, seed", [(5, "ab", 1024, 1), (8, "abcé", 0, 2), (20, "abcdefgh \n", 1, 3), (50, "ab", 1024, 4)])
def test_equals_brute_force(spark, size, alphabet, hot, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(20, 150))) for _ in range(5)]
    rows = []
    for i in range(40):
        text = "".join(rnd.choice(base)[rnd.randint(0, 20) : rnd.randint(20, 150)] + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 3)))
        rows.append((rnd.choice([i, i, i // 2, None]), rnd.choice([text, text, text, None, ""])))
    rows += rows[:5]  # repeated rows
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), min_bytes=size, block_bytes=200, bucket_bytes=300, hot_blocks=hot)
    assert result(got) == brute.repeats(rows, size)


def test_long_text_and_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SLICE", 64)
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(30_000))
    rows = [(1, long[100:400]), (2, long), (3, long[20_000:20_500] + "tail"), (4, "x" * 500), (5, "x" * 300)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), min_bytes=50, block_bytes=1000)
    assert result(got) == brute.repeats(rows, 50)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    rows = [(1, "a" * 60, 7, "b"), (2, "a" * 60 + "é", 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, id string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, carry=["block", "id"]).collect()}
    assert (got[1]["block"], got[1]["id"], got[1]["kept_text"]) == (7, "b", "a" * 60)
    assert (got[2]["block"], got[2]["id"], got[2]["n_removed"], got[2]["kept_text"]) == (8, None, 60, "é")


def test_cut_inside_a_character(spark):
    rows = [(1, "x" * 49 + "é"), (2, "x" * 49 + "è")]  # the 50th byte is the first of both characters
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2]["n_removed"] == 50 and got[2]["kept_text"] == ""


def test_equal_segments_are_rows_of_the_transform():
    rnd = random.Random(8)
    plan = suffix_dedup.Plan(50, 1, 1024)
    for _ in range(20):
        anchor = bytes(rnd.choice(b"abcdef") for _ in range(plan.k))
        pool = []
        for _ in range(6):
            left, right = rnd.randint(0, 25), rnd.randint(25, 40)
            pool.append((left, bytes(rnd.choice(b"xy") for _ in range(left)) + anchor + bytes(rnd.choice(b"xy") for _ in range(min(right, 25)))))
        rows = [(rnd.randint(0, 9), *rnd.choice(pool)) for _ in range(40)]
        size = np.array([len(c) for _, _, c in rows])
        first = np.cumsum(size) - size
        data = np.frombuffer(b"".join(c for _, _, c in rows), np.uint8)
        ids = np.array([i for i, _, _ in rows])
        masks, head = suffix_dedup._repeats(data, first, first + size - 50, np.array([o for _, o, _ in rows]), ids, plan)
        held = {}
        for i, _, c in rows:
            for a in range(len(c) - 49):
                held[c[a : a + 50]] = min(i, held.get(c[a : a + 50], i))
        for j, (i, _, c) in enumerate(rows):
            assert int(masks[j]) == sum(1 << a for a in range(len(c) - 49) if held[c[a : a + 50]] < i)
            assert head[j] == next(h for h, r in enumerate(rows) if r[2] == c)


def test_many_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i // 3, text + str(i % 2)) for i in range(600)] + [(None, text)] * 5
    for hot in (0, 1024):
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), block_bytes=4000, bucket_bytes=4000, hot_blocks=hot)
        assert result(got) == brute.repeats(rows, 50)


def test_rows_begin_at_the_anchor():
    rnd = random.Random(11)
    for _ in range(60):
        ends = [(rnd.randint(1, 3), bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(0, 4)))) for _ in range(rnd.randint(1, 12))]
        number, right = np.sort([n for n, _ in ends]), [e for _, e in ends]
        order, begun = suffix_dedup._from_anchor(np.frombuffer(b"".join(right) + b"x", np.uint8), np.cumsum([0] + [len(e) for e in right[:-1]]), np.array([len(e) for e in right]), number)
        right = [(-int(number[o]), *right[o]) for o in order.tolist()]  # symbols of anchors stand for one place, their order is free
        left = [[(d << 8) + rnd.choice(b"ab\xff") + 1 for d in reversed(range(rnd.randint(0, 4)))] for _ in right]
        flat, sizes = np.array([x for part in left for x in part], np.uint16), np.array([len(part) for part in left])
        seg, length, common = suffix_dedup.insert_symbols(flat, sizes, begun)
        rows = [(*left[i][len(left[i]) - n :], *right[i]) for i, n in zip(seg.tolist(), length.tolist())]
        assert len(rows) == sum(len(part) + 1 for part in left)
        assert [r[:n] for r, n in zip(rows, length.tolist())] == sorted(r[:n] for r, n in zip(rows, length.tolist()))
        for a, b, c in zip(rows, rows[1:], common[1:].tolist()):
            assert c == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def blocks_of(texts, per_block):
    for i in range(0, len(texts), per_block):
        ids = list(range(i, min(i + per_block, len(texts))))
        yield pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array([texts[j] for j in ids]), "block": pa.array([i] * len(ids), pa.int64())})


@pytest.mark.parametrize("hot_blocks, hot", [(2, False), (0, True)])
def test_anchors_in_many_blocks_stay_whole(monkeypatch, hot_blocks, hot):
    line = " ".join(f"word{i}" for i in range(60))
    plan = suffix_dedup.Plan(50, 1, hot_blocks)
    blocks = list(blocks_of([f"{i} " + line for i in range(40)], 5))
    anchors = pa.concat_tables([suffix_dedup._send_anchors(b, plan) for b in blocks])
    codes = suffix_dedup._judge_anchors(anchors, plan)
    bits = [np.unpackbits(np.frombuffer(c, np.uint8).reshape(2, -1), axis=1) for c in codes["codes"].to_pylist()]
    # eight blocks hold each anchor, in one segment or a few: one task can take them
    assert any(b[1].any() for b in bits) == hot and any(b[0].any() for b in bits) != hot
    inserted, insert = [], suffix_dedup.insert_symbols
    monkeypatch.setattr(suffix_dedup, "insert_symbols", lambda flat, *rest: inserted.append(len(flat)) or insert(flat, *rest))
    one = codes.filter(pa.array(np.array(codes["block"].to_pylist()) == 5))
    suffix_dedup._send_segments(blocks[1], one, plan)
    # a byte is in at most two segments: hot ones are not cut into strings of 26 symbols before the block's own transform
    assert sum(inserted) <= 2 * sum(len(t) for t in blocks[1]["text"].to_pylist())


def test_found_strings_do_not_leave_the_block():
    plan, line = suffix_dedup.Plan(50, 1, 0), " ".join(f"word{i}" for i in range(30))
    block = next(blocks_of(["a" + line, line, line + "b"], 3))
    codes = suffix_dedup._judge_anchors(suffix_dedup._send_anchors(block, plan), plan)
    sent = suffix_dedup._send_segments(block, codes, plan)
    strings = {("a" + line + "b")[i : i + 50] for i in range(len(line) + 2 - 49)}
    _, unpack = suffix_dedup._packing()
    ids = unpack(sent["ids"][0].as_py(), "<i8")
    # each string leaves once, with its smallest id (single strings, as every shared anchor is hot)
    shared = strings - {("a" + line)[:50], (line + "b")[-50:]}
    assert len(shared) <= len(ids) <= len(strings) and set(unpack(sent["sizes"][0].as_py(), "<u2").tolist()) == {50}
    assert (ids == 0).sum() >= len(shared)
