import random

import numpy as np
import pytest
import tokenizers

from sparkloom.llm import forced_bpe as bpe


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.PATH)


PARTS = ["a", "B", "é", "é", "Σ", "ς", "İ", "ß", "中文", "ᄒ", "ᅡ", "ᆫ", "🙂", "‍", "'s", "'S", "'ll", "'", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>",
         "\x1c", "\x85", "\xa0", " ", " ", "\n", "\t", "\x0b", "1", "２", "#!", "</w>", "the", "ing", "̇", "\x00", "ﬁ", "\x7f", "zq", "qz"]


def test_ids_equal_the_library(library):
    own, rnd = bpe.codec(bpe.PATH), random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 30_001, "中" * 20_000, "x1" * 5000, "".join(random.Random(2).choice("abcdefgh") for _ in range(60_000)), "word " * 40_000])
def test_long_words_and_texts(library, text):
    assert bpe.codec(bpe.PATH).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_certain_and_used():
    own = bpe.codec(bpe.PATH)
    words = [b"q\x00the\xff\xfe", b"the", b"x"]
    symbols, starts, at = own.fragments(words)
    assert symbols.tolist() == [*own.first[list(b"q\x00the\xff")], own.last[0xFE], *own.first[list(b"th")], own.last[ord("e")], own.last[ord("x")]]
    assert at.tolist() == [0, 7, 10] and set(at) <= set(starts) and len(starts) > 4 and 8 not in starts
    letters, spelt = bpe._letters(), [t.removesuffix("</w>") for t in own.names.to_pylist() if t and t not in own.special]
    for a in range(97, 123):
        for b in range(256):
            pair = letters[a] + letters[b]
            assert not own.inside[0, a, b] or any(pair in t for t in spelt)
            if not own.inside[:, a, b].any() and b != ord("<"):
                assert not any(pair in t for t in spelt), pair


def test_merges_of_both_kinds_agree():
    own, rnd = bpe.codec(bpe.PATH), random.Random(3)
    rows = np.full((2000, 48), -1, np.int32)
    for row in rows:
        n = rnd.randint(1, 48)
        row[:n] = own.first[[ord(rnd.choice("aeinrst")) for _ in range(n)]]
    for row, got in zip(rows, own.merge(rows)):
        want = own._merge_long(row[row >= 0].tolist())
        assert got.tolist() == want + [-1] * (48 - len(want))


def test_bounded_stores_do_not_change_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "_HELD", 3)
    own = bpe.Codec(bpe.PATH)
    text = " ".join(f"Word{i % 7} qz{i}" for i in range(200))
    assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert [own.encode([t])[0].tolist() for t in ("b c d e f", "a b", "")] == [library.encode(t, add_special_tokens=False).ids for t in ("b c d e f", "a b", "")]
    assert len(own._kept) <= 5


def test_characters_on_which_the_patterns_differ(library):
    own = bpe.Codec(bpe.PATH)
    own._odd.add("é")  # as if the library took it for something else
    assert not own._alike("é") and own._alike("ü")
    for text in ("café é1 ü's", "é<|endoftext|>é", "中é"):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_character(library):
    own = bpe.Codec(bpe.PATH)
    for lo in range(0, 0x110000, 4096):
        text = " ".join(f"a{chr(c)}b{chr(c)}1" for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000)
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, hex(lo)


def test_whole_tables(spark, library, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40)))) for i in range(300)] + [(1, None), (None, "null id"), (7, "same"), (7, "same"), (8, ""), (9, " \n "), (10, "long " * 30_000)]
    df = spark.createDataFrame([(*r, "x", [1]) for r in rows], "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    monkeypatch.setattr(bpe, "_BATCH", 1000)
    got = bpe.decode(bpe.encode(df)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=str) == sorted(want, key=str)
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0


def test_decoding_any_ids(spark, library):
    rows = [(1, [0, 49406, 49407, 518]), (2, []), (3, None), (4, [None, 5, 999_999, -1, 320]), (5, [49_405])]
    got = {r.k: r.text for r in bpe.decode(spark.createDataFrame([(*r, "old") for r in rows], "k int, ids array<int>, text string")).collect()}
    assert got == {k: None if v is None else library.decode([i for i in v if i is not None and 0 <= i < 49_408], skip_special_tokens=False) for k, v in rows}
