import base64
import random

from sparkloom.llm import quality_rules as rules
from tests.llm import brute


def test_base_counts_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(400):
        words = [rnd.choice(["a", "b", "é#", "<c>", "d&", " "]) for _ in range(rnd.randint(0, 60))]
        text = "".join(w + rnd.choice([" ", "\n", "\t", "\x0b", " ", "\x1c"]) for w in words)
        text += rnd.choice(["", text])
        assert rules.base_counts(text) == brute.base_rules(text), repr(text)
    assert rules.base_counts(None) == (0, 0, 0, 0, 0)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.choice([2, 3, 5, 7]))) for _ in range(n)) + "."


def test_bands(spark):
    rnd = random.Random(2)
    noise = base64.b85encode(rnd.randbytes(40_000)).decode()
    spaced = " ".join(noise[i : i + 9] for i in range(0, len(noise), 9))
    stretch = " ".join(f"row {i % 3}" for i in range(6000))
    rows = [(1, prose(rnd, 300)), (2, spaced), (3, " ".join("same text again".split() * 300)), (4, prose(rnd, 2000) + " " + stretch), (5, None), (6, ""), (7, prose(rnd, 10)), (8, prose(rnd, 30_000)), (8, prose(rnd, 400))]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    got = {}
    for r in rules.judge(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    kept = {k: [r.kept for r in v] for k, v in got.items()}
    assert kept == {1: [True], 2: [False], 3: [False], 4: [False], 5: [False], 6: [False], 7: [False], 8: [True, True]}
    assert not got[2][0].base_failed and got[2][0].ratio > 0.74  # incompressible
    assert got[3][0].base_failed and got[5][0].base_failed
    assert rules.judge(df.limit(0)).count() == 0


def test_a_repetitive_stretch_is_found_by_chunks():
    rnd = random.Random(3)
    zip_ = rules.zstandard.ZstdCompressor(level=3)
    clean = prose(rnd, 4000).encode()
    ratio, share, inside = rules.compression(clean, rules.Bands(), zip_)
    assert inside and share == 0
    _, share, inside = rules.compression(clean + b"ab " * 8000, rules.Bands(), zip_)
    assert not inside and share > 0.3


def test_encoded_noise_is_outside_and_prose_inside():
    rnd = random.Random(4)
    zip_ = rules.zstandard.ZstdCompressor(level=3)
    spaced = lambda s, w: " ".join(s[i : i + w] for i in range(0, len(s), w))
    inside = lambda s: rules.compression(s.encode(), rules.Bands(), zip_)[2]
    for n in (300, 383, 500, 600, 767, 1000, 1500, 2000, 2500, 4096, 8000, 12_000, 20_000, 140_000):
        raw = rnd.randbytes(n)
        for width in (7, 9, n):
            assert not inside(spaced(base64.b64encode(raw).decode(), width)[:n]), (n, width)
            if n >= 5120:
                assert not inside(spaced(raw.hex(), 2 * width)[:n]), (n, width)
        assert not inside("".join(chr(rnd.randrange(32, 127)) for _ in range(n))), n
        assert inside(prose(rnd, n)[:n]), n
    assert not inside(prose(rnd, 9000)[:32_768] + rnd.randbytes(16_384).hex())  # half of it hexadecimal
