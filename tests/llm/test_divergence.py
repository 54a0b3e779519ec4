import random
import re
from collections import Counter

import numpy as np

from sparkloom.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, part string, value long, g long, n long"


def brute(rows, min_docs=10, top=10):
    read = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)), lang or "", source or "") for _, t, lang, source in rows]
    out = []
    for lang in {r[1] for r in read}:
        own = [r for r in read if r[1] == lang]
        docs = Counter(w for r in own for w in set(r[0]))
        kept = [w for w in docs if docs[w] >= min_docs]

        def shares(texts):
            n = Counter(w for t in texts for w in t if docs[w] >= min_docs)
            total = sum(n.values())
            return n, {w: 1 + 1_000_000_000 * (n[w] + 2) // (total + 2 * len(kept)) for w in kept}

        _, q = shares([r[0] for r in own])
        groups = {s: shares([r[0] for r in own if r[2] == s]) for s in {r[2] for r in own}}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s, (n, p) in groups.items():
            pair = [(sum(f(p[w], groups[o][1][w]) for w in kept), o) for o in groups if o != s]
            term = [(f(p[w], q[w]), w) for w in kept if n[w] > 0 and p[w] > q[w]]
            for part, found, cut in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:cut], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def corpus(seed, sources, n):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "été", "中文", "zug", "a", "ß", "ﬁn", "𝒳", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = []
    for i in range(n):
        lang, source = rnd.choice(["en", "de", None, ""]), rnd.choice(sources)
        text = rnd.choice([None, "", "1 2 3", *[" ".join(rnd.choices(words, weights=range(len(words), 0, -1), k=rnd.randint(1, 60))) + "," + source[-1:] for _ in range(9)]]) if source else "x1y Z"
        rows.append((i, text, lang, source))
    return rows + [(1, "same Same", "en", "s0")] * 40


def test_equals_brute_force(spark):
    rows = corpus(1, ["s0", "s0", "s0", "s1", "s2", "é", "", None, "s9"], 700)
    got = sorted(map(tuple, divergence.audit(frame(spark, rows).repartition(5)).collect()))
    assert got == brute(rows) and len({r[0] for r in got}) == 3


def test_size_of_blocks_does_not_matter(spark):
    rows = corpus(2, [f"s{i}" for i in range(7)], 300)
    want = brute(rows, 3, 4)
    for block, terms in ((1, 2), (3, 5), (100, 100_000)):
        got = divergence.audit(frame(spark, rows), min_docs=3, top=4, group_block=block, slice_terms=terms)
        assert sorted(map(tuple, got.collect())) == want


def test_few_rows(spark):
    assert divergence.audit(frame(spark, [(1, None, None, None)]).limit(0)).count() == 0
    rows = [(1, "only few", "en", "a"), (2, "words", "en", "b"), (None, None, None, None)]  # no term in ten rows
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_tasks_pass_counts_on_early(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD", 3)
    rows = corpus(3, ["s0", "s1", "s2"], 150)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows).coalesce(2), min_docs=2).collect())) == brute(rows, 2)


def test_product_equals_dense_matrices():
    rnd = np.random.default_rng(5)
    a, b = (rnd.random((60, c)) < 0.2 for c in (9, 13))
    (ra, ca), (rb, cb) = np.nonzero(a), np.nonzero(b)
    i, j, v = divergence.product(ra, ca, rb, cb, 13)
    out = np.zeros((9, 13), int)
    out[i, j] = v
    assert (out == a.T.astype(int) @ b.astype(int)).all() and (v > 0).all()


def test_blocks_hold_every_joint_table():
    """Inclusion and exclusion over level zero equals the sum over all terms."""
    rnd = random.Random(6)
    for _ in range(50):
        p = [[rnd.randint(1, 10**9) for _ in range(8)] for _ in range(2)]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        zero = [rnd.randint(1, 10**6) for _ in range(2)]
        on = [{t for t in range(8) if rnd.random() < 0.6} for _ in range(2)]
        at = lambda g, t: p[g][t] if t in on[g] else zero[g]
        whole = sum(f(at(0, t), at(1, t)) for t in range(8))
        parts = sum(f(p[0][t], zero[1]) for t in on[0]) + sum(f(zero[0], p[1][t]) for t in on[1]) + (8 - len(on[0]) - len(on[1])) * f(zero[0], zero[1])
        parts += sum(f(p[0][t], p[1][t]) - f(p[0][t], zero[1]) - f(zero[0], p[1][t]) + f(*zero) for t in on[0] & on[1])
        assert whole == parts
