"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

UPPER_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(docs, size):
    """[(id, bytes, removed, spans, digest)] for [(id, text)]."""
    least = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, t in raw:
        for i in range(len(t) - size + 1):
            if d is not None:
                w = t[i : i + size]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            first = least.get(t[i : i + size])
            if first is not None and (d is None or first < d):
                gone[i : i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def fingerprint(text, shingle=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(UPPER_LOWER).encode())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(points, linked):
    """Smallest reachable index for each point."""
    label = list(range(len(points)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if linked(points[i], points[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(points))]


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER_LOWER))


def contamination(docs, items, window=13):
    """[(id, n_words, n_hit, items, contaminated)]."""
    wins = {}
    for item, text in items:
        w = benchmark_words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = benchmark_words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                own = wins.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def base_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in lines
            lines.add(line)
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets of [(source, size)], excess reshared until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size, fixed, left = dict(order), {}, share * sum(n for _, n in order)
    while True:
        free = [s for s in size if s not in fixed]
        total = sum(weight[s] for s in free)
        now = {s: (left - sum(fixed.values())) * weight[s] / total for s in free}
        above = [s for s in free if now[s] > cap * size[s]]
        if not above:
            return fixed | now
        fixed |= {s: cap * size[s] for s in above}
        if len(fixed) == len(size):
            return fixed
