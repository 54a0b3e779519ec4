"""Multilingual mixture inference: which languages a text mixes, and in what shares.

Every language is a distribution over hashed byte trigrams, learned from labelled
texts with additive smoothing.  A text is a draw from a mixture of languages whose
proportions are fitted by expectation-maximisation.  The set of languages is chosen
by penalised likelihood, forward: start with the single most likely one, add the
language with the steepest likelihood gain, refit, and keep it if the gain exceeds
``penalty * log(number of grams)``.  The likelihood is concave in the proportions, so
a gain is at most its slope: texts for which that bound already stays below the
penalty need no iteration, exactly.

The model has ``2 ** GRAM_BITS`` numbers per language, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM_BITS = 16
GRAMS = 1 << GRAM_BITS
UNKNOWN = "und"
_CLEAN = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalpha():
        _CLEAN[_b] = 32
_PARTS = 64
_HELD = 64  # languages whose counts a task holds before it passes them on


def _grams(text: str) -> np.ndarray:
    """Hashed trigrams of the bytes of the lower-cased text; all ASCII but letters is space, spaces alone count nothing."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    b = _CLEAN[raw].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code[code != np.uint32(0x202020)]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # [language, gram]


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Counts over all given rows; rows with a NULL text or language are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush():
            names = [n for n in held for _ in range(_PARTS)]
            parts = [p.tobytes() for c in held.values() for p in c.reshape(_PARTS, -1)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([i for _ in held for i in range(_PARTS)], pa.int32()), pa.array(parts, pa.binary())], names=["lang", "part", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if lang not in held and len(held) == _HELD:
                    yield flush()
                    held.clear()
                held.setdefault(lang, np.zeros(GRAMS, np.int64))
                held[lang] += np.bincount(_grams(text.as_py()), minlength=GRAMS)
        if held:
            yield flush()

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(GRAMS // _PARTS, np.int64)
        for p in t["n"]:
            total += np.frombuffer(p.as_py(), np.int64)
        return pa.table({"lang": t["lang"][:1], "part": t["part"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    kind = "lang string, part int, n binary"
    given = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    got = given.mapInArrow(count, kind).groupBy("lang", "part").applyInArrow(add, kind).orderBy("lang", "part").collect()
    languages = sorted({r[0] for r in got})
    counts = np.array([np.frombuffer(r[2], np.int64) for r in got], float).reshape(len(languages), GRAMS) + smoothing
    return Model(languages, np.log(counts) - np.log(counts.sum(axis=1, keepdims=True)))


def _mixtures(grams: list[np.ndarray], logs: np.ndarray, penalty: float, tolerance: float = 1e-5) -> np.ndarray:
    """Proportions [text, language] of the chosen sets; every text has at least one gram.

    Each text is iterated until its own proportions move by less than ``tolerance``, so
    they do not depend on the texts beside it.
    """
    docs, langs = len(grams), len(logs)
    counted = [np.unique(g, return_counts=True) for g in grams]
    sizes = np.array([len(u) for u, _ in counted])
    gram = np.concatenate([u for u, _ in counted])
    times = np.concatenate([c for _, c in counted]).astype(float)
    start = np.r_[0, np.cumsum(sizes)[:-1]]
    total = np.add.reduceat(times, start)
    limit = penalty * np.log(total + 1)
    like = logs[:, gram]
    single = np.add.reduceat(like * times, start, axis=1)
    best = single.argmax(axis=0)
    share = np.zeros((docs, langs))
    share[np.arange(docs), best] = 1
    fitted = single.max(axis=0)
    # likelihoods relative to the best language of the text, so nothing underflows
    prob = np.exp(np.clip(like - like[np.repeat(best, sizes), np.arange(len(gram))], -50, 50))
    open_ = np.arange(docs)
    while langs > 1 and len(open_):
        rows = np.concatenate([np.arange(start[d], start[d] + sizes[d]) for d in open_])
        own, at = sizes[open_], np.r_[0, np.cumsum(sizes[open_])[:-1]]
        p, t = prob[:, rows], times[rows]
        mixed = (np.repeat(share[open_].T, own, axis=1) * p).sum(axis=0)
        slope = np.add.reduceat(p / mixed * t, at, axis=1) - total[open_]
        slope[share[open_].T > 0] = -np.inf
        gain, add = slope.max(axis=0), slope.argmax(axis=0)
        on = gain > limit[open_]
        if not on.any():
            break
        take = np.repeat(on, own)
        p, t, chosen, add = p[:, take], t[take], open_[on], add[on]
        own = own[on]
        at = np.r_[0, np.cumsum(own)[:-1]]
        trial = share[chosen] * 0.7
        trial[np.arange(len(chosen)), add] = 0.3
        moving, q, u, size, first = np.arange(len(chosen)), p, t, own, at
        while len(moving):
            part = np.repeat(trial[moving].T, size, axis=1) * q
            new = (np.add.reduceat(part / part.sum(axis=0) * u, first, axis=1) / total[chosen[moving]]).T
            more = np.abs(new - trial[moving]).max(axis=1) >= tolerance
            trial[moving] = new
            if not more.all():
                grams_left = np.repeat(more, size)
                moving, q, u, size = moving[more], q[:, grams_left], u[grams_left], size[more]
                first = np.r_[0, np.cumsum(size)[:-1]]
        mixed = (np.repeat(trial.T, own, axis=1) * p).sum(axis=0)
        value = np.add.reduceat(np.log(mixed) * t, at) + single.max(axis=0)[chosen]
        better = value - fitted[chosen] > limit[chosen]
        open_ = chosen[better]
        share[open_], fitted[open_] = trial[better], value[better]
    return share


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 4.0, batch_grams: int = 1 << 18) -> DataFrame:
    """(doc_id, lang_pred, score, languages, shares): one row per input row.

    ``lang_pred`` is the language with the largest share and ``score`` that share.
    A NULL text, a text without a letter, and every text if no language was learned
    give ``und`` with score 0 and no languages.  Long texts enter whole, as counts of
    distinct grams.  Repeated rows are judged one by one; other columns are ignored.
    """
    languages, logs = model.languages, model.logs
    room = max(1 << 12, batch_grams // max(1, len(languages)))
    schema = "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>"

    def rows(ids, grams):
        known = [i for i, g in enumerate(grams) if g is not None]
        share = _mixtures([grams[i] for i in known], logs, penalty) if known else np.zeros((0, len(languages)))
        pred, score, names, parts = [UNKNOWN] * len(ids), [0.0] * len(ids), [[] for _ in ids], [[] for _ in ids]
        for i, s in zip(known, share):
            top = np.argsort(-s, kind="stable")[: np.count_nonzero(s)]
            pred[i], score[i] = languages[top[0]], float(min(1.0, s[top[0]]))
            names[i], parts[i] = [languages[k] for k in top], s[top].tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))],
            names=["doc_id", "lang_pred", "score", "languages", "shares"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, grams, held = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                ids.append(i)
                grams.append(_grams(text) if text and languages and any(map(str.isalpha, text)) else None)
                held += 0 if grams[-1] is None else len(grams[-1])
                if held >= room:
                    yield rows(ids, grams)
                    ids, grams, held = [], [], 0
            if ids:
                yield rows(ids, grams)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def identify_with_own_labels(docs: DataFrame, usable: Column, **options) -> DataFrame:
    """Learn from the rows of ``docs`` that meet ``usable`` and identify all of them."""
    return identify(docs, learn(docs.where(usable)), **options)
