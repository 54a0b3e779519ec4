"""Compression bands: zstandard ratios of whole texts and of fixed chunks.

Text that compresses far better than prose is repetitive, text that hardly
compresses is noise (keys, encoded data).  How well prose compresses depends on
its length, so each length class has its own limits.  A text is rejected if its
own ratio leaves the band of its length, or if chunks whose ratio leaves theirs
make up more than ``max_bad_share`` of it (a long text can hide a repetitive
stretch), or longer chunks above their limit do (or a stretch of noise).  The compressor sees at most one text or chunk at a time.

The upper limits lie between prose and encoded data: above all documents of the
check tables that pass the base rules and above windows of free licence texts,
below Base64 in words of seven letters or more and, from 5120 bytes on, below
hexadecimal digits.  Shorter runs of digits compress like prose (0.61 at 300
bytes, 0.52 at 2500) and are kept; under 256 bytes prose and Base64 overlap too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """(from bytes, least ratio, greatest ratio) by length; shorter texts than the first are not judged."""

    limits: tuple[tuple[int, float, float], ...] = (
        (256, 0.30, 0.84), (384, 0.30, 0.79), (512, 0.28, 0.745), (768, 0.28, 0.71), (1024, 0.26, 0.655), (1536, 0.26, 0.62), (2048, 0.24, 0.59),
        (3072, 0.24, 0.55), (4096, 0.24, 0.53), (5120, 0.24, 0.507), (8192, 0.20, 0.507), (16384, 0.20, 0.495), (65536, 0.16, 0.495),
        (131073, 0.16, 0.54),  # more than one block of the compressor
    )
    chunk: int = 4096
    noise_chunk: int = 8192  # long enough to tell hexadecimal digits from prose
    max_bad_share: float = 0.3
    level: int = 3

    def of(self, size: int) -> tuple[float, float]:
        low, high = 0.0, float("inf")
        for least, a, b in self.limits:
            if size >= least:
                low, high = a, b
        return low, high


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words covered by windows of ``window`` words that occur at least twice, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    have, distinct = 1, len(number)
    while have < window:  # exact codes of ever longer runs of words
        step = min(have, window - have)
        paired = code[: len(code) - step] * distinct + code[step:]
        order = np.argsort(paired, kind="stable")
        new = np.r_[False, paired[order][1:] != paired[order][:-1]]
        if not (~new[1:]).any():
            return 0
        ranks = np.cumsum(new)
        code = np.empty(len(paired), np.int64)
        code[order] = ranks
        have, distinct = have + step, int(ranks[-1]) + 1
    twice = np.bincount(code)[code] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[: len(code)] += twice
    edges[window : window + len(code)] -= twice
    return int(np.count_nonzero(np.cumsum(edges)[:n]))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACE):
            seen.add(line)
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), again, repeat_words(words)


def compression(raw: bytes, bands: Bands, zip_: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """(ratio of the whole, share of bytes in chunks outside their band, inside the bands)."""
    if not raw:
        return 0.0, 0.0, True

    def outside(part: bytes) -> tuple[float, bool]:
        ratio = len(zip_.compress(part)) / len(part)
        low, high = bands.of(len(part))
        return ratio, not low <= ratio <= high

    ratio, bad = outside(raw)
    share = 0.0
    view = memoryview(raw)
    if len(raw) > bands.chunk:
        wrong = 0
        for i in range(0, len(raw), bands.chunk):
            part = view[i : i + bands.chunk]
            wrong += len(part) * outside(part)[1]
        share = wrong / len(raw)
    if len(raw) > bands.noise_chunk:
        wrong = 0
        for i in range(0, len(raw), bands.noise_chunk):
            part = view[i : i + bands.noise_chunk]
            wrong += len(part) * (outside(part)[0] > bands.of(len(part))[1])
        share = max(share, wrong / len(raw))
    return ratio, share, not bad and share <= bands.max_bad_share


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands(),
    min_words: int = 20, max_repeat_percent: int = 30,
) -> DataFrame:
    """One row per input row: counts, compression ratio, bad share, base_failed and kept.

    NULL and empty texts have no words and fail the base rules; repeated rows are
    judged one by one; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                counts = base_counts(text)
                failed = counts[0] < min_words or 100 * counts[4] > max_repeat_percent * counts[0]
                ratio, share, inside = compression(text.encode("utf-8", "surrogatepass"), bands, zip_)
                rows.append((*counts, ratio, share, failed, not failed and inside))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2)]],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "bad_share", "base_failed", "kept"])

    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "ratio double, bad_share double, base_failed boolean, kept boolean")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
