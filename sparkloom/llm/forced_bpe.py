"""Byte-pair encoding with forced boundaries.

A merge joins two neighbouring symbols into a token of the vocabulary, so no merge
crosses a pair of symbols that stands in no token: such a pair is a certain cut.  The
pairs come from the merges themselves (every token spelt in base symbols), the texts
are cut there, each fragment is encoded on its own, and the ids are strung together.

Cuts are made in three steps: special tokens cut a text, the pattern of the file cuts
what lies between them into words, forbidden pairs cut words into fragments.  All new
words of a batch are one stream of symbols, cut at once, and their short fragments are
merged side by side, one merge of each per round.  Words are kept by each worker with
their ids, up to a bound.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH = "/opt/tokenizers/word_bpe_49k.json"

# fixed value: the pattern of the vocabulary
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")  # the same in lower-case ASCII
_WIDE = regex.compile(_PATTERN)
_SHORT, _HELD = 48, 1 << 18  # symbols of fragments merged side by side, words kept at once
_BATCH = 1 << 20  # letters encoded at once


def _letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if it shows, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(shown)))
    return [out[b] for b in range(256)]


class Codec:
    """A vocabulary file of word-final byte-pair encoding, its merges and its certain cuts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"] is None or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is no byte-level BPE file with plain merges")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that are not matched as they are")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        library = tokenizers.Tokenizer.from_file(path)
        self._normalise = library.normalizer.normalize_str if library.normalizer else str
        self._split = library.pre_tokenizer.pre_tokenize_str
        patterns = [p["pattern"].get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        changes = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self._known = patterns == [_PATTERN] and changes == ["NFC", "Replace", "Lowercase"]
        self._agreed: set[str] = set()
        self._odd: set[str] = set()
        letters = _letters()
        self._bytes = {c: i for i, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._specials = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

        spelt: dict[int, tuple[int, ...]] = {}
        self.ranks: dict[tuple[int, int], int] = {}
        self.new: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.new.append(vocab[a + b])
        made = set(self.new)
        spelt.update((i, (i,)) for i in vocab.values() if i not in made)
        for (a, b), rank in self.ranks.items():  # in the order of ranks, so parts come first
            spelt.setdefault(self.new[rank], spelt[a] + spelt[b])
        self.first = np.array([vocab[c] for c in letters], np.int32)  # base symbol of each byte, inside and at the end of a word
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        #: for pairs of bytes, the second inside or at the end of a word: whether they stand side by side in some token; any other pair is a certain cut
        self.inside = np.zeros((2, 256, 256), bool)
        byte = {int(i): (0, b) for b, i in enumerate(self.first)} | {int(i): (1, b) for b, i in enumerate(self.last)}
        for s in spelt.values():
            for x, y in zip(s, s[1:]):
                self.inside[byte[y][0], byte[x][1], byte[y][1]] = True
        pairs = np.array([(a << 32) + b for a, b in self.ranks], np.int64)
        order = np.argsort(pairs)
        self._pairs, self._pair_ranks, self._new = pairs[order], np.arange(len(pairs), dtype=np.int32)[order], np.array(self.new, np.int32)

        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        self._kept: dict[str, bytes] = {}

    def fragments(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base symbols, starts of fragments, starts of words) of words strung together, cut at every pair that stands in no token."""
        stream = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        final = np.zeros(len(stream), np.int8)
        final[ends - 1] = 1
        cut = np.ones(len(stream), bool)
        cut[1:] = (final[:-1] == 1) | ~self.inside[final[1:], stream[:-1], stream[1:]]
        return np.where(final == 1, self.last[stream], self.first[stream]), np.flatnonzero(cut), np.r_[0, ends[:-1]]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) + b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._pair_ranks[at], len(self.new)).astype(np.int32)

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """Merges of many fragments in the order of rank, then place: a row each, filled up with -1."""
        ids = ids.copy()
        none, columns = len(self.new), np.arange(ids.shape[1] - 1)
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        open_ = np.arange(len(ids) if len(columns) else 0)
        while len(open_):
            r = ranks[open_]
            at = r.argmin(axis=1)
            best = r[np.arange(len(r)), at]
            go = best < none
            open_, r, at, best = open_[go], r[go], at[go], best[go]
            x, n = ids[open_], np.arange(len(open_))
            behind = columns > at[:, None]
            x[:, :-1] = np.where(behind, x[:, 1:], x[:, :-1])
            x[:, -1] = -1
            x[n, at] = self._new[best]
            r[:, :-1] = np.where(behind[:, :-1], r[:, 1:], r[:, :-1])
            r[:, -1] = none
            r[n, at] = self._rank(x[n, at], x[n, at + 1])
            left = np.flatnonzero(at)
            r[left, at[left] - 1] = self._rank(x[left, at[left] - 1], x[left, at[left]])
            ids[open_], ranks[open_] = x, r
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same of one long fragment through a heap, so its time grows with its length and its logarithm."""
        ranks, size = self.ranks, len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= size or ids[j] != b:
                continue  # one of the two has merged meanwhile
            ids[i], ids[j] = self.new[rank], -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                if (pair := (ids[i], ids[k])) in ranks:
                    heapq.heappush(heap, (ranks[pair], i, *pair))
            h = before[i]
            if h >= 0 and (pair := (ids[h], ids[i])) in ranks:
                heapq.heappush(heap, (ranks[pair], h, *pair))
        return [i for i in ids if i >= 0]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words as 32-bit numbers."""
        symbols, starts, word_starts = self.fragments([w.encode() for w in words])
        sizes = np.diff(np.r_[starts, len(symbols)])
        flat = np.full(len(symbols), -1, np.int32)  # the ids of a fragment from its start on
        for low, high in ((0, 8), (8, 16), (16, _SHORT)):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(own):
                at = starts[own, None] + np.arange(high)
                there = np.arange(high) < sizes[own, None]
                flat[at[there]] = self.merge(np.where(there, symbols[np.minimum(at, len(symbols) - 1)], -1))[there]
        for i in np.flatnonzero(sizes > _SHORT):
            ids = self._merge_long(symbols[starts[i] : starts[i] + sizes[i]].tolist())
            flat[starts[i] : starts[i] + len(ids)] = ids
        kept = flat >= 0
        ids, ends = flat[kept], np.r_[np.cumsum(kept)[word_starts[1:] - 1], kept.sum()].tolist()
        return {w: ids[a:b].tobytes() for w, a, b in zip(words, [0, *ends], ends)}

    def _alike(self, text: str) -> bool:
        """Whether the pattern means the same here and in the library for all characters of a text; each is asked once."""
        new = set(text) - self._agreed
        for c in new:
            kind = "letter" if regex.match(r"\p{L}", c) else "number" if regex.match(r"\p{N}", c) else "space" if regex.match(r"\s", c) else "other"
            # a letter joins the letter before, all but spaces and numbers join the sign behind
            want = {"letter": [(0, 2), (2, 3)], "number": [(0, 1), (1, 2), (2, 3)], "space": [(0, 1), (2, 3)], "other": [(0, 1), (1, 3)]}[kind]
            (self._agreed if [at for _, at in self._split(f"a{c}#")] == want else self._odd).add(c)
        return not self._odd or self._odd.isdisjoint(new)

    def words(self, text: str) -> list[str]:
        """The words that the normaliser and the pattern of the file make of a text without special tokens."""
        if self._known and text.isascii():
            return _ASCII.findall(text.lower())
        text = self._normalise(text)
        if self._known and self._alike(text):
            return _WIDE.findall(text)
        own = self._bytes
        return [bytes(map(own.__getitem__, w)).decode() for w, _ in self._split(text) if w]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts: list[list[bytes | list[str]]] = []  # of each text: ids of special tokens, and words between them
        for text in texts:
            own, at = [], 0
            for m in self._specials.finditer(text) if self._specials else ():
                own += [self.words(text[at : m.start()]), np.array([self.special[m[0]]], "i4").tobytes()]
                at = m.end()
            parts.append([*own, self.words(text[at:] if at else text)])
        held = self._kept
        new = {w for own in parts for p in own if isinstance(p, list) for w in p if w not in held}
        if len(held) + len(new) > _HELD:
            used = {w for own in parts for p in own if isinstance(p, list) for w in p if w in held}
            self._kept = held = {w: held[w] for w in used}
        if new:
            held.update(self._learn(list(new)))
        return [np.frombuffer(b"".join([p if isinstance(p, bytes) else b"".join([held[w] for w in p]) for p in own]), "i4") for own in parts]

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        flat = lists.flatten()
        known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.names))), False)
        words = self.names.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
        here = pc.is_valid(words).to_numpy(zero_copy_only=False)
        before = np.r_[0, np.cumsum(here)]
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
        parts = pa.LargeListArray.from_arrays(pa.array(before[ends], pa.int64()), words.filter(pa.array(here)).cast(pa.large_string()))
        text = pc.binary_join(parts, pa.scalar(" ", pa.large_string()))
        return pc.if_else(pc.is_valid(lists), text, pa.scalar(None, pa.large_string())).cast(pa.string())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])], pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str = PATH, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, one row per input row.

    As the tokenizers library encodes without added special tokens: those that stand
    in a text are found as they are written.  A NULL or empty text, and one of white
    space only, has no ids.  Repeated rows and NULL ids are rows like others, an empty
    table gives an empty result, other columns are ignored.  ``path`` must exist on
    every executor.  ``decoded`` adds ``text``, decoded from the ids, in the same pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)

        def batch(names, rows):
            ids = _lists(rows)
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "ids": ids} | ({"text": own.decode(ids)} if decoded else {}))

        for b in batches:
            names, texts, held = [], [], 0
            for i, t in zip(b.column(0), b.column(1)):
                names.append(i.as_py())
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held >= _BATCH:
                    yield batch(names, own.encode(texts))
                    names, texts, held = [], [], 0
            if names:
                yield batch(names, own.encode(texts))

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, ids array<int>" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, path: str = PATH, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with the decoded ``text``: the names of the tokens, as a file without a decoder gives them, joined by spaces.

    NULL ids and ids that the vocabulary does not hold are left out; a NULL list has a
    NULL text, an empty one an empty text.  A column ``text`` of the input is replaced.
    """
    kept = [c for c in encoded.columns if c != "text"]
    schema = encoded.select(*kept).schema.add("text", "string")
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, codec(path).decode(b.column(at))], names=[*kept, "text"])

    return encoded.select(*kept).mapInArrow(run, schema)
