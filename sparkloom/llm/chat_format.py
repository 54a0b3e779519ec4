"""Chat formatting at token level.

Every turn is escaped and encoded on its own, so no token spans a border between
content and template; reserved ids, which the tokenizer never gives, are spliced
around it.  Masks are running sums of the signed lengths of the segments.

Template (``<s>`` once, before the first turn):

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  text</s>
    any other  [ROLE]role[/ROLE]text</s>

A control string inside a text or role gets a backslash after its first character,
one more if it already has some; reading takes one away.  So texts come back as
they were, and formatted text holds a control string only where the template put it.

Output is one row per turn with the number of tokens before it, so a conversation of
any length is never one value: its rows are sorted and read in order.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
BOS, EOS, INST, INST_END, SYS, SYS_END, ROLE, ROLE_END = range(len(CONTROLS))
_FRAMES = {"system": (SYS, SYS_END), "user": (INST, INST_END)}


def _controls(change):
    """Apply ``change`` to the backslashes between first character and rest of each control string."""
    found = [(re.compile(re.escape(c[0]) + r"(\\*)(?=" + re.escape(c[1:]) + ")"), c[0]) for c in CONTROLS]

    def run(text: str) -> str:
        if "<" not in text and "[" not in text:  # no control string can begin
            return text
        for pattern, first in found:
            text = pattern.sub(lambda m, f=first: f + change(m[1]), text)
        return text

    return run


escape = _controls(lambda s: s + "\\")
unescape = _controls(lambda s: s[1:])


@dataclass(frozen=True)
class Tokenizer:
    """A file of byte-level BPE ranks, at the same path on every executor, and its pattern."""

    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    # fixed value: the pattern that belongs to the vocabulary
    pattern: str = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    reserved: int = 60_000  # reserved ids start here, above all ids of the file


@lru_cache(maxsize=2)
def _load(t: Tokenizer) -> tiktoken.Encoding:
    with open(t.path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= t.reserved:
        raise ValueError("reserved ids overlap the vocabulary")
    return tiktoken.Encoding("own", pat_str=t.pattern, mergeable_ranks=ranks, special_tokens={})


_LONG = 1 << 16
_CUT = re.compile(r"(?<=\S) (?=\S)")  # a single space always begins a new piece of the pattern


def _encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The tokenizer's ids; long texts in stretches that end where its pattern cuts anyway, so its memory stays bounded."""
    out, at = [], 0
    while len(text) - at > _LONG and (cut := _CUT.search(text, at + _LONG)):
        out += enc.encode_ordinary(text[at : cut.start()])
        at = cut.start()
    return out + enc.encode_ordinary(text[at:] if at else text)


def segments(role: str | None, text: str | None) -> list[tuple[int | str, bool]]:
    """A turn as controls (numbers) and escaped contents (strings), each with whether the loss covers it."""
    role, content = role or "", escape(text or "")
    if role in _FRAMES:
        start, end = _FRAMES[role]
        return [(start, False), (content, False), (end, False)]
    if role == "assistant":
        return [(content, True), (EOS, False)]
    return [(ROLE, False), (escape(role), False), (ROLE_END, False), (content, False), (EOS, False)]


def assemble(parts: Iterable[tuple[int | str, bool]], enc: tiktoken.Encoding, reserved: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of a turn: contents encoded one by one, controls as reserved ids, mask by prefix sums."""
    ids = [[reserved + p] if isinstance(p, int) else _encode(enc, p) for p, _ in parts]
    ends = np.cumsum([len(i) for i in ids])
    edges = np.zeros(int(ends[-1]) + 1, np.int8)
    for (_, loss), own, end in zip(parts, ids, ends):
        if loss:
            edges[end - len(own)] += 1
            edges[end] -= 1
    return np.fromiter((i for own in ids for i in own), np.int32, int(ends[-1])), np.cumsum(edges[:-1], dtype=np.int8)


def _ordered(df: DataFrame, *order: str | Column) -> DataFrame:
    return df.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", *order)


def format_turns(conversations: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(conv_id, n, first_token, ids, loss, formatted): one row per turn, ``n`` from 0 in the order of turns.

    ``first_token`` is the number of tokens of the conversation before the turn.  Rows
    with equal turns follow by role and text; a NULL turn comes last; a NULL text or
    role is empty; NULL conversation ids are one conversation; an empty table gives
    an empty result; other columns are ignored.  Encoding runs before the shuffle, on
    all tasks; placing only adds up lengths, so a long conversation costs no memory.
    """
    reserved = tokenizer.reserved

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _load(tokenizer)
        for b in batches:
            ids, loss = [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3)):
                i, m = assemble(segments(role, text.as_py()), enc, reserved)
                ids.append(i)
                loss.append(m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int8()))],
                                             names=["conv_id", "turn", "role", "text", "ids", "loss"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, before = object(), 0, 0
        for b in batches:
            number, first, ids, loss, shown = [], [], [], [], []
            for conv, i, m, role, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), b.column(4)):
                i, m = np.asarray(i.values), np.asarray(m.values)
                s = "".join([CONTROLS[p] if isinstance(p, int) else p for p, _ in segments(role, text.as_py())])
                if conv != last:
                    last, n, before = conv, 0, 0
                    i, m, s = np.r_[np.int32(reserved + BOS), i].astype(np.int32), np.r_[np.int8(0), m].astype(np.int8), CONTROLS[BOS] + s
                number.append(n)
                first.append(before)
                ids.append(i)
                loss.append(m)
                shown.append(s)
                n, before = n + 1, before + len(i)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(number, pa.int64()), pa.array(first, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int8())), pa.array(shown, pa.string())],
                names=["conv_id", "n", "first_token", "ids", "loss", "formatted"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role"), empty("text"))
    encoded = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids array<int>, loss array<tinyint>")
    return _ordered(encoded, F.asc_nulls_last("turn"), "role", "text").select("conv_id", "ids", "loss", "role", "text").mapInArrow(
        place, "conv_id long, n long, first_token long, ids array<int>, loss array<tinyint>, formatted string")


def read_turn(ids: np.ndarray, enc: tiktoken.Encoding, reserved: int) -> tuple[str, str]:
    """(role, text) of one formatted turn, from its tokens alone."""
    at = np.flatnonzero(ids >= reserved)
    controls = (ids[at] - reserved).tolist()
    pieces = [enc.decode_bytes(p[p < reserved].tolist()).decode("utf-8", "surrogatepass") for p in np.split(ids, at)]
    if controls[:1] == [BOS]:
        controls, pieces = controls[1:], pieces[1:]
    for role, frame in _FRAMES.items():
        if tuple(controls) == frame:
            return role, unescape(pieces[1])
    if controls == [EOS]:
        return "assistant", unescape(pieces[0])
    if controls == [ROLE, ROLE_END, EOS]:
        return unescape(pieces[1]), unescape(pieces[2])
    raise ValueError(f"not a turn: controls {controls}")


def digests(turns: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """Read formatted turns back: (conv_id, n_turns, n_tokens, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Texts come from decoded tokens, the text under the loss mask from the tokens the
    mask covers.  One pass over each conversation's rows in order, with running hashes.
    """
    reserved = tokenizer.reserved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, state, done = _load(tokenizer), None, []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([d[i] for d in done], k) for i, k in enumerate([pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string(), pa.int64()])],
                names=["conv_id", "n_turns", "n_tokens", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close():
            conv, n, tokens, whole, chars, loss, shown = state
            done.append((conv, n, tokens, whole.hexdigest(), chars, loss.hexdigest(), shown))

        for b in batches:
            for conv, i, m, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                if state is None or conv != state[0]:
                    if state is not None:
                        close()
                    state = [conv, 0, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = np.asarray(i.values), np.asarray(m.values)
                role, text = read_turn(ids, enc, reserved)
                masked = unescape(enc.decode_bytes(ids[mask > 0].tolist()).decode("utf-8", "surrogatepass"))
                state[1] += 1
                state[2] += len(ids)
                state[3].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[4] += len(masked)
                state[5].update(masked.encode("utf-8", "surrogatepass"))
                state[6] += len(s.as_py())
            if done:
                yield flush()
                done.clear()
        if state is not None:
            close()
            yield flush()

    schema = "conv_id long, n_turns long, n_tokens long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _ordered(turns.select("conv_id", "ids", "loss", "formatted", "n"), "n").select("conv_id", "ids", "loss", "formatted").mapInArrow(run, schema)
