"""Removal of repeated byte strings through a collection Burrows-Wheeler transform.

A byte goes if it is covered by a string of ``min_bytes`` bytes that also starts in
a document with a smaller id.  The transform of the whole collection is never
built in one place; Spark cuts it into collections of bounded size:

1.  Documents are dealt into blocks of about ``block_bytes``.  In each document the
    string starting at every byte belongs to its *anchor*, the ``k`` bytes with the
    smallest hash inside it, so equal strings have equal anchors wherever they are.
    Strings with the same anchor form a *segment* (one stretch of text).
2.  Anchors go, packed by block, to the bucket of their hash.  An anchor met in one
    document only cannot take part in a repeat; buckets answer with two bits each.
3.  A block is a collection of its own first: the transform of its segments of shared
    anchors marks what it repeats itself, and finds equal segments, of which the one
    with the smallest id goes to the bucket of the anchor.  So a passage that fills a
    block leaves it once.  Anchors met in more than ``hot_blocks`` blocks that hold more
    than 64 times as many segments leave the block as single strings dealt by their own
    hash, so no anchor is one task; only those strings leave it of which no smaller id of
    the block is known yet.  Both transforms see them.
4.  Every bucket is a collection of the segments sent, each a row with its id, equal
    ones included.  A transform is built column by column: each round inserts one
    symbol per segment, right to left, at the place that the stable order of the
    symbols (the LF mapping) gives, and updates common prefixes from range minima.
    All strings of a segment hold its anchor, so the anchor is one symbol, numbered in
    the collection, ``min_bytes`` bytes are ``window`` symbols, and no string begins
    behind the anchor: the first rows are the suffixes that begin with it.  Strings are
    equal only if the anchor stands at one place in them, so a byte and its distance from
    the anchor make the symbol, each round's rows go behind those of the rounds before,
    and the arrays of symbols and prefixes are only appended to.  The collection's size
    bounds them, and the shuffle between blocks and buckets is the
    external storage.  Runs of common prefixes of ``window`` or more are equal strings;
    the smallest id of a run decides which of them are repeats.
5.  Buckets answer every block with its verdicts and hand back what the block's own
    transform found; blocks mark bytes and cut texts.

The documents are shuffled once: the three passes over blocks share that exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sparkloom.llm.common import pieces, text_bytes

_SLICE = 1 << 15  # positions hashed at a time, small enough for the processor's cache
_COLLECTION = 1 << 17
_NONE = np.iinfo(np.int64).max  # stands for a NULL id: smaller than no other
_LOW = np.uint64((1 << 40) - 1)


class Plan:
    """Lengths and bucket count that all tasks share."""

    def __init__(self, min_bytes: int, buckets: int, hot_blocks: int):
        self.min_bytes, self.buckets, self.hot_blocks, self.hot_segments = min_bytes, buckets, hot_blocks, 64 * hot_blocks
        # Long anchors are rarely shared by chance, also in a large corpus; at most 64 strings to a segment.
        self.k = max(1, min_bytes // 2, min_bytes - 63)
        self.window = min_bytes - self.k + 1


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hash of the k bytes from each position."""
    base = 0x9E3779B97F4A7C15
    power = lambda e: np.uint64(pow(base, e, 1 << 64))
    part, size, out, have = data.astype(np.uint64), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, have = part, size
            else:
                n = len(data) - have - size + 1
                out, have = out[:n] * power(size) + part[have : have + n], have + size
        if size * 2 > k:
            break
        n = len(part) - size
        part, size = part[:n] * power(size) + part[size : size + n], size * 2
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


class Block:
    """The texts of one block as one byte array, in the order of id and text."""

    def __init__(self, table: pa.Table, plan: Plan):
        self.plan = plan
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.table = table
        self.ids = table.column("id").fill_null(_NONE).to_numpy()
        texts = table.column("text").fill_null("").cast(pa.large_binary()).combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self._segments()

    def _segments(self) -> None:
        """first, last: the strings of each segment; anchor: its key (bucket, 40 bits of hash) and place."""
        plan, data, off = self.plan, self.data, self.offsets
        n, size, k = len(data), plan.min_bytes, plan.k
        crossing = np.zeros(n + 1, np.int8)  # strings that would leave their document
        np.add.at(crossing, np.maximum(off[:-1], off[1:] - size + 1), 1)
        np.add.at(crossing, off[1:], -1)
        crossing = np.cumsum(crossing, dtype=np.int8)[:n] > 0
        firsts, places, hashes = [], [], []
        for s in range(0, n - size + 1, _SLICE):
            h = _hashes(data[s : s + _SLICE + size - 1], k)
            least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            w, have = plan.window, 1
            while have * 2 <= w:
                m = len(least) - have
                least, have = np.minimum(least[:m], least[have:]), have * 2
            if have < w:
                least = np.minimum(least[: len(least) - (w - have)], least[w - have :])
            place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            place[crossing[s : s + len(place)]] = -1
            new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            at = place[new]
            firsts.append(new + s)
            places.append(np.where(at < 0, -1, at + s))
            hashes.append(h[at])
        if not firsts:
            self.first = self.last = self.place = self.row = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        first, place, h = np.concatenate(firsts), np.concatenate(places), np.concatenate(hashes)
        new = np.r_[True, place[1:] != place[:-1]]  # a segment that goes on in the next slice
        first, place, h = first[new], place[new], h[new]
        last = np.r_[first[1:], n - size + 1] - 1
        real = place >= 0
        self.first, self.last, self.place, h = first[real], last[real], place[real], h[real]
        bucket = (h >> np.uint64(32)) % np.uint64(plan.buckets)
        self.key = (bucket << np.uint64(40)) | (h & _LOW)
        self.row = np.searchsorted(off, self.first, side="right") - 1

    def _by_key(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the segments in this order, and how many hold each key."""
        order = np.argsort(self.key, kind="stable")
        key = self.key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return key[start], order, np.diff(np.r_[start, len(key)])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, whether two ids hold the key, and how many different segments do."""
        keys, order, held = self._by_key()
        ids = self.ids[self.row[order]]
        end = np.cumsum(held) - 1
        kinds = np.ones(len(keys), np.int64)
        of = np.repeat(np.flatnonzero(held > 1), held[held > 1])
        if len(of):
            own = order[np.repeat(held > 1, held)]
            # the anchor, what begins a segment and what ends it cover the segment
            _, begins = _mixed(self.data, self.first[own], self.plan.k)
            _, ends = _mixed(self.data, self.last[own] + self.plan.min_bytes - self.plan.k, self.plan.k)
            look = begins * np.uint64(3) + ends
            by = np.lexsort((look, of))
            new = np.r_[True, (of[by][1:] != of[by][:-1]) | (look[by][1:] != look[by][:-1])]
            kinds[held > 1] = np.bincount(of[by][new], minlength=len(keys))[held > 1]
        return keys, ids[end + 1 - held] != ids[end], kinds

    def shared(self, codes: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, anchor offset, bucket) of the segments of shared anchors; bucket -1 of hot ones."""
        keys, order, held = self._by_key()
        code = np.zeros(len(keys), np.uint8)
        of = (keys >> np.uint64(40)).astype(np.int64)
        cut = np.searchsorted(of, np.unique(of), side="left").tolist() + [len(of)]
        for lo, hi in zip(cut, cut[1:]):
            bits = np.unpackbits(np.frombuffer(codes[int(of[lo])], np.uint8).reshape(2, -1), axis=1)[:, : hi - lo]
            code[lo:hi] = bits[0] + 2 * bits[1]
        mine = np.empty(len(order), np.uint8)
        mine[order] = np.repeat(code, held)
        own = np.flatnonzero(mine)
        bucket = np.where(mine[own] == 2, -1, (self.key[own] >> np.uint64(40)).astype(np.int64))
        return self.first[own], self.last[own], self.place[own] - self.first[own], bucket

    def sent(self, first: np.ndarray, last: np.ndarray, bucket: np.ndarray, masks: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first, last, bucket) of what leaves the block: segments that stand for their equals and hold a string
        that no smaller id of the block holds; of hot ones these strings alone, dealt by their own hash."""
        rest = ~masks & (~np.uint64(0) >> (63 - (last - first)).astype(np.uint64))
        heads = np.flatnonzero((head == np.arange(len(head))) & (rest > 0))
        plain, hot = heads[bucket[heads] >= 0], heads[bucket[heads] < 0]
        which, at = np.nonzero(_bits(rest[hot]))
        single = first[hot[which]] + at
        _, where = _mixed(self.data, single, self.plan.min_bytes)
        where = (where % np.uint64(self.plan.buckets)).astype(np.int64)
        return np.r_[plain, hot[which]], np.r_[first[plain], single], np.r_[last[plain], single], np.r_[bucket[plain], where]


def _bits(masks: np.ndarray) -> np.ndarray:
    return np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packing() -> tuple[Callable[[np.ndarray], bytes], Callable[[bytes, object], np.ndarray]]:
    """What packs and unpacks arrays, made once a task: for short arrays that costs more than the packing."""
    shrink, grow = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    return lambda a: shrink.compress(a.tobytes()), lambda b, kind: np.frombuffer(grow.decompress(b), kind)


def _send_anchors(table: pa.Table, plan: Plan) -> pa.Table:
    block, (pack, _) = Block(table, plan), _packing()
    keys, several, kinds = block.anchors()
    of = (keys >> np.uint64(40)).astype(np.int64)
    present, lo = np.unique(of, return_index=True)
    low = (keys & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    cut = [*lo.tolist(), len(of)]
    return pa.table({
        "bucket": pa.array(present, pa.int64()), "block": pa.array([table["block"][0].as_py()] * len(present), pa.int64()),
        "keys": pa.array([low[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
        "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
        "kinds": pa.array([pack(np.minimum(kinds[a:b], 65535).astype("<u2")) for a, b in zip(cut, cut[1:])], pa.binary()),
    })


def _judge_anchors(table: pa.Table, plan: Plan) -> pa.Table:
    """Per block two bit planes over its keys of this bucket: in two documents; in too many blocks, and in too many segments for one task."""
    keys, several, n = [], [], []
    _, unpack = _packing()
    kinds = [unpack(x, "<u2") for x in table["kinds"].to_pylist()]
    for k, s in zip(table["keys"].to_pylist(), table["several"].to_pylist()):
        five = np.frombuffer(k, np.uint8).reshape(-1, 5)
        wide = np.zeros((len(five), 8), np.uint8)
        wide[:, :5] = five
        keys.append(wide.view("<u8").ravel())
        several.append(np.unpackbits(np.frombuffer(s, np.uint8))[: len(five)])
        n.append(len(five))
    key, flag = np.concatenate(keys), np.concatenate(several)
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    blocks = np.diff(np.r_[start, len(key)])
    hot = (blocks > plan.hot_blocks) & (np.add.reduceat(np.concatenate(kinds).astype(np.int64)[order], start) > plan.hot_segments)
    shared = (blocks > 1) | (np.maximum.reduceat(flag[order], start) > 0)
    out = np.empty((2, len(key)), np.uint8)
    out[0][order] = np.repeat(shared & ~hot, blocks)
    out[1][order] = np.repeat(hot, blocks)
    cut = np.r_[0, np.cumsum(n)].tolist()
    bits = [np.packbits(out[:, a:b], axis=1).tobytes() for a, b in zip(cut, cut[1:])]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "codes": pa.array(bits, pa.binary())})


def _send_segments(left: pa.Table, right: pa.Table, plan: Plan) -> pa.Table:
    block, (pack, _) = Block(left, plan), _packing()
    codes = dict(zip(right["bucket"].to_pylist(), right["codes"].to_pylist()))
    first, last, offset, bucket = block.shared(codes)
    row_id = block.ids[np.searchsorted(block.offsets, first, side="right") - 1] if len(first) else first
    masks, head = _repeats(block.data, first, last, offset, row_id, plan)
    seg, begin, final, where = block.sent(first, last, bucket, masks, head)
    order = np.argsort(where, kind="stable")
    out = {c: [] for c in ("bucket", "codes", "equals", "inner", "sizes", "offsets", "ids", "chars")}
    size = final - begin + plan.min_bytes
    sent = where[order]
    for b in sorted({*codes, *sent.tolist()}):
        own = order[np.searchsorted(sent, b) : np.searchsorted(sent, b, side="right")]
        out["equals"].append(None if out["bucket"] else pack(np.arange(len(head)) - head))
        out["inner"].append(None if out["bucket"] else pack(masks))
        out["bucket"].append(b)
        out["codes"].append(codes.get(b))
        for name, values, kind in (("sizes", size, "<u2"), ("offsets", first[seg] + offset[seg] - begin, "<u2"), ("ids", row_id[seg], "<i8")):
            out[name].append(pack(values[own].astype(kind)))
        out["chars"].append(pack(block.data[_stretches(begin[own], size[own])]))
    made = {c: pa.array(v, pa.int64() if c == "bucket" else pa.binary()) for c, v in out.items()}
    return pa.table({"block": pa.array([left["block"][0].as_py() if len(left) else right["block"][0].as_py()] * len(made["bucket"]), pa.int64()), **made})


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one behind the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def insert_columns(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise construction: (segment, suffix length, common prefix with the row before), rows in suffix order."""
    return insert_symbols(np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + np.uint16(1), np.array([len(s) for s in segments], np.int64))


def insert_symbols(flat: np.ndarray, sizes: np.ndarray, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``insert_columns``, of segments of unsigned symbols above 0 one behind the other; 0 ends a segment.

    The first rows are the empty suffixes, or with ``begun`` what stands behind the
    segments already: in the order of the segments, with these common prefixes, and
    beginning with a symbol below all others.  The columns are allocated once at their
    final length and filled from the front.  A round whose symbols are above all earlier
    ones goes behind the rows and moves none of them.  Which suffix a row is follows from
    the finished transform, by going backwards through all segments at once.
    """
    m, kind = len(sizes), flat.dtype.type
    flat = np.append(flat, kind(0))
    ends, longest, total = np.cumsum(sizes), int(sizes.max(initial=0)), int(sizes.sum()) + m
    most = longest + (0 if begun is None else int(begun.max(initial=0)))
    sym, common = np.zeros(total, kind), np.zeros(total + 1, np.uint8 if most < 255 else np.uint16)
    if begun is not None:
        common[:m] = begun
    sym[:m] = np.where(sizes > 0, flat[np.maximum(ends - 1, 0)], 0)
    fresh, n = np.flatnonzero(sym[:m]), m  # rows whose symbol has yet to be inserted before their suffix
    owner = fresh
    # The LF mapping as a sorted list of (symbol, row): entry t is the row that row m + t extends by a symbol.
    low = np.int64((1 << 32) - 1)
    mapping = np.zeros(total - m, np.int64)
    for j in range(1, longest + 1):
        if not len(fresh):
            break
        order = np.argsort(sym[fresh], kind="stable")
        new, seg = (sym[fresh].astype(np.int64) << 32 | fresh)[order], owner[order]
        end, more = n + len(new), sizes[seg] > j
        fill = flat[np.where(more, ends[seg] - 1 - j, len(flat) - 1)]
        if n == m or new[0] >> 32 > mapping[n - m - 1] >> 32:
            up = np.r_[False, new[1:] >> 32 == new[:-1] >> 32]
            common[n] = 0  # range minima may look one row past the end
            prefix = np.zeros(len(new), common.dtype)
            prefix[up] = 1 + _range_min(common[: n + 1], new[:-1][up[1:]] & low, new[up] & low)
            sym[n:end], common[n:end], mapping[n - m : end - m] = fill, prefix, new
            fresh, owner, n = np.arange(n, end)[more], seg[more], end
            continue
        back = np.empty(len(order), np.int64)  # the new entries by row, the last one first
        back[order] = np.arange(len(order))
        back = back[::-1]
        rank = np.searchsorted(mapping[: n - m], new) + np.arange(len(new))
        old = np.ones(end - m, bool)
        old[rank] = False
        merged = np.empty(end - m, np.int64)
        merged[old], merged[rank] = mapping[: n - m], new
        before, after = merged[np.maximum(rank - 1, 0)], merged[np.minimum(rank + 1, end - m - 1)]
        up, down = (rank > 0) & (before >> 32 == new >> 32), (rank + 1 < end - m) & (after >> 32 == new >> 32)
        up, down = back[up[back]], back[down[back]]
        common[n] = 0
        prefix = np.zeros(len(rank), common.dtype)
        prefix[up] = 1 + _range_min(common[: n + 1], before[up] & low, new[up] & low)
        following = 1 + _range_min(common[: n + 1], new[down] & low, after[down] & low)
        for column, values in ((sym, fill), (common, prefix)):
            kept = column[m:n].copy()
            column[m:end][old] = kept
            column[m:end][rank] = values
        common[m + rank[down] + 1] = following
        moved = np.zeros(n, np.int64)  # how far the insertion moved each row
        moved[m:] = np.flatnonzero(old) - np.arange(n - m)
        mapping[: end - m] = merged + moved[merged & low]
        fresh, owner, n = m + rank[more], seg[more], end
    place = np.empty(total, np.int64)
    place[mapping & low] = np.arange(m, total)
    row, length = np.zeros(total, np.int64), np.zeros(total, np.int64)
    row[:m] = own = at = np.arange(m)
    for j in range(1, longest + 1):
        left = sym[at] > 0
        own, at = own[left], place[at[left]]
        row[at], length[at] = own, j
    return row, length, common[:-1]


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low + 1 : high + 1]) for each pair, low < high.

    No pair may begin behind the end of the one before it: then what lies between two costs nothing.
    """
    if not len(low):
        return np.zeros(0, values.dtype)
    pairs = np.empty(2 * len(low), np.int64)
    pairs[::2], pairs[1::2] = low + 1, high + 1
    return np.minimum.reduceat(values, pairs)[::2]


def _mixed(data: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` bytes from each start as words, and a hash of them."""
    wide = np.zeros((len(start), -(-size // 8) * 8), np.uint8)
    if len(start):
        wide[:, :size] = np.lib.stride_tricks.sliding_window_view(data, size)[start]
    words = wide.view(np.uint64)
    mixed = np.zeros(len(start), np.uint64)
    for column in words.T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return words, mixed


def _by_anchor(words: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows of words stand together, and in this order whether a row begins a new one."""
    order = np.argsort(mixed, kind="stable")
    new = lambda a: np.r_[True, (a[1:] != a[:-1]).any(axis=1)]
    begins = new(words[order])
    if (begins[1:] & (mixed[order][1:] == mixed[order][:-1])).any():  # two anchors of one hash
        order = np.lexsort(words.T)
        begins = new(words[order])
    return order, begins


def _from_anchor(data: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin with an anchor, of this number, and the common prefix of each with the one before.

    They stand in every string of their segment, so those that begin behind the anchor need not be rows: what follows the
    anchor, ``size`` bytes from ``start``, is sorted column by column from the right, the end before all bytes.
    """
    step = np.arange(int(size.max(initial=0)))[:, None]
    columns = np.where(step < size, data[np.minimum(start + step, len(data) - 1)].astype(np.uint16) + np.uint16(1), np.uint16(0))
    order = np.lexsort((*columns[::-1], number.astype(np.uint16 if number[-1] < 1 << 16 else np.uint32)))
    columns, number = columns[:, order], number[order]
    same = np.vstack([number[1:] == number[:-1], (columns[:, 1:] == columns[:, :-1]) & (columns[:, 1:] > 0)])
    return order, np.r_[0, np.logical_and.accumulate(same).sum(axis=0)]


def _repeats(data: np.ndarray, first: np.ndarray, last: np.ndarray, offset: np.ndarray, ids: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """For each segment a mask of its strings that a segment of a smaller id also holds, and the first segment equal to it.

    A segment alone with its anchor holds no string of another one; the others form
    collections of whole anchors, small enough to stay in the processor's cache.
    """
    masks, head = np.zeros(len(first), np.uint64), np.arange(len(first))
    if not len(first):
        return masks, head
    order, begins = _by_anchor(*_mixed(data, first + offset, plan.k))
    start = np.flatnonzero(begins)
    several = np.diff(np.r_[start, len(order)]) > 1
    inside = several[np.cumsum(begins) - 1]
    among, begins = order[inside], begins[inside]
    size = last[among] - first[among] + plan.window  # in symbols
    start = np.flatnonzero(begins)
    held, cut = np.cumsum(size), [0]
    while cut[-1] < len(among):  # whole anchors, until a collection is full
        full = np.searchsorted(held, held[cut[-1]] - size[cut[-1]] + _COLLECTION)
        nth = np.searchsorted(start, full, side="right")
        cut.append(int(start[nth]) if nth < len(start) else len(among))
    for lo, hi in zip(cut, cut[1:]):
        own, n = among[lo:hi], size[lo:hi]
        order, begun = _from_anchor(data, first[own] + offset[own] + plan.k, n - offset[own] - 1, np.cumsum(begins[lo:hi]))
        own, n = own[order], n[order]
        left = offset[own]
        ahead = np.repeat(np.cumsum(left), left) - np.arange(left.sum()) - 1
        flat = (ahead << 8).astype(np.uint16) + data[_stretches(first[own], left)] + np.uint16(1)
        seg, length, common = insert_symbols(flat, left, begun)
        length += (n - left)[seg]
        equal = common >= plan.window
        run = np.flatnonzero(~equal)
        smallest = np.minimum.reduceat(ids[own][seg], run)[np.cumsum(~equal) - 1]
        hit = np.flatnonzero((smallest < ids[own][seg]) & (length >= plan.window))
        np.bitwise_or.at(masks, own[seg[hit]], np.uint64(1) << (n[seg[hit]] - length[hit]).astype(np.uint64))
        other = np.r_[True, (length[1:] != length[:-1]) | (common[1:] != length[1:])]
        whole = np.flatnonzero(length == n[seg])
        of = np.cumsum(other)[whole]
        run = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        head[own[seg[whole]]] = np.repeat(np.minimum.reduceat(own[seg[whole]], run), np.diff(np.r_[run, len(whole)]))
    return masks, head


def _judge_segments(table: pa.Table, plan: Plan) -> pa.Table:
    pack, unpack = _packing()
    columns = {c: table[c].to_pylist() for c in ("sizes", "offsets", "ids", "chars")}
    whole = lambda c, kind: [unpack(x, kind) for x in columns.pop(c)]
    sizes = whole("sizes", "<u2")
    cut = np.cumsum([0, *map(len, sizes)]).tolist()
    size, offset = np.concatenate(sizes).astype(np.int64), np.concatenate(whole("offsets", "<u2")).astype(np.int64)
    first = np.cumsum(size) - size
    masks, _ = _repeats(np.concatenate(whole("chars", np.uint8)), first, first + size - plan.min_bytes, offset, np.concatenate(whole("ids", "<i8")), plan)
    return pa.table({
        "block": table["block"], "bucket": table["bucket"], "codes": table["codes"], "equals": table["equals"], "inner": table["inner"],
        "masks": pa.array([pack(masks[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()),
    })


def _cut(left: pa.Table, right: pa.Table, plan: Plan, schema: pa.Schema, carried: list[str]) -> pa.Table:
    if not len(left):
        return schema.empty_table()
    block, (_, unpack) = Block(left, plan), _packing()
    reply = {b: x for b, *x in zip(*[right[c].to_pylist() for c in ("bucket", "codes", "equals", "inner", "masks")])}
    first, last, _, bucket = block.shared({b: x[0] for b, x in reply.items() if x[0] is not None})
    n, size = len(block.data), plan.min_bytes
    marks = np.zeros(n + 1, np.int32)
    if len(first):
        ahead, inner = next(x[1:3] for x in reply.values() if x[1] is not None)
        head, masks = np.arange(len(first)) - unpack(ahead, np.int64), unpack(inner, np.uint64).copy()
        seg, begin, _, where = block.sent(first, last, bucket, masks, head)
        found = np.zeros(len(first), np.uint64)
        order = np.argsort(where, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(where[order]) != 0, True]) if len(where) else np.zeros(1, np.int64)
        for lo, hi in zip(cut[:-1], cut[1:]):
            own = order[lo:hi]
            np.bitwise_or.at(found, seg[own], unpack(reply[int(where[own[0]])][3], np.uint64) << (begin[own] - first[seg[own]]).astype(np.uint64))
        masks |= found[head]
        part = np.flatnonzero(masks)
        which, at = np.nonzero(_bits(masks[part]))
        np.add.at(marks, first[part[which]] + at, 1)
        np.add.at(marks, first[part[which]] + at + size, -1)
    gone = np.cumsum(marks[:n]) > 0
    off = block.offsets
    begins = gone & ~np.r_[False, gone[:-1]] if n else gone
    begins[off[:-1][off[:-1] < n]] = gone[off[:-1][off[:-1] < n]]
    upto = lambda a: np.r_[0, np.cumsum(a)]
    removed, spans = upto(gone), upto(begins)
    kept_at = off - removed[off]
    kept = block.data[~gone].tobytes()
    texts = [kept[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist())]
    columns = [block.table["id"], pa.array(np.diff(off), pa.int64()), pa.array(np.diff(removed[off]), pa.int64()), pa.array(np.diff(spans[off]), pa.int64()),
               pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t.decode("utf-8", "ignore") for t in texts], pa.string()), *[block.table[c] for c in carried]]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50, carry: Iterable[str] = (),
    block_bytes: int = 2 << 20, bucket_bytes: int = 16 << 20, hot_blocks: int = 1024,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, and the columns ``carry``), one row per input row.

    The digest is that of the remaining bytes; where a cut falls inside a character,
    ``kept_text`` leaves out what is left of that character.  A NULL
    text is empty.  Rows with the same id never remove bytes from each other; a
    NULL id counts as larger than all others.  An empty table gives an empty
    result.  Carried columns keep their names behind those of the operator, which
    they must not repeat.
    """
    carry = list(carry)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    total = text_bytes(docs, text_col)
    blocks = pieces(total, block_bytes)
    plan = Plan(min_bytes, min(pieces(total, bucket_bytes), 1 << 24), hot_blocks)
    own = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(o) for c, o in zip(carry, own)])
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))

    anchors = dealt.groupBy("block").applyInArrow(lambda t: _send_anchors(t, plan), "bucket long, block long, keys binary, several binary, kinds binary")
    codes = anchors.groupBy("bucket").applyInArrow(lambda t: _judge_anchors(t, plan), "block long, bucket long, codes binary")
    segments = dealt.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(
        lambda a, b: _send_segments(a, b, plan), "block long, bucket long, codes binary, equals binary, inner binary, sizes binary, offsets binary, ids binary, chars binary")
    verdicts = segments.groupBy("bucket").applyInArrow(
        lambda t: _judge_segments(t, plan), "block long, bucket long, codes binary, equals binary, inner binary, masks binary")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string", *[f"{o} {kinds[o]}" for o in own]])
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    cut = dealt.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(lambda a, b: _cut(a, b, plan, arrow, own), schema)
    return cut.select(*names, *[F.col(o).alias(c) for c, o in zip(carry, own)])
