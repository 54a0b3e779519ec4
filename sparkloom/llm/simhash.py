"""SimHash near-duplicates through pivot distance tables.

A fingerprint has bit b set if more than half of the shingle hashes have it set.
Pairs within ``max_bits`` differing bits are found without comparing all pairs:

* Every distinct fingerprint gets a table of Hamming distances to reference
  fingerprints (pivots).  *Block pivots* are a base pattern with one two-bit block
  inverted, so one differing bit moves the distance to exactly one of them,
  relative to the base.  *Spread pivots* are fixed pseudorandom patterns.
* Two fingerprints within ``max_bits`` bits differ in at most ``max_bits`` of the
  32 block coordinates.  The coordinates are cut into groups; all but
  ``max_bits`` groups agree, so an equality join on each choice of agreeing
  groups meets every link.  The number of groups grows with the logarithm of the
  number of fingerprints, which keeps chance meetings proportional to it.
* A met pair is discarded if a coordinate of the spread pivots differs by more
  than ``max_bits`` (triangle inequality), and survivors are verified bit by bit.
* A key shared by more than ``hot_key`` fingerprints (a dense cloud of near
  copies) is not expanded into pairs.  Fingerprints are within two bits of each
  other exactly if they share a pattern one bit away from both, so each member
  is linked to the smallest member around every such pattern: at most 65 rows a
  member and the same components.

Equal fingerprints are one node from the start.  Components come from label
propagation with hooking of roots and pointer jumping, each round written to the
shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import materialise

SEED = 42
BLOCK_BITS = 2
SPREAD_PIVOTS = 12
_PART = 1 << 15  # shingles whose bits are counted at once


def _fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = zip(*[words[i:] for i in range(shingle)]) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(g), SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _PART):
        bits = np.unpackbits(hashes[i : i + _PART].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp): hash of the text and fingerprint as a signed 64-bit number, one row per input row.

    A-Z are lower-cased; words are runs of anything but ASCII white space; shingles
    count as often as they occur; a shorter text is one shingle; NULL and empty
    texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([_fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64())], names=["doc_id", "h", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


def _patterns(count: int) -> list[int]:
    """Fixed pseudorandom 64-bit patterns."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(count)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(fp: str | Column, pattern: int) -> Column:
    c = F.col(fp) if isinstance(fp, str) else fp
    return F.bit_count(c.bitwiseXOR(F.lit(_signed(pattern)).cast("long")))


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, block, spread): for each block pivot whether it is nearer, as far, or farther than the base, and distances to the spread pivots."""
    base, *spread = _patterns(1 + SPREAD_PIVOTS)
    ones = (1 << BLOCK_BITS) - 1
    block = [(_distance("fp", base ^ (ones << at)) - _distance("fp", base)).cast("byte") for at in range(0, 64, BLOCK_BITS)]
    return fps.select("fp", F.array(*block).alias("block"), F.array(*[_distance("fp", p).cast("byte") for p in spread]).alias("spread"))


def _groups(n: int, max_bits: int) -> int:
    """Groups of coordinates such that a key tells about n fingerprints apart (1.5 bits a coordinate)."""
    coords = 64 // BLOCK_BITS
    g = max_bits + 2
    while g < coords and 1.5 * coords * (g - max_bits) / g < math.log2(max(n, 2)) + 5 and math.comb(g + 1, max_bits) <= 66:
        g += 1
    return g


def links(fps: DataFrame, max_bits: int = 2, hot_key: int = 64) -> DataFrame:
    """(a, b): pairs of distinct fingerprints with the same components as all pairs within ``max_bits`` bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits from 0 to 2: dense keys are linked through patterns one bit away")
    nodes = materialise(pivot_table(fps.select("fp").distinct()), "pivots")
    g = _groups(nodes.count(), max_bits)
    coords = 64 // BLOCK_BITS
    of = [[i for i in range(coords) if i % g == k] for k in range(g)]
    keys = []
    for chosen in combinations(range(g), g - max_bits):
        kept = [F.col("block")[i] for k in chosen for i in of[k]]
        keys.append(F.xxhash64(F.lit(",".join(map(str, chosen))), *kept))
    # chance collisions of the key hash only add candidates, which the checks discard
    keyed = nodes.select("fp", "spread", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = materialise(keyed.join(sizes, "key"), "pivotkeys")

    few = met.where(F.col("members") <= hot_key)
    a = few.select("key", F.col("fp").alias("a"), F.col("spread").alias("sa"))
    b = few.select("key", F.col("fp").alias("b"), F.col("spread").alias("sb"))
    near = a.join(b, "key").where("a < b")
    for i in range(SPREAD_PIVOTS):
        near = near.where(F.abs(F.col("sa")[i].cast("int") - F.col("sb")[i].cast("int")) <= max_bits)
    near = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")

    dense = met.where(F.col("members") > hot_key).select("fp").distinct()
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)] if max_bits == 2 else None
    if max_bits == 2:
        near = near.union(_through_hubs(dense.select("fp", F.explode(F.array(*around)).alias("hub"))))
    elif max_bits == 1:  # the even member of a pair one bit apart is the hub
        hubs = F.when(F.bit_count("fp") % 2 == 0, F.array(F.col("fp"))).otherwise(
            F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)]))
        odd = dense.select("fp", F.explode(hubs).alias("hub"))
        real = odd.join(dense.select(F.col("fp").alias("hub")), "hub", "left_semi")
        near = near.union(real.where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")))
    return near.distinct()


def _through_hubs(members: DataFrame) -> DataFrame:
    first = members.groupBy("hub").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(first, "hub").where("fp > a").select("a", F.col("fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of an edge and the smallest node it is connected with.

    Each round takes the smallest label around a node, sends it to the node's old
    label as well, so whole trees hook onto each other, and then takes the label of
    the label.  Rounds grow with the logarithm of a chain (1,000 nodes: about 10);
    it ends when nothing changes, which is when every label is the smallest.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = materialise(labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "step")
        hooks = step.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("hook"))
        step = step.join(hooks, "node", "left").select("node", "old", F.least("label", "hook").alias("label"))
        jump = step.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = step.join(jump, step.label == jump.via).select("node", "old", F.least("label", "far").alias("label"))
        new = materialise(new, "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, h, fp, label, component_id): one row per input row.

    ``label`` names the component, by its smallest fingerprint; ``component_id`` is
    the smallest id among all rows reachable over links of at most ``max_bits``
    differing bits.  Repeated rows and copies share a
    fingerprint and hence a component.  Rows with a NULL id are linked but never
    give the id; a component of such rows only has a NULL id.  An empty table
    gives an empty result; other columns are ignored.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(rows, max_bits))
    named = ids.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "label").select("fp", "label", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "h", "fp", "label", "component_id")
