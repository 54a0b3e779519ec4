"""Benchmark decontamination by a prefix-filtered set join, in native DataFrame code.

A *window* is ``window`` consecutive words of a benchmark item, or all words of a
shorter item.  A document contains a window if all its words occur, in order and
without gaps.  Containment of the whole set means that any one word of the window is
a sufficient prefix, so the necessary prefix is one word:

* the words of each window are ordered by their number of occurrences in the
  documents, rarest first, and the rarest is the window's *anchor*;
* occurrences of anchors in documents are joined with windows on that word alone;
* a candidate must start and end inside the document (position and length bounds);
* candidates are verified word by word at their place.

The benchmark's vocabulary and anchors are broadcast only if their counted rows stay
below ``broadcast_rows``; else they are joined by shuffle, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters; none for NULL."""
    cut = F.split(F.translate(text.cast("string"), _UPPER, _LOWER), _BREAK)
    return F.coalesce(F.array_remove(cut, ""), F.array().cast("array<string>"))


def windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, w, n): windows of each item as space-joined words, and their number of words."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    start = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    each = F.transform(start, lambda i: F.slice("words", i + 1, F.least(F.size("words"), F.lit(window))))
    return w.select("item_id", F.explode(each).alias("own")).select("item_id", F.array_join("own", " ").alias("w"), F.size("own").alias("n")).distinct()


def _small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` (written), to be broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def scan(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = 13, broadcast_rows: int = 200_000,
) -> DataFrame:
    """(doc_id, h, n_words, hits, n_hit, items): one row per distinct document (id and text).

    ``h`` is the hash of the text; ``hits`` the verified windows as (start, n, w) in
    order; ``n_hit`` the words inside any of them; ``items`` the sorted distinct ids
    of the items they belong to.  NULL and empty texts have no words and no hits;
    NULL ids are kept; repeated rows are one row here; an empty table or benchmark
    gives an empty result or no hits.  Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), words(text).alias("words"))
    wins = materialise(windows(items, item_id_col, item_text_col, window), "windows")
    each = wins.select("w", "n").distinct().withColumn("own", F.split("w", " "))

    vocabulary = materialise(each.select(F.explode("own").alias("word")).distinct(), "vocabulary")
    met = rows.select(F.explode("words").alias("word")).join(_small(vocabulary, broadcast_rows), "word").groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    rarity = vocabulary.join(met, "word", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    placed = each.select("w", "n", F.posexplode("own").alias("at", "word")).join(materialise(rarity, "rarity"), "word")
    anchors = placed.groupBy("w", "n").agg(F.min(F.struct("f", "word", "at")).alias("a")).where("a.f > 0")
    anchors = materialise(anchors.select(F.col("a.word").alias("word"), F.col("a.at").alias("at"), "w", "n"), "anchors")

    held = rows.where(F.size("words") > 0).select("doc_id", "h", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    candidates = held.join(_small(anchors, broadcast_rows), "word").where((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("doc_id", "h", start.alias("start"), "n", "w")
    by_doc = candidates.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("start", "n", "w")).alias("found"))

    right = F.filter("found", lambda c: F.array_join(F.slice("words", c["start"] + 1, c["n"]), " ") == c["w"])
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    joined = one.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    verified = joined.select("doc_id", "h", "found", words(F.col("text")).alias("words")).select(
        "doc_id", "h", F.size("words").alias("n_words"), F.array_sort(F.coalesce(F.when(F.col("found").isNotNull(), right), F.array().cast("array<struct<start:int,n:int,w:string>>"))).alias("hits"))
    verified = materialise(verified.groupBy("doc_id", "h").agg(F.first("n_words").alias("n_words"), F.first("hits").alias("hits")), "verified")

    def cover(acc: Column, c: Column) -> Column:
        end = c["start"] + c["n"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], c["start"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    covered = F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover)["n"]
    of = verified.where(F.size("hits") > 0).select("doc_id", "h", F.explode(F.array_distinct(F.transform("hits", lambda c: c["w"]))).alias("w")).join(wins, "w")
    of = of.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = verified.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return out.select("doc_id", "h", "n_words", "hits", covered.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def verdicts(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: int = 20, **options) -> DataFrame:
    """The rows of ``docs`` as (doc_id, h, n_words, n_hit, items, contaminated), repeated rows included.

    A document is contaminated if at least one word in ``least_share`` is hit.
    """
    found = scan(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "n_words", "n_hit", "items")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    bad = (F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words"))
    return joined.select("doc_id", "h", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), "items", bad.alias("contaminated"))
