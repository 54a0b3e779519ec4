"""How the sources of a language differ in the terms they use, in exact whole numbers.

A kept term stands in each group (a language's source) at a level: the number of its
occurrences there.  With one indicator column for every (group, level), terms as rows,
the product of the transposed indicators with the indicators holds the joint table of
every two groups: how many terms stand at level a in one and at level b in the other.
All a sum over terms needs is these tables and the price of each cell.

The product is made in blocks: a slice of the terms times a block of groups times a
block of groups, as sparse matrices of ones.  Level zero has no ones; what it adds
follows from the levels of each group alone, by inclusion and exclusion.  So work grows
with the occurrences of kept terms in groups, and the size of a block bounds a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import materialise

SCALE = 1_000_000_000
_HELD = 1 << 18  # terms a task counts before it passes them on

# ASCII letters in lower case, bytes of other letters as they are, all else a space
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and of characters beyond ASCII."""
    return text.encode().translate(_FOLDED).split()


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and documents; an empty term marks a group that occurs."""

    def rows(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (occur, within) in counts.items():
            words = list(occur)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(words) + 1)), pa.array([source] * (len(words) + 1)), pa.array([b"", *words], pa.binary()).cast(pa.string()),
                 pa.array([0, *occur.values()], pa.int64()), pa.array([0, *[within[w] for w in words]], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = {}, 0
        for b in batches:
            for text, *group in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                group = tuple(group)
                if group not in counts:
                    counts[group] = Counter(), Counter()
                occur, within = counts[group]
                found, before = terms(text.as_py()), len(occur)
                occur.update(found)
                within.update(set(found))
                held += len(occur) - before
                if held > _HELD:
                    yield from rows(counts)
                    counts, held = {}, 0
        yield from rows(counts)

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    return read.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: str, total: str) -> Column:
    return F.expr(f"1 + ({SCALE}BD * cast({count} + 2 as decimal(20,0))) div cast({total} + 2 * v as decimal(20,0))")


def _price(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same of whole numbers below 2^31."""
    d = p - q
    return d * d // (p + q)


def product(rows_a: np.ndarray, cols_a: np.ndarray, rows_b: np.ndarray, cols_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transpose of one indicator matrix times another, both given by the places of their ones: row, column and value of its cells.

    ``rows_b`` ascends; columns of the second matrix are below ``width``.
    """
    low, high = np.searchsorted(rows_b, rows_a, "left"), np.searchsorted(rows_b, rows_a, "right")
    many = high - low
    at = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    cells, times = np.unique(np.repeat(cols_a, many) * width + cols_b[at], return_counts=True)
    return cells // width, cells % width, times


def _block(t: pa.Table) -> pa.Table:
    """Sums over one block of what its cells cost beyond level zero: (lang, g, h, part), g < h."""
    left = t["side"].to_numpy() == t["a"][0].as_py()
    term = t["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    g, n, p, zero = (t[c].to_numpy() for c in ("g", "n", "p", "zero"))
    # one column for each (group, level)
    _, first, column = np.unique(np.stack([g, n]), axis=1, return_index=True, return_inverse=True)
    column = column.ravel()
    order = np.argsort(term, kind="stable")
    same = t["a"][0].as_py() == t["b"][0].as_py()
    a, b = (order, order) if same else (order[left[order]], order[~left[order]])
    i, j, times = product(term[a], column[a], term[b], column[b], len(first))
    i, j = first[i], first[j]
    keep = g[i] < g[j]
    i, j, times = i[keep], j[keep], times[keep]
    extra = times * (prices(p[i], p[j]) - prices(p[i], zero[j]) - prices(zero[i], p[j]) + prices(zero[i], zero[j]))
    groups, at = np.unique(np.stack([g[i], g[j]]), axis=1, return_inverse=True)
    part = np.zeros(groups.shape[1], np.int64)
    np.add.at(part, at.ravel(), extra)
    return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(part), pa.string()), "g": groups[0], "h": groups[1], "part": part})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10, top: int = 10, group_block: int = 32, slice_terms: int = 4096) -> DataFrame:
    """(lang, source, part, item, value, rank).

    A language keeps the terms of at least ``min_docs`` of its rows.  Part ``pair``: the
    divergence of a source from each other source of its language, over all kept terms.
    Part ``term``: the kept terms that the source uses more than its language does, the
    ``top`` of them.  Ranks descend by value, ties ascend by item in UTF-8.

    NULL text, language and source are empty strings, so NULL and empty are one group;
    repeated rows count each; groups without a term have pairs but no terms; without a
    kept term all pairs are 0; an empty table gives an empty result; other columns are
    ignored.  Only the output holds all pairs of a language's sources.
    """
    # one shuffle: all counts of a term meet where its groups, its total and its documents are added up
    counts = count_terms(docs, text_col, lang_col, source_col).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    counts = counts.withColumn("all", F.sum("n").over(term)).withColumn("docs", F.sum("docs").over(term))
    found = materialise(counts.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs"), "terms")

    # a few numbers per group and language
    real = F.col("term") != ""
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if(real).alias("distinct"))
    langs = found.groupBy("lang", "term").agg(F.max("all").alias("all")).groupBy("lang").agg(F.sum("all").alias("lang_size"), F.count_if(real).alias("v"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    groups = materialise(totals.join(langs, "lang").withColumn("g", number).withColumn("zero", F.when(F.col("v") > 0, _share("0", "size"))), "groups")

    cells = found.where(real).join(groups.drop("distinct"), ["lang", "source"]).withColumn("p", _share("n", "size"))
    own = cells.withColumn("q", _share("all", "lang_size")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _price("p", "q").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # the product of levels, block by block
    spots = cells.select("lang", "term", "g", "n", "p", "zero", F.floor((F.col("g") - 1) / group_block).alias("side"), F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / slice_terms)).alias("slice"))
    blocks = groups.groupBy("lang").agg(F.floor((F.max("g") - 1) / group_block).alias("last"))
    spots = spots.join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).drop("last")
    spots = spots.withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other")).drop("other")
    beyond = spots.groupBy("lang", "slice", "a", "b").applyInArrow(lambda key, t: _block(t), "lang string, g long, h long, part long")

    # every group with each other as if that one had no kept term, by the levels of the first
    levels = cells.groupBy("lang", "g", "n").agg(F.count(F.lit(1)).alias("times"), F.first("p").alias("p"))
    others = groups.select("lang", F.col("g").alias("h"), F.col("zero").alias("zero_h"))
    alone = levels.join(others, "lang").where("g <> h").withColumn("part", F.col("times") * _price("p", "zero_h"))
    alone = alone.select("lang", F.least("g", "h").alias("low"), F.greatest("g", "h").alias("high"), "part").groupBy("lang", "low", "high").agg(F.sum("part").alias("part"))
    alone = alone.withColumnsRenamed({"low": "g", "high": "h"})

    two = [groups.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("g", "source", "distinct", "zero")], *(["v"] if x == "a" else [])) for x in "ab"]
    both = two[0].join(two[1], "lang").where("g_a < g_b").withColumnsRenamed({"g_a": "g", "g_b": "h"})
    both = both.withColumn("part", F.when(F.col("v") > 0, (F.col("v") - F.col("distinct_a") - F.col("distinct_b")) * _price("zero_a", "zero_b")).otherwise(F.lit(0)))
    value = both.select("lang", "g", "h", "part").unionByName(alone).unionByName(beyond).groupBy("lang", "g", "h").agg(F.sum("part").alias("value"))
    named = both.select("lang", "g", "h", "source_a", "source_b").join(value, ["lang", "g", "h"])
    ends = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = named.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(own)
