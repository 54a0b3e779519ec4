"""Corpus-level text operators.

Nothing is enumerated per pair of documents or words: scores of classifiers are
sums over the terms a document really has, plus one constant per class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkloom.functions import textfn
from sparkloom.operators.joins import lookup_default
from sparkloom.operators.sequence import dense_key, top_n_per_group
from sparkloom.runtime import cut_lineage, join_keys, materialise



def doc_terms(docs: DataFrame, doc: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """Long ``(doc, term, count)`` triplets of whole texts.

    A text is counted in its own row, so terms are not shuffled; only documents of
    several rows, found by their keys alone, are added up across rows.
    """
    keys = [doc, *(keep or [])]
    rows = docs.select(*keys, text)
    again = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows"), "repeated")
    if again.isEmpty():
        return _row_terms(rows, keys, text)
    parts = _row_terms(join_keys(rows, again, keys, "left_semi"), keys, text)
    merged = parts.groupBy(*keys, "term").agg(F.sum("count").alias("count"))
    return _row_terms(join_keys(rows, again, keys, "left_anti"), keys, text).unionByName(merged)


def _row_terms(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The distinct words of each row with their counts, batch by batch."""
    def run(batches):
        for b in batches:
            spots = b.column("_w")
            if not len(spots.flatten()):
                continue
            words = spots.flatten().dictionary_encode()
            found = pc.list_parent_indices(spots).to_numpy().astype("int64") * len(words.dictionary) + words.indices.to_numpy()
            pairs, n = np.unique(found, return_counts=True)
            row, term = (pa.array(x) for x in np.divmod(pairs, len(words.dictionary)))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(row) for k in keys], words.dictionary.take(term), pa.array(n)], names=[*keys, "term", "count"])

    schema = StructType([*rows.select(*keys).schema, StructField("term", StringType()), StructField("count", LongType())])
    return rows.select(*keys, textfn.words(F.col(text)).alias("_w")).mapInArrow(run, schema)


def count_kmers(docs: DataFrame, text: str, k: int) -> DataFrame:
    """k-mers inside single lines with their counts."""
    one_line = docs.select(F.explode(textfn.lines(F.col(text))).alias("line"))
    tokens = one_line.select(textfn.words(F.col("line")).alias("t"))
    grams = tokens.select(F.explode(textfn.kmers(F.col("t"), k)).alias("kmer"))
    return grams.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def top_kmers(docs: DataFrame, text: str, k: int, n: int) -> DataFrame:
    return count_kmers(docs, text, k).orderBy(F.desc("n"), "kmer").limit(n)


def mentions_per_token(docs: DataFrame, user: str, text: str, least: int) -> DataFrame:
    """Tokens with the number of distinct users who wrote them, if at least ``least``."""
    pairs = docs.select(user, F.explode(F.array_distinct(textfn.tokenize_social(F.col(text)))).alias("token")).distinct()
    return pairs.groupBy("token").agg(F.count(F.lit(1)).alias("n_users")).filter(F.col("n_users") >= least)


def relative_popularity(docs: DataFrame, user: str, mapping: DataFrame, group: str, default, text: str, least: int, n: int) -> DataFrame:
    """Per group the tokens most over-represented against all users; ``mapping`` gives a user's group.

    Texts are cut before anything is joined, and users meet their group as distinct
    (user, token) pairs.

    log2(users of the group / users overall), among tokens with enough users;
    every group is ranked in the same pass.
    """
    pairs = docs.select(user, F.explode(F.array_distinct(textfn.tokenize_social(F.col(text)))).alias("token")).distinct()
    pairs = lookup_default(pairs, mapping.withColumnRenamed(user, "_user"), user, "_user", group, default)
    per_group = pairs.groupBy("token", group).agg(F.count(F.lit(1)).alias("n_group"))
    # One entry per group and token, so the list is as short as the list of groups.
    by_token = per_group.groupBy("token").agg(F.sum("n_group").alias("n_all"), F.collect_list(F.struct(group, "n_group")).alias("g"))
    scored = by_token.filter(F.col("n_all") >= least).select("token", "n_all", F.inline("g")).withColumn(
        "popularity", F.log2(F.col("n_group") / F.col("n_all")))
    return top_n_per_group(scored, [group], [F.desc("popularity"), F.col("token")], n)


def most_common(terms: DataFrame, n: int) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "term").limit(n)


def token_lists(docs: DataFrame, text: str) -> DataFrame:
    """Texts cut into words once, for steps that read them several times: one array ``t`` per row."""
    return materialise(docs.select(textfn.words(F.col(text)).alias("t")), "tokens")


def most_common_words(tokens: DataFrame, n: int) -> DataFrame:
    """The most frequent words, counted by word with partial sums."""
    counts = tokens.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "term").limit(n)


def context_counts(tokens: DataFrame, vocabulary: DataFrame, contexts: DataFrame, reach: int = 2) -> DataFrame:
    """How many occurrences of a word have a context word within ``reach`` positions; ``tokens`` holds arrays ``t``.

    Each position yields its few neighbours directly from the token array; no
    table of positions is joined with itself.
    """
    def around(w, i):
        before = F.slice("t", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)))
        after = F.slice("t", i + 2, F.lit(reach))
        return F.struct(w.alias("word"), F.array_distinct(F.concat(before, after)).alias("near"))

    spots = tokens.select(F.explode(F.transform("t", around)).alias("s")).select("s.word", "s.near")
    spots = spots.join(vocabulary.select(F.col("term").alias("word")), "word", "left_semi")
    pairs = spots.select("word", F.explode("near").alias("context"))
    pairs = pairs.join(contexts.select(F.col("term").alias("context")), "context", "left_semi")
    return pairs.groupBy("word", "context").agg(F.count(F.lit(1)).alias("n"))


def ppmi(counts: DataFrame) -> DataFrame:
    """max(0, log10(p(c|w) / p(c))) of sparse (word, context, n) counts.

    The counts are bounded by vocabulary times contexts and used four times.
    """
    counts = cut_lineage(counts)
    rows = counts.groupBy("word").agg(F.sum("n").alias("row_n"))
    cols = counts.groupBy("context").agg(F.sum("n").alias("col_n"))
    total = counts.agg(F.sum("n")).scalar()
    joined = counts.join(rows, "word").join(cols, "context")
    ratio = (F.col("n") / F.col("row_n")) / (F.col("col_n") / total)
    return joined.select("word", "context", "n", F.greatest(F.lit(0.0), F.log10(ratio)).alias("ppmi"))


def remove_stopwords(terms: DataFrame, stop: list[str]) -> DataFrame:
    """Triplets without stop words; the vocabulary is numbered anew from 1."""
    kept = terms.filter(~F.col("term").isin(stop))
    return kept.join(dense_key(kept, ["term"], "word_id"), "term")


def tfidf(terms: DataFrame, doc: str, max_features: int, stop: list[str]) -> DataFrame:
    """tf * (ln((1 + n) / (1 + df)) + 1) on the most frequent terms, L2-normalised."""
    clean = terms.filter(~F.col("term").isin(stop))
    features = clean.groupBy("term").agg(F.sum("count").alias("_c"), F.count(F.lit(1)).alias("_df")).orderBy(
        F.desc("_c"), "term").limit(max_features)
    n_docs = terms.select(doc).distinct().agg(F.count(F.lit(1))).scalar()
    weighted = clean.join(features, "term").withColumn("_w", F.col("count") * (F.log((1 + n_docs) / (1 + F.col("_df"))) + 1))
    # A document has at most max_features rows here, so the window is bounded.
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc)))
    return weighted.select(doc, "term", (F.col("_w") / norm).alias("tfidf"))


def _score_terms(test: DataFrame, seen: DataFrame, doc: str, label: str, weight: Column, classes: list[tuple]) -> DataFrame:
    """score = base of the class + sum over terms of count * weight.

    ``classes`` lists ``(label, base, weight of a term the class never saw)``.  The
    weights of a term become one column per class, so a single join and a single
    grouping score all classes at once; terms outside the vocabulary add nothing.
    """
    one = seen.groupBy("term").agg(*[F.coalesce(F.max(F.when(F.col(label) == c, weight)), F.lit(float(missing))).alias(f"_w{i}")
                                     for i, (c, _, missing) in enumerate(classes)])
    sums = test.join(one, "term", "left").groupBy(doc).agg(*[
        (F.lit(float(base)) + F.coalesce(F.sum(F.col("count") * F.col(f"_w{i}")), F.lit(0.0))).alias(f"_s{i}")
        for i, (_, base, _) in enumerate(classes)])
    scores = F.array(*[F.struct(F.col(f"_s{i}").alias("score"), F.lit(c).alias("label")) for i, (c, _, _) in enumerate(classes)])
    return sums.select(doc, F.array_max(scores).alias("m")).select(doc, F.col("m.label").alias("predicted"), F.col("m.score").alias("score"))


def _label_counts(train: DataFrame, label: str, n: Column) -> DataFrame:
    """(label, term, n): as large as the vocabulary, read by several later steps.  A NULL label is no class."""
    return materialise(train.dropna(subset=[label]).groupBy(label, "term").agg(n.alias("n")), "label-counts")


def multinomial_nb(train: DataFrame, test: DataFrame, train_docs: DataFrame, doc: str, label: str) -> DataFrame:
    """Naive Bayes on term counts with add-one smoothing.

    ``train`` holds (doc, label, term, count), ``test`` (doc, term, count); terms
    outside the training vocabulary carry no evidence.  Priors count documents.
    """
    counts = _label_counts(train, label, F.sum("count"))
    vocabulary = counts.select("term").distinct().count()
    docs = {r[label]: r.n for r in train_docs.dropna(subset=[label]).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {r[label]: r.n for r in counts.groupBy(label).agg(F.sum("n").alias("n")).collect()}
    n_docs = sum(docs.values())
    classes = [(c, math.log(docs[c] / n_docs), -math.log(total[c] + vocabulary)) for c in sorted(total)]
    floors = F.create_map(*[F.lit(x) for c, _, missing in classes for x in (c, missing)])
    return _score_terms(test, counts, doc, label, F.log(F.col("n") + 1) + floors[F.col(label)], classes)


def bernoulli_nb(train: DataFrame, test: DataFrame, train_docs: DataFrame, doc: str, label: str) -> DataFrame:
    """Naive Bayes on presence and absence with (n + 1) / (docs + 2) smoothing.

    The score of an empty document is summed once per class; a present term only
    adds the difference between its presence and its absence.
    """
    counts = _label_counts(train, label, F.count(F.lit(1)))
    vocabulary = counts.select("term").distinct().count()
    docs = {r[label]: r.n for r in train_docs.dropna(subset=[label]).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_docs = sum(docs.values())
    size = F.create_map(*[F.lit(x) for c, n in docs.items() for x in (c, n)])
    p = (F.col("n") + 1) / (size[F.col(label)] + 2)
    classes = []
    for r in counts.groupBy(label).agg(F.sum(F.log(1 - p)).alias("absent"), F.count(F.lit(1)).alias("n_seen")).collect():
        p0 = 1 / (docs[r[label]] + 2)
        base = math.log(docs[r[label]] / n_docs) + r.absent + (vocabulary - r.n_seen) * math.log(1 - p0)
        classes.append((r[label], base, math.log(p0) - math.log(1 - p0)))
    present = test.select(doc, "term", F.lit(1).alias("count"))
    return _score_terms(present, counts, doc, label, F.log(p) - F.log(1 - p), sorted(classes))


def word_counts_total(docs: DataFrame, text: str) -> DataFrame:
    """Lines, words and characters of the whole corpus."""
    t = F.col(text)
    return docs.agg(F.sum(F.size(textfn.lines(t)).cast("bigint")).alias("n_lines"),
                    F.sum(F.size(F.regexp_extract_all(t, F.lit(r"[^\s]+"), F.lit(0))).cast("bigint")).alias("n_words"),
                    F.sum(F.length(t).cast("bigint")).alias("n_chars"))


def reassemble_fragments(fragments: DataFrame, key: str, offset: str, text: str) -> DataFrame:
    """Fragments of each text put back in order; a group is one text."""
    parts = F.array_sort(F.collect_list(F.struct(offset, text)))
    return fragments.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias(text))


def letter_counts(docs: DataFrame, text: str) -> DataFrame:
    letters = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}"), F.lit(0))).alias("letter"))
    return letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
