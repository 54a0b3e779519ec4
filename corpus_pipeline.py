"""Raw documents to a training mixture, stage by stage.

Every stage reads what its predecessor wrote and returns the columns of its input,
whatever they are called; only the last returns the plan of the mixture instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import classifier, decontaminate, mixing, simhash, suffix_dedup
from sparkloom.llm.common import fold, table
from sparkloom.runtime import materialise

_NO_ID = -(1 << 63)  # stands for a NULL id in keys


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, k, h): whole rows with a key that is never NULL, id and hash of the text."""
    return docs.select(F.struct("*").alias("row"), _key(F.col("doc_id")).alias("k"), F.xxhash64(F.col("text").cast("string")).alias("h"))


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_NO_ID).cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go; it learns from two thirds of the labels."""
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    scored = classifier.score(docs, table(spark, sf_dir, "labels"), usable=~held)
    bad = scored.where("score < 0.5").select(_key(F.col("doc_id")).alias("k"), "h").distinct()
    return _keyed(docs).join(bad, ["k", "h"], "left_anti").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id, NULL last."""
    found = simhash.near_duplicates(docs)
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("best"))
    best = best.select(_key(F.col("best.doc_id")).alias("k"), F.col("best.h").alias("h"))
    kept = _keyed(docs).join(best, ["k", "h"])
    first = F.row_number().over(Window.partitionBy("k", "h").orderBy(F.lit(0)))  # rows that repeat id and text
    return kept.withColumn("n", first).where("n = 1").select("row.*")


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document holds are cut out; documents of which nothing is left go."""
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "text")]
    slim = docs.select(F.col("doc_id"), F.col("text"), F.col("text").isNull().alias("x"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(rest)])
    cut = suffix_dedup.remove_repeats(slim, min_bytes=50, carry=["x", *[f"x{i}" for i in range(len(rest))]])
    cut = cut.where("n_removed = 0 or kept_text <> ''").withColumn("kept_text", F.when(~F.col("x"), F.col("kept_text")))
    own = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")} | {c: F.col(f"x{i}") for i, c in enumerate(rest)}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[own[c].alias(c) for c in names])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more lies in benchmark windows go."""
    found = decontaminate.verdicts(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(_key(F.col("doc_id")).alias("k"), "h").distinct()
    return _keyed(docs).join(bad, ["k", "h"], "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mixture takes from each document."""
    return mixing.mix(docs).taken().select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("suffix_array_dedup", repeat_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

ORACLE_SQL = None  # fitted models, XXH64 and seeded draws have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
