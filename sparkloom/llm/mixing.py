"""Mixing sources to target weights with fixed-length blocks of words.

Native DataFrame code.  Each source's documents, in a fixed order, form one long
sequence of words that is cut into blocks of ``block_words``.  Slots of the output
draw their source at random, so the sources of an output shard are a multinomial
draw; the few draws by which a source misses its quota over the whole output are
handed on from sources that were drawn too often.  A slot's number within its
source goes through a pseudorandom permutation of the block numbers, another one
for every epoch, and blocks are joined by number.  Every block of a source is
hence used equally often, give or take once, and never more often than the cap.

Every draw is a hash of the seed and the slot's number: reruns and retried tasks
agree.  Running totals of a hot source go through pieces of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import materialise

WORD = r"[^\x20\x09-\x0D]+"
_DRAWS = 1024  # stretches of the cumulative quotas that slots and sources are joined on
_ROUNDS = 16


def _all() -> Window:
    # only for tables with one row per source
    return Window.partitionBy(F.lit(0))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds ``rank`` and ``target`` to (source, source_size).

    Sources in code point order, NULL last, weigh ``weights``, repeating.  A target
    stops at ``cap`` times the size; what it leaves is reshared by weight until none
    is above.  In the order of ``cap * size / weight`` the capped sources come first,
    so one pass finds the level at which the rest share.
    """
    rank = F.row_number().over(_all().orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = _all().orderBy(F.col("most") / F.col("weight"), "rank")
    upto, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(_all()) * F.lit(float(share)) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(on)).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(_all())
    return s.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level)).select("source", "source_size", "rank", "target")


def permuted(i: Column, n: Column, *key: Column, rounds: int = _ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 that depends on ``key``: swap-or-not rounds.

    In each round i is paired with K - i (mod n); a hash of the pair's larger number
    decides whether the two change places, so every round is a permutation.
    """

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("shift"), r, *key), n) - x + n, n)
        return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(x, other), *key) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i, step)


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, piece_rows: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their size and place, and (source, piece) totals."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("h"))
    rows = materialise(rows, "sizes")
    n = rows.count()
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", "h", F.lit(1)), F.lit(n // piece_rows + 1)))
    w = Window.partitionBy("source", "piece").orderBy("doc_id", "h")
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = rows.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    return rows, materialise(totals, "pieces")


class Mixture:
    """``documents``: doc_id, source, size, source_size, target, rank, piece, place, one row per input row.
    ``pieces``: shard, slot, rank, epoch, block, doc_id, piece, place, first_word, n_words, one row per document in a slot.
    """

    def __init__(self, documents: DataFrame, pieces: DataFrame):
        self.documents, self.pieces = documents, pieces

    def taken(self) -> DataFrame:
        """``documents`` with the words that the mixture takes from each, repeats counted."""
        key = ["rank", "piece", "place"]
        used = self.pieces.groupBy(*key).agg(F.sum("n_words").alias("taken"))
        return self.documents.join(used, key, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``pieces`` with the words themselves; needs unique ids."""
        words = F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))
        d = docs.select(F.col(id_col).alias("_id"), words.alias("_words"))
        return self.pieces.join(d, F.col("doc_id") == F.col("_id")).withColumn(
            "words", F.slice("_words", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))).drop("_id", "_words")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5, cap: float = 2.0, block_words: int = 128, shard_slots: int = 65536, seed: int = 42, piece_rows: int = 4_000,
) -> Mixture:
    """Plan a mixture of ``share`` times all words.

    A NULL source is a source of its own, after the others; NULL and empty texts
    have size 0 and are never taken; repeated rows are separate documents; an empty
    table gives an empty mixture.  A source's taken words miss its target by at most
    about one block, and no document is taken more than ``cap`` (a whole number) times.
    """
    if int(cap) != cap or share > cap:
        raise ValueError("cap must be a whole number, at least share")
    rows, totals = _placed(docs, id_col, text_col, source_col, piece_rows)
    sized = totals.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sized, weights, share, cap)
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn(
        "quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"), F.col("blocks") * int(cap))).otherwise(F.lit(0)))
    before = _all().orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    plan = materialise(plan.withColumn("low", F.coalesce(F.sum("quota").over(before), F.lit(0))).withColumn("high", F.col("low") + F.col("quota")), "targets")
    slots = plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]

    based = totals.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    based = based.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_s"), F.col("piece").alias("_p"), "base", "rank", "source_size", "target")
    placed = rows.join(based, F.col("source").eqNullSafe(F.col("_s")) & (F.col("piece") == F.col("_p")))
    documents = materialise(placed.select("doc_id", "source", "size", "source_size", "target", "rank", "piece", "place", (F.col("base") + F.col("before")).alias("start")), "placed")

    spark = docs.sparkSession
    stretch = max(1, -(-slots // _DRAWS))
    slot = spark.range(0, slots, 1, max(1, slots // 1_000_000 + 1)).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), "id"), F.lit(max(1, slots))).alias("u"))
    ranges = plan.where("quota > 0").select("rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / stretch), F.floor((F.col("high") - 1) / stretch))).alias("stretch"))
    drawn = slot.withColumn("stretch", F.floor(F.col("u") / stretch)).join(ranges, "stretch").where("u >= low and u < high").select("slot", "shard", "rank")
    drawn = materialise(drawn, "draws")

    # multinomial counts of each shard, then the number of each slot within its source
    counts = drawn.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.withColumn("first", F.sum("n").over(Window.partitionBy("rank").orderBy("shard")) - F.col("n")), "shards")
    numbered = drawn.withColumn("r", F.row_number().over(Window.partitionBy("rank", "shard").orderBy("slot")) - 1)
    numbered = numbered.join(counts.select(F.col("rank").alias("_r"), F.col("shard").alias("_s"), "first"), (F.col("rank") == F.col("_r")) & (F.col("shard") == F.col("_s"))).select(
        "slot", "shard", "rank", (F.col("first") + F.col("r")).alias("j"))

    met = plan.join(counts.groupBy("rank").agg(F.sum("n").alias("hit")), "rank", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    met = met.withColumn("over", F.greatest(F.col("hit") - F.col("quota"), F.lit(0))).withColumn("under", F.greatest(F.col("quota") - F.col("hit"), F.lit(0)))
    met = materialise(met.withColumn("over_before", F.coalesce(F.sum("over").over(before), F.lit(0))).withColumn("under_before", F.coalesce(F.sum("under").over(before), F.lit(0))), "met")
    quotas = met.select(F.col("rank").alias("_q"), "quota", "over_before", "blocks")
    known = numbered.join(quotas, F.col("rank") == F.col("_q")).drop("_q")
    kept = known.where("j < quota").select("slot", "shard", "rank", "j", "blocks")
    spare = known.where("j >= quota").select("slot", "shard", (F.col("over_before") + F.col("j") - F.col("quota")).alias("e"))
    short = met.where("under > 0").select("rank", "blocks", "hit", "under_before", F.explode(F.sequence(F.lit(0), F.col("under") - 1)).alias("i")).select(
        "rank", "blocks", (F.col("hit") + F.col("i")).alias("j"), (F.col("under_before") + F.col("i")).alias("e"))
    chosen = kept.unionByName(spare.join(short, "e").select("slot", "shard", "rank", "j", "blocks"))
    epoch = F.floor(F.col("j") / F.col("blocks"))
    chosen = chosen.withColumn("epoch", epoch).withColumn("i", F.col("j") - F.col("epoch") * F.col("blocks")).withColumn(
        "block", permuted(F.col("i"), F.col("blocks"), F.lit(seed), F.col("rank"), F.col("epoch"))).select("slot", "shard", "rank", "epoch", "block")

    end = F.col("start") + F.col("size")
    parts = documents.where("size > 0").select("doc_id", "rank", "piece", "place", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * block_words), F.least(end, (F.col("block") + 1) * block_words)
    parts = parts.select("doc_id", "rank", "piece", "place", "block", (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))
    pieces = chosen.join(parts, ["rank", "block"]).select("shard", "slot", "rank", "epoch", "block", "doc_id", "piece", "place", "first_word", "n_words")
    return Mixture(documents, pieces)
