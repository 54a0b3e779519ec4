"""Streaming forms of the per-bucket level statistics.

``bucket_totals`` counts every row; ``bucket_stats`` with ``run_to_table`` or
``closed_buckets`` bounds its state by a watermark and drops what comes later than it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.streaming.runs import Runs

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    return (spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def bucket_stats(events: DataFrame, minutes: int, lateness: str) -> DataFrame:
    """Tumbling windows per segment; rows later than ``lateness`` are dropped.

    Watermarks need instants, so local timestamps are read in the session time zone.
    """
    rows = events.select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("segment_id"),
                         (1 + F.col("event_id") % 5).cast("int").alias("level"))
    grouped = rows.withWatermark("at", lateness).groupBy(F.window("at", f"{minutes} minutes"), "segment_id")
    return grouped.agg(F.min("level").alias("min_level"), F.max("level").alias("max_level"),
                       F.avg("level").alias("avg_level"), F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("bucket"), "segment_id", "min_level", "max_level", "avg_level", "n")


KEYS = ["bucket", "segment_id"]


def merge_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*KEYS).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("known").alias("known"), F.sum("n").alias("n"))


def bucket_totals(events: DataFrame, minutes: int, target: str, checkpoint: str, fan: int = 8) -> DataFrame:
    """Statistics of all events of a stream, whatever their order and files: equal to the batch form.

    No watermark, so no row is late.  A batch is reduced to mergeable partials, which
    :class:`Runs` keeps in levels: the files read grow with the logarithm of the batches,
    and a replayed batch counts once.  ``target`` belongs to ``checkpoint``: batches of
    another job would be taken for replays.
    """
    runs = Runs(events.sparkSession, target, merge_partials, fan)

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes")["start"].alias("bucket"), F.col("user_id").alias("segment_id"),
                            (1 + F.col("event_id") % 5).cast("int").alias("level"))
        runs.add(rows.groupBy(*KEYS).agg(F.min("level").alias("low"), F.max("level").alias("high"), F.sum("level").alias("total"), F.count("level").alias("known"), F.count(F.lit(1)).alias("n")), batch_id)

    job = events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    merged = runs.read()
    if merged is None:
        raise ValueError("the stream has no input yet")
    return merged.select(*KEYS, F.col("low").alias("min_level"), F.col("high").alias("max_level"), F.try_divide("total", "known").alias("avg_level"), "n")


def run_to_table(stats: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Write every update under its batch number and return the newest row per window.

    A batch writes into its own folder, so a replay replaces what it wrote before.
    """
    spark = stats.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    job = (stats.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())
    job.awaitTermination()
    return latest(spark.read.parquet(target))


def latest(updates: DataFrame) -> DataFrame:
    """The last version of each window and segment, by partial aggregation."""
    keys = ["bucket", "segment_id"]
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = updates.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def closed_buckets(stats: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Append form: only windows the watermark has closed; each is written once."""
    job = (stats.writeStream.outputMode("append").format("parquet").option("path", target)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    job.awaitTermination()
    return stats.sparkSession.read.parquet(target)
