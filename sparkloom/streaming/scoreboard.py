"""Incremental league board fed by a stream of match changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.aggregate import point_awards

MATCH = "struct<home string, away string, home_score bigint, away_score bigint>"
CHANGE_SCHEMA = f"seq bigint, old {MATCH}, new {MATCH}"


def _side(which: str, sign: int) -> Column:
    """Signed points of the old or new version of a match; nothing if it is NULL."""
    awards = point_awards(*[f"{which}.{c}" for c in ("home", "away", "home_score", "away_score")])
    signed = F.transform(awards, lambda a: F.struct(a["name"].alias("name"), (a["points"] * sign).alias("points")))
    return F.when(F.col(f"{which}.home").isNotNull(), signed).otherwise(F.array().cast("array<struct<name:string,points:bigint>>"))


def deltas(changes: DataFrame) -> DataFrame:
    """An insert has only a new match, a delete only an old one, an update both."""
    both = F.concat(_side("old", -1), _side("new", 1))
    return changes.select(F.explode(both).alias("d")).select("d.name", "d.points")


def maintain_scoreboard(spark: SparkSession, source: str, target: str, checkpoint: str,
                        files_per_batch: int = 1) -> DataFrame:
    """Consume the change files and return the board after the last batch.

    The totals after batch n are those after batch n - 1 plus the deltas of batch
    n, stored under their own batch number.  A replayed batch overwrites its own
    folder from the same predecessor, so nothing is counted twice.
    """
    changes = spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(batch: DataFrame, batch_id: int) -> None:
        current = deltas(batch).groupBy("name").agg(F.sum("points").alias("points"))
        if batch_id > 0:
            current = current.unionByName(spark.read.parquet(f"{target}/batch={batch_id - 1}"))
        totals = current.groupBy("name").agg(F.sum("points").alias("points"))
        totals.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    job = (changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())
    job.awaitTermination()
    newest = spark.read.parquet(target).agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{target}/batch={newest}")


def running_scoreboard(changes: DataFrame) -> DataFrame:
    """Stateful form: totals kept by the engine, to be written in update mode."""
    return deltas(changes).groupBy("name").agg(F.sum("points").alias("points"))
