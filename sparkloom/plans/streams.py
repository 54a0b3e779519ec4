"""Streaming queries run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.league import LEAGUE_SQL, matches, teams
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.traffic import REPORT_SQL
from sparkloom.runtime import materialise, scratch_path
from sparkloom.streaming import buckets, scoreboard


def write_change_files(t: Tables, path: str) -> None:
    """Changes that end in the real matches: first drafts, corrections, and extras taken back.

    One file per step, written in order, so that the stream reads them in order.
    """
    m = materialise(matches(t), "matches").select(F.struct("home", "away", "home_score", "away_score").alias("m"))
    draft = F.struct(F.col("m.home").alias("home"), F.col("m.away").alias("away"),
                     (F.col("m.home_score") + 1).alias("home_score"), F.col("m.away_score").alias("away_score"))
    extra = F.struct(F.col("m.away").alias("home"), F.col("m.home").alias("away"),
                     F.col("m.home_score").alias("home_score"), F.col("m.away_score").alias("away_score"))
    none = F.lit(None).cast(scoreboard.MATCH)
    steps = [m.select(none.alias("old"), draft.alias("new")), m.select(none.alias("old"), extra.alias("new")),
             m.select(draft.alias("old"), F.col("m").alias("new")), m.select(extra.alias("old"), none.alias("new"))]
    for i, step in enumerate(steps):
        step.select(F.lit(i).cast("bigint").alias("seq"), "old", "new").coalesce(1).write.mode("append").parquet(path)


@query("WITH " + LEAGUE_SQL + "SELECT name, points FROM board")
def stream_scoreboard(t: Tables) -> DataFrame:
    """Board kept up to date from inserts, corrections and deletions of matches."""
    source = scratch_path(t.spark, "changes")
    write_change_files(t, source)
    board = scoreboard.maintain_scoreboard(t.spark, source, scratch_path(t.spark, "board"), scratch_path(t.spark, "offsets"))
    return teams(t).select("name").join(board, "name", "left").select("name", F.coalesce("points", F.lit(0).cast("bigint")).alias("points"))


@query("WITH " + REPORT_SQL + """SELECT bucket::VARCHAR AS bucket, segment_id, min(level) AS min_level, max(level) AS max_level,
  round(avg(level), 6) AS avg_level, count(*) AS n FROM report GROUP BY bucket, segment_id""")
def stream_time_buckets(t: Tables) -> DataFrame:
    """Half-hour statistics of the event stream, equal to the batch form."""
    events = buckets.read_events(t.spark, t.folder, "events.parquet")
    out = buckets.bucket_totals(events, 30, scratch_path(t.spark, "buckets"), scratch_path(t.spark, "offsets"))
    return out.select(F.col("bucket").cast("timestamp_ntz").cast("string").alias("bucket"), "segment_id", "min_level", "max_level",
                      F.round("avg_level", 6).alias("avg_level"), "n")
