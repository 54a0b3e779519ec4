"""Streams: state equals the batch result, replays change nothing, late rows are dropped."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.aggregate import league_points
from sparkloom.plans import league, streams
from sparkloom.streaming import buckets, scoreboard


def test_scoreboard_equals_recomputation(spark, tables, tmp_path):
    source = str(tmp_path / "changes")
    streams.write_change_files(tables, source)
    board = scoreboard.maintain_scoreboard(spark, source, str(tmp_path / "board"), str(tmp_path / "offsets"))
    want = league_points(league.teams(tables).select("name"), league.matches(tables)).filter("points > 0")
    got = board.filter("points > 0")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    # Nothing new: a second run leaves the totals as they are.
    again = scoreboard.maintain_scoreboard(spark, source, str(tmp_path / "board"), str(tmp_path / "offsets"))
    assert {tuple(r) for r in again.filter("points > 0").collect()} == {tuple(r) for r in want.collect()}
    # Lost offsets: every batch is replayed into its own folder.
    replayed = scoreboard.maintain_scoreboard(spark, source, str(tmp_path / "board"), str(tmp_path / "offsets-2"))
    assert {tuple(r) for r in replayed.filter("points > 0").collect()} == {tuple(r) for r in want.collect()}


def test_update_carries_the_old_row(spark):
    m = lambda h, a: ("x", "y", h, a)
    rows = [(1, None, m(1, 0)), (2, m(1, 0), m(0, 2)), (3, m(0, 2), m(1, 1)), (4, m(1, 1), None)]
    df = spark.createDataFrame(rows, scoreboard.CHANGE_SCHEMA)
    for n, want in ((1, {"x": 2}), (2, {"y": 3}), (3, {"x": 1, "y": 1}), (4, {})):
        got = scoreboard.running_scoreboard(df.filter(F.col("seq") <= n)).filter("points <> 0")
        assert {r.name: r.points for r in got.collect()} == want


def write_events(spark, path, groups):
    for g in groups:
        rows = spark.createDataFrame([(i, t, u, "click", 1.0, "{}") for i, t, u in g], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
        rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files, how", [(1, "ts"), (4, "ts"), (16, "event_id"), (5, "value")])
def test_totals_do_not_depend_on_files(spark, tables, tmp_path, files, how):
    path = str(tmp_path / "in")
    placed = tables.events.repartitionByRange(files, how)
    placed.write.parquet(path)
    got = buckets.bucket_totals(buckets.read_events(spark, path), 30, str(tmp_path / "out"), str(tmp_path / "cp"))
    want = buckets.bucket_stats(tables.events, 30, "1 hour")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    # The engine drops rows by the watermark of the batch before, hence a batch in between.
    write_events(spark, path, [[(0, "2024-01-01 00:10:00", 1)], [(1, "2024-01-01 05:00:00", 1)], [(4, "2024-01-01 05:05:00", 1)],
                               [(2, "2024-01-01 00:20:00", 1), (3, "2024-01-01 05:10:00", 1)]])
    stats = buckets.bucket_stats(buckets.read_events(spark, path), 30, "1 hour")
    got = {str(r.bucket): r.n for r in buckets.run_to_table(stats, str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 05:00:00": 3}


def test_append_holds_back_open_windows(spark, tables, tmp_path):
    path = str(tmp_path / "in")
    ordered = tables.events.orderBy("ts")
    for day in ("2024-01-05", "2024-01-06"):
        ordered.filter(F.to_date("ts") == day).coalesce(1).write.mode("append").parquet(path)
    stats = buckets.bucket_stats(buckets.read_events(spark, path), 30, "1 hour")
    closed = buckets.closed_buckets(stats, str(tmp_path / "out"), str(tmp_path / "cp"))
    every = buckets.bucket_stats(spark.read.parquet(path), 30, "1 hour")
    missing = every.join(closed.select("bucket", "segment_id"), ["bucket", "segment_id"], "left_anti")
    assert closed.count() > 0 and closed.join(every, every.columns, "left_anti").count() == 0
    assert missing.filter("bucket < '2024-01-06 22:00:00'").count() == 0
