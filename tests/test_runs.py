"""Levels of runs: files read, replays, stops in the middle."""

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import buckets
from sparkloom.streaming.runs import Runs


def merge(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"))


def batch(spark, b):
    return spark.createDataFrame([(b % 3, 1 << b), (9, 1)], "k int, n bigint").coalesce(1)


def totals(store):
    return {r.k: r.n for r in store.read().collect()}


def want(batches):
    out = {9: len(batches)}
    for b in batches:
        out[b % 3] = out.get(b % 3, 0) + (1 << b)
    return out


def test_runs_read_grow_with_the_logarithm(spark, tmp_path):
    store = Runs(spark, str(tmp_path), merge, fan=3)
    assert store.read() is None
    for b in range(28):
        store.add(batch(spark, b), b)
        assert len(store.live()) <= 2 * 4
    live = store.live()
    assert [(r["level"], r["first"], r["last"]) for r in live] == [(3, 0, 26), (0, 27, 27)]
    assert totals(store) == want(range(28))
    kept = {p.name for p in tmp_path.iterdir() if p.name.startswith("run-")}
    assert {r["name"] for r in live} <= kept and len(kept) <= len(live) + 3  # and those of the manifest before


def test_a_batch_counts_once(spark, tmp_path):
    store = Runs(spark, str(tmp_path), merge, fan=2)
    for b in (0, 1, 1, 2, 2, 0, 3, 3):
        store.add(batch(spark, b), b)
    assert totals(store) == want(range(4)) and store.covers(0) and not store.covers(4)


@pytest.mark.parametrize("step", ["first write", "merge", "before commit", "during commit", "after commit", "tidying"])
def test_stops_lose_and_double_nothing(spark, tmp_path, step):
    class Stop(Exception):
        pass

    class Breaking(Runs):
        writes = 0

        def _write(self, df, level, first, last):
            if step == "first write" and level == 0 or step == "merge" and level == 2:
                df.limit(1).write.mode("overwrite").parquet(f"{self.folder}/run-{level}-{first}-{last}")  # half of it
                raise Stop
            return super()._write(df, level, first, last)

        def _commit(self, batch, runs):
            if step == "before commit":
                raise Stop
            if step == "during commit":
                self._files.create(self._path("manifest/_draft"), True).close()
                raise Stop
            super()._commit(batch, runs)
            if step == "after commit":
                raise Stop

        def _tidy(self):
            if step == "tidying":
                raise Stop
            super()._tidy()

    store = Runs(spark, str(tmp_path), merge, fan=2)
    for b in range(3):
        store.add(batch(spark, b), b)
    before = totals(store)
    with pytest.raises(Stop):
        Breaking(spark, str(tmp_path), merge, fan=2).add(batch(spark, 3), 3)
    assert totals(Runs(spark, str(tmp_path), merge, fan=2)) in (before, want(range(4)))  # a reader sees one state or the other
    for b in (3, 4):
        Runs(spark, str(tmp_path), merge, fan=2).add(batch(spark, b), b)  # the replay, and on
    assert totals(store) == want(range(5))


def test_a_stream_in_many_files(spark, tables, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    tables.events.repartition(30, "event_id").write.parquet(path)
    got = buckets.bucket_totals(buckets.read_events(spark, path), 30, out, str(tmp_path / "cp"), fan=3)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in buckets.bucket_stats(tables.events, 30, "1 hour").collect()}
    assert len(Runs(spark, out, buckets.merge_partials, 3).live()) <= 8
    more = buckets.bucket_totals(buckets.read_events(spark, path), 30, out, str(tmp_path / "cp"), fan=3)  # nothing new
    assert more.agg(F.sum("n")).first()[0] == tables.events.count()
