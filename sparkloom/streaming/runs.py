"""A table of mergeable partials, kept as sorted levels of runs.

A batch of a stream is one run.  As soon as a level holds ``fan`` runs they are merged
into one run of the next level, so ``n`` batches are read from at most ``fan`` runs on
each of about log(n) levels, and a row is rewritten once per level.

Which runs count is said by the newest manifest alone.  It is named after its batch and
appears by one rename when everything it lists is complete.  So a job that stops
anywhere before leaves runs that nobody reads and a replay overwrites; one that stops
after it finds its batch in the manifest and adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Runs:
    """Runs under ``folder``; ``merge`` turns rows of several runs into rows of one."""

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame], fan: int = 8):
        if fan < 2:
            raise ValueError("a merge takes two runs at least")
        self.spark, self.folder, self.merge, self.fan = spark, folder.rstrip("/"), merge, fan
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(f.getPath().getName() for f in self._files.listStatus(path)) if self._files.exists(path) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names("manifest") if n.isdigit()]

    def _listed(self, manifest: str) -> list[dict]:
        lines = self.spark.read.text(f"{self.folder}/manifest/{manifest}").collect()  # one line per run
        return [json.loads(r.value) for r in lines]

    def live(self) -> list[dict]:
        """Runs that count, oldest first: level, first and last batch, name."""
        found = self._manifests()
        return sorted(self._listed(found[-1]), key=lambda r: r["first"]) if found else []

    def covers(self, batch: int) -> bool:
        return any(r["first"] <= batch <= r["last"] for r in self.live())

    def _write(self, df: DataFrame, level: int, first: int, last: int) -> dict:
        run = {"level": level, "first": first, "last": last, "name": f"run-{level}-{first}-{last}"}
        df.write.mode("overwrite").parquet(f"{self.folder}/{run['name']}")
        return run

    def _read(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{r['name']}" for r in runs])

    def _commit(self, batch: int, runs: list[dict]) -> None:
        """Everything is written: make it count, by one rename."""
        draft, final = self._path(f"manifest/_{uuid.uuid4().hex}"), self._path(f"manifest/{batch:020d}")
        out = self._files.create(draft, True)
        out.write(bytearray("\n".join(json.dumps(r) for r in runs).encode()))
        out.close()
        if not self._files.rename(draft, final):
            raise RuntimeError(f"manifest of batch {batch} exists: two jobs write to {self.folder}")

    def _tidy(self) -> None:
        """Delete what neither the newest manifest lists nor the one before it, which a reader may still hold."""
        keep = self._manifests()[-2:]
        named = {r["name"] for m in keep for r in self._listed(m)}
        for n in self._names(""):
            if n.startswith("run-") and n not in named:
                self._files.delete(self._path(n), True)
        for n in self._names("manifest"):
            if n not in keep and not n.endswith(".crc"):
                self._files.delete(self._path(f"manifest/{n}"), False)

    def add(self, partials: DataFrame, batch: int) -> None:
        """Take in the partials of a batch, once, whatever happens and however often it is tried."""
        runs = self.live()
        if any(r["first"] <= batch <= r["last"] for r in runs):
            return
        runs.append(self._write(partials, 0, batch, batch))
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fan:
            merged = self._write(self.merge(self._read(full)), level + 1, full[0]["first"], full[-1]["last"])
            runs = [r for r in runs if r["level"] != level] + [merged]
            level += 1
        self._commit(batch, runs)
        self._tidy()

    def read(self) -> DataFrame | None:
        """All partials, merged; None before the first batch."""
        runs = self.live()
        return self.merge(self._read(runs)) if runs else None
