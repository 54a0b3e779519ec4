"""Registry of queries and the table set they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources.readers import scan_parquet

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.orders``.

    ``spread`` deals documents and vectors into that many partitions by key before
    work that costs far more than the read.  Give it for tables of a single file,
    which one task would read and process; tables of many files need none.
    """

    def __init__(self, spark: SparkSession, folder: str, spread: int | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.spread = spread

    def _dealt(self, df: DataFrame, key: str) -> DataFrame:
        return df.repartition(self.spread, key) if self.spread else df

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return scan_parquet(self.spark, f"{self.folder}/{name}.parquet")

    @property
    def docs(self) -> DataFrame:
        return self._dealt(self.documents, "doc_id")

    @property
    def vectors(self) -> DataFrame:
        return self._dealt(self.embeddings, "vec_id")


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of :class:`Tables`; ``oracle`` is its SQL form."""

    def wrap(fn):
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} registered twice")
        REGISTRY[key] = Query(fn, oracle)
        return fn

    return wrap
