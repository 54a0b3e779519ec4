"""Array and vector expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType


def array_max_sum(array: Column) -> Column:
    """Aggregate: sum of the largest elements."""
    return F.sum(F.array_max(array))


def explode_range(n: Column) -> Column:
    """1..n as rows; nothing for n below 1."""
    return F.explode(F.when(n >= 1, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>")))


def map_cos(array: Column) -> Column:
    return F.transform(array, F.cos)


def positive_cos(array: Column) -> Column:
    return F.filter(array, lambda x: F.cos(x) > 0)


def energy(a: Column) -> Column:
    """Sum of squares; gaps count as 0."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0)))


def flatten_labels(lists: Column) -> Column:
    """One level flattened, each label once."""
    return F.array_distinct(F.flatten(lists))


def one_hot(labels: Column, wanted: list[str]) -> list[Column]:
    return [F.array_contains(labels, w).cast("int").alias("is_" + w.lower().replace("#", "").replace(" ", "_")) for w in wanted]


@F.pandas_udf(BinaryType())
def pack_array(values: pd.Series) -> pd.Series:
    """Float vectors as little-endian 32-bit bytes (legacy files)."""
    return values.map(lambda v: np.asarray(v, dtype="<f4").tobytes() if v is not None else None)


@F.pandas_udf(ArrayType(DoubleType()))
def unpack_array(values: pd.Series) -> pd.Series:
    return values.map(lambda b: np.frombuffer(b, dtype="<f4").astype("float64") if b is not None else None)


def parse_csv_record(line: Column, rules: list[tuple], sep: str = ",") -> list[Column]:
    """Typed fields from ``(name, type, width)``; a width above 1 makes an array."""
    fields = F.split(line, "[" + sep + "]", -1)

    def typed(kind):
        return lambda x: x.try_cast(kind)

    out, at = [], 1
    for name, kind, width in rules:
        if width == 1:
            out.append(F.try_element_at(fields, F.lit(at)).try_cast(kind).alias(name))
        else:
            out.append(F.transform(F.slice(fields, at, width), typed(kind)).alias(name))
        at += width
    return out


def csv_to_kv(line: Column, sep: str = ",") -> tuple[Column, Column]:
    """Key: the last field; value: all fields."""
    fields = F.split(line, "[" + sep + "]", -1)
    return F.element_at(fields, -1), fields


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def change_ratio(new: Column, old: Column) -> Column:
    return F.try_divide(new, old)


def log_ratio(new: Column, old: Column, base: float | None = None) -> Column:
    """Logarithm of new/old; NULL unless both are positive."""
    ratio = F.when((new > 0) & (old > 0), new / old)
    return F.log(ratio) if base is None else F.log(float(base), ratio)
