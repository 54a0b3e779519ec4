"""Cutting lineage, shared scratch space and globally ordered computations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="sparkloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


_own_folders: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's own part of the shared folder, which is deleted when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/sparkloom-{spark.sparkContext.applicationId}"
    if folder not in _own_folders:
        _own_folders.add(folder)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's steps now; results that still read them must be written before."""
    for folder in [f for f in _own_folders if f.endswith(spark.sparkContext.applicationId)]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _own_folders.discard(folder)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several branches read to the shared folder, once.

    It survives lost executors like a checkpoint does, but stays columnar: each
    branch reads only its columns, filters reach the files, and the planner knows
    the true size when it decides on a broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A step of a loop, or a small result used several times, kept as files."""
    return materialise(df, "step")


def release(step: DataFrame) -> None:
    """Delete the files of a materialised step that nothing reads any more, such as the last but one round of a loop."""
    spark = step.sparkSession
    for folder in {f.rpartition("/")[0] for f in step.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def range_ordered(df: DataFrame, *order: str | Column) -> DataFrame:
    """Range-partition by ``order`` and pin the partition number in ``_part``.

    Range bounds come from sampling, so the rows are written once: every later
    use, and every retry after a lost executor, sees the same partitions.
    Equal keys share a partition; give unique keys or aggregate beforehand.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _before(parts: DataFrame, values: dict[str, str]) -> DataFrame:
    # One row per partition, so this window never sees data-sized input.
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(out) for v, out in values.items()])


def running_totals(df: DataFrame, order: list[str | Column], values: dict[str, str]) -> DataFrame:
    """Running sums over the whole table in ``order``, in parallel: column -> name of its sum.

    Each range partition is summed on its own; partition totals (one row each)
    become offsets.  No task ever holds more than one range partition.
    """
    ranged = range_ordered(df, *order)
    before = {v: f"_b{i}" for i, v in enumerate(values)}
    offsets = _before(ranged.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values]), before)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.join(F.broadcast(offsets), "_part").select("*", *[(F.sum(v).over(w) + F.col(before[v])).alias(out) for v, out in values.items()])
    return summed.drop("_part", *before.values())


def running_total(df: DataFrame, order: list[str | Column], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` over the whole table in ``order``: see :func:`running_totals`."""
    return running_totals(df, order, {value: out})


def global_row_number(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """Row number 1..n over the whole table; ``order`` must be unique.

    Rows are range-partitioned and sorted once.  The id Spark gives to a row holds
    its partition (high bits) and its place in it (low 33 bits), so a second
    shuffle is not needed; the rows are written because the ranges are sampled.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    offsets = _before(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_s")), {"_s": "_before"})
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_before") + F.col("_place") + 1)
        .drop("_id", "_part", "_place", "_before")
    )


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's estimate of the size lies within the session's broadcast threshold."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= estimate <= limit


def few_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values of a column that become columns or models: a pivot, a class, a cluster.  NULL is last."""
    values = [r[0] for r in df.select(column).distinct().collect()]
    return sorted(v for v in values if v is not None) + [None] * (None in values)


def neighbour_in_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    columns: dict[str, str],
    forward: bool = False,
) -> DataFrame:
    """``lag``/``lead`` by one row per key, safe for a key holding most rows.

    ``chunk`` splits a key's rows into consecutive pieces (for example one per
    day); it must not decrease along ``order``.  The window runs inside a piece;
    the border row of the nearest non-empty piece fills the gap at its edge.
    """
    fields = F.struct(*[F.col(c).alias(n) for c, n in columns.items()])
    d = df.withColumn("_chunk", chunk).withColumn("_row", fields)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    position = F.struct(*order)
    if forward:
        d = d.withColumn("_near", F.lead("_row").over(inside))
        border = F.min_by("_row", position)
        step = F.lead("_border").over(across)
    else:
        d = d.withColumn("_near", F.lag("_row").over(inside))
        border = F.max_by("_row", position)
        step = F.lag("_border").over(across)
    edges = (
        df.withColumn("_chunk", chunk).withColumn("_row", fields)
        .groupBy(*keys, "_chunk").agg(border.alias("_border"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                F.col("_chunk").alias("_c"), step.alias("_other"))
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on.append(F.col("_chunk").eqNullSafe(F.col("_c")))
    joined = d.join(edges, on, "left")
    near = F.coalesce("_near", "_other")
    return joined.select(*df.columns, *[near[n].alias(n) for n in columns.values()])


def join_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join on columns of the same names in which NULL equals NULL.

    The keys of ``df`` are kept once, so rows with a NULL key are not lost.
    """
    renamed = other.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, on, how).drop(*[f"_key{i}" for i in range(len(keys))])
