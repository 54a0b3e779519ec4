"""Sinks.  Every one writes in parallel, one file per partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.runtime import global_row_number, scratch_path
from sparkloom.sources.readers import scan_csv


def write_table(df: DataFrame, name: str, path: str | None = None, mode: str = "overwrite",
                buckets: tuple[int, str] | None = None) -> None:
    """Catalog table; bucketed by a join key, later joins on it need no shuffle."""
    writer = df.write.mode(mode)
    if path:
        writer = writer.option("path", path)
    if buckets:
        writer = writer.bucketBy(*buckets).sortBy(buckets[1])
    writer.saveAsTable(name)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").json(path, compression="gzip" if gzip else "none")


def write_triplets(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=False, sep=" ")


def load_delimited_into(spark: SparkSession, csv: str, schema: str, table: str, lat: str, lon: str,
                        path: str | None = None) -> None:
    """Delimited file into a table with a point column derived from two fields."""
    rows = scan_csv(spark, csv, schema)
    write_table(rows.withColumn("point", F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))), table, path)


def line_feature(coordinates: Column, properties: Column) -> Column:
    """GeoJSON Feature of a LineString; coordinates are an array of [lon, lat]."""
    return F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
                    properties.alias("properties"))


def write_geojson(features: DataFrame, path: str, column: str = "feature") -> None:
    """Features as newline-delimited GeoJSON, the form that can be written in parallel."""
    features.select(F.to_json(column).alias("value")).write.mode("overwrite").text(path)


def write_feature_collection(features: DataFrame, path: str, column: str = "feature") -> None:
    """One FeatureCollection document as a folder of parts.

    Its parts in the order of their names make up the document; every task writes
    its own stretch, so the number of features is not bounded.
    """
    body = global_row_number(features.select(F.to_json(column).alias("value")).withColumn("_id", F.monotonically_increasing_id()), ["value", "_id"], "_at")
    lines = body.select("_at", F.when(F.col("_at") > 1, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))
    spark = features.sparkSession
    frame = spark.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (1 << 62, "]}")], "_at bigint, value string")
    lines.unionByName(frame).repartitionByRange("_at").sortWithinPartitions("_at").select("value").write.mode("overwrite").text(path)


def write_per_key_files(df: DataFrame, key: str, folder: str, header: bool = True) -> None:
    """One delimited file per key, named after it: ``folder/<key>.csv``.

    A key's rows are one file and hence one task, which is what the layout asks for;
    keys whose text is not a file name are an error.  Files appear by renames, one per key.
    """
    spark, draft = df.sparkSession, scratch_path(df.sparkSession, "keys")
    named = df.withColumn("_name", F.col(key).cast("string"))
    odd = named.where(F.col("_name").isNull() | ~F.col("_name").rlike(r"^[A-Za-z0-9_.-]+$") | F.col("_name").rlike(r"^[._]")).limit(1).count()
    if odd:
        raise ValueError(f"a value of {key} is not a file name")
    named.drop(key).repartition("_name").write.partitionBy("_name").csv(draft, header=header)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for f in files.globStatus(path(f"{draft}/_name=*/part-*")):
        name = f.getPath().getParent().getName().removeprefix("_name=")
        if not files.rename(f.getPath(), path(f"{folder}/{name}.csv")):
            raise RuntimeError(f"{folder}/{name}.csv could not be written")
