"""Readers.  Schemas are explicit; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_csv(spark: SparkSession, path, schema, header: bool = True, sep: str = ",") -> DataFrame:
    """Delimited file(s); rows that break the schema become NULLs, not errors."""
    return spark.read.schema(schema).csv(path, header=header, sep=sep, mode="PERMISSIVE")


def scan_json(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_text(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Any list of files or folders as one column ``value``, a row per line."""
    return spark.read.text(paths)


def scan_gz_records(spark: SparkSession, path, schema) -> DataFrame:
    """Gzipped JSON lines.  A gzip file is one task: keep the files small."""
    return spark.read.schema(schema).json(path)


def scan_triplets(spark: SparkSession, path) -> DataFrame:
    """Space-delimited ``document word count`` lines."""
    return scan_csv(spark, path, "doc_id bigint, word_id bigint, count bigint", header=False, sep=" ")


def scan_table(spark: SparkSession, name: str, columns: list[str] | None = None,
               predicate: str | Column | None = None) -> DataFrame:
    """Catalog table or view; projection and predicate reach the scan."""
    df = spark.table(name)
    if predicate is not None:
        df = df.filter(predicate)
    return df.select(*columns) if columns else df


def scan_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], partition: dict | None = None,
              **options: str) -> DataFrame:
    """Database table, read in parallel when ``partition`` gives
    ``column``, ``lower``, ``upper`` and ``count``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition:
        reader = (reader.option("partitionColumn", partition["column"])
                  .option("lowerBound", partition["lower"]).option("upperBound", partition["upper"])
                  .option("numPartitions", partition["count"]))
    return reader.options(**options).load().select(*columns)


def slice_fixed_width(line: Column, specs: list[tuple]) -> list[Column]:
    """Columns from ``(name, start, end)`` slices, 0-based and end-exclusive.

    An optional fourth item gives the type, a fifth the width to pad with zeros.
    """
    out = []
    for name, start, end, *rest in specs:
        value = F.trim(F.substring(line, start + 1, end - start))
        if rest and rest[0] and rest[0] != "string":
            value = value.try_cast(rest[0])
        if len(rest) > 1:
            value = F.lpad(value, rest[1], "0")
        out.append(value.alias(name))
    return out


def scan_fixed_width(spark: SparkSession, path, specs: list[tuple]) -> DataFrame:
    return scan_text(spark, path).select(*slice_fixed_width(F.col("value"), specs))


def scan_per_key_files(spark: SparkSession, folder: str, schema, keep: list[str] | None = None,
                       omit: list[str] | None = None, header: bool = True, by_folder: bool = False) -> DataFrame:
    """A folder with one delimited file per key; the key is the file's name, or ``key=`` in the name of its folder.

    The allow and deny lists compare metadata only, so files left out are
    pruned before any line is parsed.
    """
    if by_folder:
        df = spark.read.schema(f"{schema}, key string").csv(folder, header=header)
    else:
        df = (spark.read.schema(schema).csv(folder, header=header)
              .select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("key")))
    if keep:
        df = df.filter(F.col("key").isin(keep))
    if omit:
        df = df.filter(~F.col("key").isin(omit))
    return df


def field_count_errors(lines: DataFrame, header_width: int, sep: str = ",") -> DataFrame:
    """Lines whose number of fields is not the header's."""
    pattern = "[" + sep + "]"
    width = F.size(F.split("value", pattern, -1))
    return lines.withColumn("n_fields", width).filter(F.col("n_fields") != header_width)


def validate_delimited(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """One row: lines, header width and number of ragged lines."""
    lines = scan_text(spark, path)
    width = F.size(F.split(F.lit(lines.first()["value"]), "[" + sep + "]", -1))
    return lines.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.first(width).alias("header_width"),
        F.count_if(F.size(F.split("value", "[" + sep + "]", -1)) != width).alias("n_ragged"),
    )
