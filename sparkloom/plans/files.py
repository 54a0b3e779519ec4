"""Sources and sinks: rows of the driver tables written out and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import select
from sparkloom.operators import text as corpus
from sparkloom.operators.sequence import attach_dense_key
from sparkloom.plans.profiles import prices
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.traffic import REPORT_SQL, report, segments
from sparkloom.plans.texts import TOK_SQL
from sparkloom.runtime import materialise, scratch_path
from sparkloom.sources import readers, schemas, sinks

_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query(_CUSTOMER_SQL)
def csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    sinks.write_csv(t.customer, path)
    return readers.scan_csv(t.spark, path, schemas.CUSTOMER)


@query(_CUSTOMER_SQL)
def json_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "json")
    sinks.write_json(t.customer, path)
    return readers.scan_json(t.spark, path, schemas.CUSTOMER)


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def parquet_partitions(t: Tables) -> DataFrame:
    """Partitioned by a column, so that a filter on it skips whole folders."""
    path = scratch_path(t.spark, "parquet")
    sinks.write_parquet(t.events.select("event_id", "user_id", "value", "event_type"), path, ["event_type"])
    return readers.scan_parquet(t.spark, path).filter("event_type = 'click'").drop("event_type")


@query("SELECT doc_id, source, md5(text) AS digest, n_chars FROM documents")
def gz_records(t: Tables) -> DataFrame:
    """Gzipped nested records."""
    path = scratch_path(t.spark, "gz")
    sinks.write_json(t.docs.select("doc_id", "text", F.struct("source", "n_chars").alias("meta")), path, gzip=True)
    rows = readers.scan_gz_records(t.spark, path, "doc_id bigint, text string, meta struct<source: string, n_chars: bigint>")
    return rows.select("doc_id", "meta.source", F.md5("text").alias("digest"), "meta.n_chars")


@query(r"SELECT len(string_split(text, chr(10))) AS n_lines, count(*) AS n FROM documents GROUP BY 1")
def text_lines(t: Tables) -> DataFrame:
    """Every line of every document, tagged with its document, written as text and counted."""
    path = scratch_path(t.spark, "text")
    lines = t.docs.select("doc_id", F.explode(F.split("text", r"\n")).alias("line"))
    safe = lines.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("line", r"[\r\u0085\u2028\u2029]", " ")).alias("value"))
    safe.write.mode("overwrite").text(path)
    back = readers.scan_text(t.spark, [path])
    per = back.groupBy(F.substring_index("value", "\t", 1).alias("d")).agg(F.count(F.lit(1)).alias("n_lines"))
    return per.groupBy("n_lines").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_custkey, o_orderpriority AS priority, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS price,
  lpad((o_orderkey % 100)::VARCHAR, 3, '0') AS code FROM orders""")
def fixed_width(t: Tables) -> DataFrame:
    """Column slices of fixed-width lines, wide enough for any bigint, with '.' for missing numbers."""
    path = scratch_path(t.spark, "fixed")
    price = F.when(F.col("o_orderkey") % 6 == 0, ".").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    line = F.concat(F.rpad(F.col("o_orderkey").cast("string"), 20, " "), F.lpad(F.col("o_custkey").cast("string"), 20, " "),
                    F.rpad("o_orderpriority", 20, " "), F.lpad(price, 14, " "), F.rpad((F.col("o_orderkey") % 100).cast("string"), 3, " "))
    t.orders.select(line.alias("value")).write.mode("overwrite").text(path)
    specs = [("o_orderkey", 0, 20, "bigint"), ("o_custkey", 20, 40, "bigint"), ("priority", 40, 60), ("price", 60, 74, "double"), ("code", 74, 77, "string", 3)]
    return readers.scan_fixed_width(t.spark, path, specs)


@query("WITH " + TOK_SQL + """, ids AS (SELECT term, row_number() OVER (ORDER BY term) AS word_id FROM (SELECT DISTINCT term FROM dt))
SELECT doc_id, word_id, count FROM dt JOIN ids USING (term)""")
def triplets(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "triplets")
    terms = attach_dense_key(materialise(corpus.doc_terms(t.docs, "doc_id", "text"), "terms"), ["term"], "word_id")
    sinks.write_triplets(terms.select("doc_id", "word_id", "count"), path)
    return readers.scan_triplets(t.spark, path)


@query("""SELECT ts::DATE::VARCHAR AS date, round(avg(value), 6) AS price, event_type AS key FROM events WHERE event_type <> 'view' GROUP BY ALL""")
def per_key_files(t: Tables) -> DataFrame:
    """One file per ticker, named after it; files of tickers that are not wanted are never opened."""
    path = scratch_path(t.spark, "tickers")
    rows = prices(t).select(F.col("date").cast("string").alias("date"), "price", F.col("ticker").alias("key"))
    sinks.write_per_key_files(rows, "key", path)
    return readers.scan_per_key_files(t.spark, path, schemas.PRICE, omit=["view"])


@query("""SELECT 'block=' || (o_orderkey % 64) AS block, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE ('0x' || substr(md5('block=' || (o_orderkey % 64)), 1, 8))::BIGINT / 4294967296.0 < 0.2 GROUP BY 1""")
def sample_blocks(t: Tables) -> DataFrame:
    """A fifth of the files of a table; the others are not opened."""
    path = scratch_path(t.spark, "blocks")
    t.orders.withColumn("block", F.col("o_orderkey") % 64).repartition("block").write.partitionBy("block").parquet(path)
    name = F.regexp_extract("_metadata.file_path", r"/(block=\d+)/", 1)
    drawn = select.sample_blocks(t.spark.read.parquet(path).select("o_totalprice", "_metadata", name.alias("block")), 20, name)
    return drawn.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH'")
def table_roundtrip(t: Tables) -> DataFrame:
    """Catalog table replaced and read with pushed projection and predicate."""
    name = "orders_" + uuid.uuid4().hex
    sinks.write_table(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), name, scratch_path(t.spark, "table"))
    back = readers.scan_table(t.spark, name, ["o_orderkey", "o_totalprice"], "o_orderpriority = '2-HIGH'")
    t.spark.sql(f"DROP TABLE {name}")  # the name goes; the files stay in the scratch folder until the application ends
    return back


@query("WITH " + REPORT_SQL + "SELECT 'p' || segment_id AS name, lon1 AS lon, lat1 AS lat FROM segment")
def point_places(t: Tables) -> DataFrame:
    """Delimited file loaded into a table with a point column."""
    path, name = scratch_path(t.spark, "points"), "points_" + uuid.uuid4().hex
    rows = segments(t).select(F.concat(F.lit("p"), F.col("segment_id").cast("string")).alias("name"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon"))
    sinks.write_csv(rows, path)
    sinks.load_delimited_into(t.spark, path, schemas.POINT, name, "lat", "lon", scratch_path(t.spark, "table"))
    back = readers.scan_table(t.spark, name, ["name", "point"]).select("name", "point.lon", "point.lat")
    t.spark.sql(f"DROP TABLE {name}")
    return back


@query("""SELECT count(*) AS n_lines, 4::INTEGER AS header_width, count(*) FILTER (WHERE o_orderkey % 13 = 5) AS n_ragged FROM orders""")
def validate_delimited(t: Tables) -> DataFrame:
    """Lines, header width, and rows whose number of fields differs."""
    path = scratch_path(t.spark, "ragged")
    extra = F.when(F.col("o_orderkey") % 13 == 5, F.lit("surplus"))
    lines = t.orders.select(F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", extra).alias("value"))
    lines.write.mode("overwrite").text(path)
    return readers.validate_delimited(t.spark, path)


@query("WITH " + REPORT_SQL + """SELECT segment_id, 'LineString' AS kind, street, lon1 AS first_lon, lat2 AS last_lat, n FROM segment
  JOIN (SELECT segment_id, count(*) AS n FROM report GROUP BY 1) USING (segment_id)""")
def geojson_features(t: Tables) -> DataFrame:
    """Segments with their report counts as GeoJSON features, written and parsed again."""
    path = scratch_path(t.spark, "geojson")
    sinks.write_geojson(features(t), path)
    parsed = readers.scan_json(t.spark, path, "type string, geometry struct<type: string, coordinates: array<array<double>>>, "
                               "properties struct<segment_id: bigint, street: string, n: bigint>")
    return parsed.select("properties.segment_id", F.col("geometry.type").alias("kind"), "properties.street",
                         F.col("geometry.coordinates")[0][0].alias("first_lon"), F.col("geometry.coordinates")[1][1].alias("last_lat"), "properties.n")


def features(t: Tables) -> DataFrame:
    counts = report(t).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))
    rows = segments(t).join(counts, "segment_id")
    line = F.array(F.array("lon1", "lat1"), F.array("lon2", "lat2"))
    return rows.select(sinks.line_feature(line, F.struct("segment_id", "street", "n")).alias("feature"))


@query("WITH " + REPORT_SQL + "SELECT count(DISTINCT segment_id) AS n_features, 'FeatureCollection' AS kind FROM segment")
def geojson_document(t: Tables) -> DataFrame:
    """The same features as one document, written in parallel; its lines are read again, one feature each."""
    path = scratch_path(t.spark, "collection")
    sinks.write_feature_collection(features(t), path)
    lines = readers.scan_text(t.spark, [path]).select(F.regexp_replace("value", "^,", "").alias("value"))
    feature = F.get_json_object("value", "$.type") == "Feature"
    kind = F.max(F.regexp_extract("value", r'^\{"type":"(FeatureCollection)","features":\[$', 1))
    return lines.agg(F.count_if(feature).alias("n_features"), kind.alias("kind"))
