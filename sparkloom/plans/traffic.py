"""Congestion reports on road segments: time dimension, selection, densification.

An event is one report; its user is the segment, levels cycle with the event id,
and coordinates follow from the segment id in exact binary fractions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import geo, timeparts
from sparkloom.operators import aggregate, joins, select, sequence
from sparkloom.plans.registry import Tables, query
from sparkloom.runtime import materialise

HOLIDAYS = ["2024-01-01", "2024-01-15"]
BOX = (32.5625, 32.8125, -117.25, -117.03125)
POI = (32.6953125, -117.1171875)
RADIUS_MILES = 5

REPORT_SQL = """report AS (
  SELECT event_id, ts, user_id AS segment_id, (1 + event_id % 5)::INTEGER AS level,
         date_trunc('hour', ts) + to_minutes((minute(ts) // 30) * 30) AS bucket, ts::DATE AS date,
         (isodow(ts) - 1)::INTEGER AS dow, ((hour(ts) * 60 + (minute(ts) // 30) * 30))::INTEGER AS slot
  FROM events),
segment AS (SELECT segment_id, lat1, lon1, lat1 + (segment_id * 7 % 21 - 10) / 1024.0 AS lat2,
         lon1 + (segment_id * 11 % 21 - 10) / 1024.0 AS lon2, 'street_' || (segment_id % 12) AS street,
         (segment_id % 4)::INTEGER AS road_type, segment_id % 9 = 0 AS ignored
  FROM (SELECT user_id AS segment_id, 32.5 + (user_id * 37 % 100) / 256.0 AS lat1,
               -117.3125 + (user_id * 53 % 100) / 256.0 AS lon1 FROM (SELECT DISTINCT user_id FROM events)))
"""


def report(t: Tables) -> DataFrame:
    ts = F.col("ts")
    bucket = timeparts.time_bucket(ts, 30)
    return t.events.select(
        "event_id", "ts", F.col("user_id").alias("segment_id"), (1 + F.col("event_id") % 5).cast("int").alias("level"),
        bucket.alias("bucket"), F.to_date(ts).alias("date"), F.weekday(ts).alias("dow"),
        timeparts.minute_of_day(bucket).alias("slot"))


def segments(t: Tables) -> DataFrame:
    s = F.col("segment_id")
    base = t.events.select(F.col("user_id").alias("segment_id")).distinct().select(
        "segment_id", (F.lit(32.5) + (s * 37 % 100) / F.lit(256.0)).alias("lat1"),
        (F.lit(-117.3125) + (s * 53 % 100) / F.lit(256.0)).alias("lon1"))
    return base.select(
        "segment_id", "lat1", "lon1", (F.col("lat1") + (s * 7 % 21 - 10) / F.lit(1024.0)).alias("lat2"),
        (F.col("lon1") + (s * 11 % 21 - 10) / F.lit(1024.0)).alias("lon2"),
        F.concat(F.lit("street_"), (s % 12).cast("string")).alias("street"), (s % 4).cast("int").alias("road_type"),
        (s % 9 == 0).alias("ignored"))


def buckets(t: Tables) -> DataFrame:
    return report(t).select("bucket", "date", "dow", "slot").distinct()


def text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that any reader compares them alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if k in ("date", "timestamp_ntz") else F.col(c)
                       for c, k in df.dtypes])


@query("""SELECT event_id, (isodow(ts) - 1)::INTEGER AS day_of_week, month(ts)::INTEGER AS month, ts::DATE::VARCHAR AS date,
  (hour(ts) * 60 + minute(ts))::INTEGER AS minute_of_day,
  (date_trunc('hour', ts) + to_minutes((minute(ts) // 5) * 5))::VARCHAR AS bucket FROM events""")
def date_parts(t: Tables) -> DataFrame:
    parts = timeparts.date_parts(F.col("ts"), 5)
    return text(t.events.select("event_id", *[c.alias(n) for n, c in parts.items()]))


@query("WITH " + REPORT_SQL + """SELECT bucket::VARCHAR AS bucket, isodow(bucket) >= 6 AS is_weekend,
  bucket::DATE IN (DATE '2024-01-01', DATE '2024-01-15') AS is_holiday,
  (slot BETWEEN 420 AND 540) OR (slot BETWEEN 960 AND 1140) AS is_rushhour FROM (SELECT DISTINCT bucket, slot FROM report)""")
def calendar_flags(t: Tables) -> DataFrame:
    flags = timeparts.calendar_flags(F.col("bucket"), HOLIDAYS)
    return text(buckets(t).select("bucket", *[c.alias(n) for n, c in flags.items()]))


@query("WITH " + REPORT_SQL + """SELECT bucket::VARCHAR AS bucket, segment_id, min(level) AS min_level, max(level) AS max_level,
  round(avg(level), 6) AS avg_level, count(*) AS n FROM report GROUP BY bucket, segment_id""")
def level_stats(t: Tables) -> DataFrame:
    out = aggregate.level_stats(report(t), ["bucket", "segment_id"], "level")
    return text(out.withColumn("avg_level", F.round("avg_level", 6)))


@query("WITH " + REPORT_SQL + """, daily AS (SELECT segment_id, date, dow, slot, max(level) AS m FROM report GROUP BY ALL)
SELECT segment_id, dow, slot, round(avg(m), 6) AS share FROM daily GROUP BY ALL""")
def traffic_share(t: Tables) -> DataFrame:
    out = aggregate.mean_of_daily_max(report(t), "segment_id", "date", "dow", "slot", "level")
    return out.withColumn("share", F.round("share", 6))


@query("WITH " + REPORT_SQL + """, f AS (SELECT bucket, segment_id, max(level) AS level, count(*) AS n FROM report GROUP BY ALL),
s AS (SELECT segment_id FROM segment), b AS (SELECT DISTINCT bucket, dow, slot FROM report)
SELECT s.segment_id, b.bucket::VARCHAR AS bucket, dow, slot, coalesce(f.level, 0) AS level, coalesce(f.n, 0) AS n,
  least(1, coalesce(f.n, 0))::INTEGER AS level_binary FROM s, b
LEFT JOIN f ON f.segment_id = s.segment_id AND f.bucket = b.bucket""")
def modelling_grid(t: Tables) -> DataFrame:
    """Every segment in every bucket; 0 means no congestion was reported."""
    return text(grid(t))


def grid(t: Tables) -> DataFrame:
    facts = report(t).groupBy("segment_id", "bucket").agg(F.max("level").alias("level"), F.count(F.lit(1)).alias("n"))
    full = joins.densify(segments(t).select("segment_id"), buckets(t).select("bucket", "dow", "slot"), facts,
                         ["segment_id", "bucket"], {"level": 0, "n": 0})
    return full.select("segment_id", "bucket", "dow", "slot", "level", F.col("n").cast("bigint").alias("n"),
                       F.least(F.lit(1), F.col("n")).cast("int").alias("level_binary"))


# Five special events and three games (start, end).
SPECIAL_EVENTS = [
    ("Comic Fair", "2024-01-04 10:00:00", "2024-01-06 18:00:00"),
    ("Half-Marathon", "2024-01-07 06:30:00", "2024-01-07 12:30:00"),
    ("Boat Show", "2024-01-12 09:00:00", "2024-01-14 17:00:00"),
    ("Boat Show", "2024-01-14 16:00:00", "2024-01-14 20:00:00"),
    ("Jazz Night", "2024-01-20 19:00:00", "2024-01-20 23:59:00"),
]
GAMES = [
    ("2024-01-05 19:10:00", "2024-01-05 22:00:00"),
    ("2024-01-13 13:10:00", "2024-01-13 16:20:00"),
    ("2024-01-21 12:00:00", "2024-01-21 15:05:00"),
]


def clean_title(title):
    """Punctuation removed, spaces as underscores."""
    return F.regexp_replace(F.regexp_replace(title, r"\p{Punct}", ""), " ", "_")


def literal_intervals(t: Tables) -> DataFrame:
    rows = ", ".join(f"('{a}', timestamp_ntz'{b}', timestamp_ntz'{c}')" for a, b, c in SPECIAL_EVENTS)
    raw = t.spark.sql(f"SELECT * FROM VALUES {rows} AS v(title, event_start, event_end)")
    return raw.withColumn("title", F.concat(F.lit("event_"), clean_title(F.col("title"))))


_EVENT_VALUES = ", ".join(f"('{a}', TIMESTAMP '{b}', TIMESTAMP '{c}')" for a, b, c in SPECIAL_EVENTS)
_TITLES = ["event_Comic_Fair", "event_HalfMarathon", "event_Boat_Show", "event_Jazz_Night"]


@query("WITH " + REPORT_SQL + f""", e AS (SELECT 'event_' || replace(replace(title, '-', ''), ' ', '_') AS title,
  s - INTERVAL 1 HOUR AS lo, f + INTERVAL 1 HOUR AS hi FROM (VALUES {_EVENT_VALUES}) v(title, s, f))
SELECT event_id, """ + ", ".join(
    f"(EXISTS (SELECT 1 FROM e WHERE title = '{x}' AND ts BETWEEN lo AND hi))::INTEGER AS \"{x}\"" for x in _TITLES)
    + " FROM report")
def special_event_flags(t: Tables) -> DataFrame:
    return joins.flag_active_few(t.events.select("event_id", "ts"), "ts", literal_intervals(t), "title",
                                 "event_start", "event_end", "1 hour", "1 hour", _TITLES).drop("ts")


_GAME_VALUES = ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in GAMES)


@query("WITH " + REPORT_SQL + f""", g AS (SELECT * FROM (VALUES {_GAME_VALUES}) v(s, f)),
w AS (SELECT s - INTERVAL 2 HOUR AS lo, s + INTERVAL 30 MINUTE AS hi FROM g
      UNION ALL SELECT f - INTERVAL 30 MINUTE, f + INTERVAL 1 HOUR FROM g)
SELECT bucket::VARCHAR AS bucket, (EXISTS (SELECT 1 FROM w WHERE bucket BETWEEN lo AND hi))::INTEGER AS game
FROM (SELECT DISTINCT bucket FROM report)""")
def game_flags(t: Tables) -> DataFrame:
    """Active from two hours before to half an hour after a start, and around an end."""
    rows = ", ".join(f"(timestamp_ntz'{a}', timestamp_ntz'{b}')" for a, b in GAMES)
    windows = t.spark.sql(f"""WITH g AS (SELECT * FROM VALUES {rows} AS v(s, f))
      SELECT 'game' AS title, s - interval 2 hours AS lo, s + interval 30 minutes AS hi FROM g
      UNION ALL SELECT 'game', f - interval 30 minutes, f + interval 1 hour FROM g""")
    pts = buckets(t).select("bucket")
    return text(joins.flag_active_intervals(pts, "bucket", "bucket", windows, "title", "lo", "hi", "0 hours", "0 hours", ["game"]))


# ---- selection ------------------------------------------------------------

@query("WITH " + REPORT_SQL + """SELECT event_id FROM report WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""")
def reports_in_dates(t: Tables) -> DataFrame:
    return select.within_dates(t.events, "ts", "2024-01-05", "2024-01-09").select("event_id")


@query("WITH " + REPORT_SQL + """SELECT DISTINCT bucket::VARCHAR AS bucket FROM report
  WHERE slot BETWEEN 360 AND 600 OR slot BETWEEN 900 AND 1110""")
def times_in_windows(t: Tables) -> DataFrame:
    return text(buckets(t).filter(select.in_any_window(F.col("slot"), [(360, 600), (900, 1110)])).select("bucket"))


@query("WITH " + REPORT_SQL + """SELECT DISTINCT bucket::VARCHAR AS bucket FROM report
  WHERE date NOT IN (DATE '2024-01-01', DATE '2024-01-15')""")
def times_excluding_dates(t: Tables) -> DataFrame:
    days = [F.lit(h).cast("date") for h in HOLIDAYS]
    return text(select.excluding(buckets(t), F.col("date"), days).select("bucket"))


@query("WITH " + REPORT_SQL + "SELECT DISTINCT bucket::VARCHAR AS bucket FROM report WHERE dow = 2")
def times_on_weekday(t: Tables) -> DataFrame:
    return text(buckets(t).filter(F.col("dow") == 2).select("bucket"))


_IN_BOX = f"""least(lat1, lat2) >= {BOX[0]} AND greatest(lat1, lat2) <= {BOX[1]} AND least(lon1, lon2) >= {BOX[2]}
  AND greatest(lon1, lon2) <= {BOX[3]} AND (lat1 <> lat2 OR lon1 <> lon2)"""


def segments_in_bbox(seg: DataFrame, box=BOX) -> DataFrame:
    lat = [F.col("lat1"), F.col("lat2")]
    lon = [F.col("lon1"), F.col("lon2")]
    return seg.filter((F.least(*lat) >= box[0]) & (F.greatest(*lat) <= box[1]) & (F.least(*lon) >= box[2])
                      & (F.greatest(*lon) <= box[3]) & ((lat[0] != lat[1]) | (lon[0] != lon[1])))


@query("WITH " + REPORT_SQL + "SELECT segment_id, lat1, lon1, lat2, lon2 FROM segment WHERE " + _IN_BOX)
def segments_in_box(t: Tables) -> DataFrame:
    return segments_in_bbox(segments(t)).select("segment_id", "lat1", "lon1", "lat2", "lon2")


def segments_within_radius(seg: DataFrame, poi=POI, miles: float = RADIUS_MILES) -> DataFrame:
    """A box around the point goes first: it is cheap and reaches the scan."""
    meters = round(miles * geo.METERS_PER_MILE)
    reach = meters / geo.METERS_PER_DEGREE * 1.001
    near = seg.filter((F.least("lat1", "lat2") <= poi[0] + reach) & (F.greatest("lat1", "lat2") >= poi[0] - reach))
    away = geo.meters_to_segment(poi[0], poi[1], *[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")])
    return near.withColumn("meters", away).filter(F.col("meters") <= meters)


@query("WITH " + REPORT_SQL + f""", p AS (SELECT *, cos(radians({POI[0]})) * 111194.92664455873 AS kx, 111194.92664455873 AS ky FROM segment),
d AS (SELECT segment_id, (lon1 - {POI[1]}) * kx AS ax, (lat1 - {POI[0]}) * ky AS ay, (lon2 - lon1) * kx AS dx, (lat2 - lat1) * ky AS dy FROM p),
u AS (SELECT *, CASE WHEN dx*dx + dy*dy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, -(ax*dx + ay*dy) / (dx*dx + dy*dy))) END AS k FROM d)
SELECT segment_id, round(sqrt((ax + k*dx) ** 2 + (ay + k*dy) ** 2), 3) AS meters FROM u
WHERE sqrt((ax + k*dx) ** 2 + (ay + k*dy) ** 2) <= round({RADIUS_MILES} * 1609.344)""")
def segments_near_point(t: Tables) -> DataFrame:
    return segments_within_radius(segments(t)).select("segment_id", F.round("meters", 3).alias("meters"))


@query("WITH " + REPORT_SQL + "SELECT segment_id, street, road_type FROM segment WHERE street = 'street_3' OR road_type = 2")
def segments_on_street_or_type(t: Tables) -> DataFrame:
    seg = segments(t)
    on_street = seg.filter(F.col("street") == "street_3")
    of_type = seg.filter(F.col("road_type") == 2)
    return on_street.unionByName(of_type).distinct().select("segment_id", "street", "road_type")


@query("WITH " + REPORT_SQL + "SELECT segment_id FROM segment WHERE ignored")
def segments_ignored(t: Tables) -> DataFrame:
    return segments(t).filter("ignored").select("segment_id")


@query("""SELECT user_id AS segment_id, round((('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT) / 4294967296.0, 9) AS share
FROM (SELECT DISTINCT user_id FROM events)
WHERE ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.3""")
def sample_segments(t: Tables) -> DataFrame:
    picked = select.sample_by_key(segments(t).select("segment_id"), "segment_id", 30)
    return picked.withColumn("share", F.round(select.hash_share(F.col("segment_id")), 9))


@query()
def sample_reports(t: Tables) -> DataFrame:
    """Bernoulli sample of the reports; which rows it holds is the engine's choice."""
    return select.sample_rows(t.events.select("event_id", "user_id"), 20, seed=11)


SHARE_SQL = """, c AS (SELECT segment_id, count(DISTINCT bucket) AS n FROM {src} GROUP BY 1),
h AS (SELECT n, count(*) AS e FROM c GROUP BY 1),
w AS (SELECT n, sum(e) OVER (ORDER BY n DESC) / sum(e) OVER () AS ce, sum(e * n) OVER (ORDER BY n DESC) / sum(e * n) OVER () AS cp FROM h)
"""


@query("WITH " + REPORT_SQL + SHARE_SQL.format(src="report") + """SELECT segment_id, c.n, round(ce * 100, 4) AS cum_entity_pct,
  round(cp * 100, 4) AS cum_pos_pct FROM c JOIN w ON c.n = w.n""")
def cumulative_segment_pct(t: Tables) -> DataFrame:
    return sequence.cumulative_pct(report(t), "segment_id", "bucket")


@query("WITH " + REPORT_SQL + """, c AS (SELECT bucket, count(DISTINCT segment_id) AS n FROM report GROUP BY 1),
h AS (SELECT n, count(*) AS e FROM c GROUP BY 1),
w AS (SELECT n, sum(e) OVER (ORDER BY n DESC) / sum(e) OVER () AS ce, sum(e * n) OVER (ORDER BY n DESC) / sum(e * n) OVER () AS cp FROM h)
SELECT bucket::VARCHAR AS bucket, c.n, round(ce * 100, 4) AS cum_entity_pct, round(cp * 100, 4) AS cum_pos_pct FROM c JOIN w ON c.n = w.n
WHERE round(cp * 100, 4) <= 80""")
def times_covering_80_pct(t: Tables) -> DataFrame:
    return text(sequence.covering(sequence.cumulative_pct(report(t), "bucket", "segment_id"), 80.0))


@query("WITH " + REPORT_SQL + """, c AS (SELECT segment_id, count(*) AS n FROM report GROUP BY 1),
h AS (SELECT n, count(*) AS e FROM c GROUP BY 1), w AS (SELECT n, sum(e) OVER (ORDER BY e DESC) / sum(e) OVER () AS p FROM h)
SELECT s.segment_id, coalesce(round(p, 4), 0.0) AS cum_pct FROM segment s LEFT JOIN c ON c.segment_id = s.segment_id LEFT JOIN w ON w.n = c.n""")
def cumulative_segment_pct_by_freq(t: Tables) -> DataFrame:
    return sequence.cumulative_pct_by_freq(report(t), segments(t).select("segment_id"), "segment_id")


@query("WITH " + REPORT_SQL + ", one AS (SELECT * FROM segment WHERE " + _IN_BOX + "), r AS (SELECT report.* FROM report JOIN one USING (segment_id))"
       + SHARE_SQL.format(src="r") + """SELECT segment_id FROM c JOIN w ON c.n = w.n JOIN segment USING (segment_id)
  WHERE round(cp * 100, 4) <= 70 AND NOT ignored""")
def select_chain_segments(t: Tables) -> DataFrame:
    """Box first, then the most active 70 % of what is left, then no ignored ones."""
    rep = report(t)

    def most_active(current):
        inside = rep.join(current, "segment_id", "left_semi")
        return sequence.covering(sequence.cumulative_pct(inside, "segment_id", "bucket"), 70.0)

    steps = [segments_in_bbox, most_active, lambda d: d.filter(~F.col("ignored"))]
    return select.select_chain(segments(t), "segment_id", steps).select("segment_id")


# ---- paths, keys and geometry ---------------------------------------------

PATH_SQL = """path AS (SELECT event_id, date_trunc('hour', ts) + to_minutes((minute(ts) // 30) * 30) AS bucket,
  list_transform(range(0, 2 + event_id % 4), lambda i: ['-117.' || lpad(((user_id * 13 + i * 7) % 40 + 10)::VARCHAR, 3, '0'),
                                                        '32.' || lpad(((user_id * 29 + i * 3) % 40 + 10)::VARCHAR, 3, '0')]) AS pts FROM events),
step AS (SELECT event_id, bucket, i AS path, pts[i][2]::DOUBLE AS lat1, pts[i][1]::DOUBLE AS lon1,
  pts[i + 1][2]::DOUBLE AS lat2, pts[i + 1][1]::DOUBLE AS lon2
  FROM (SELECT *, unnest(range(1, len(pts))) AS i FROM path)),
seg_key AS (SELECT *, row_number() OVER (ORDER BY lat1, lon1, lat2, lon2) AS segment_id
  FROM (SELECT DISTINCT lat1, lon1, lat2, lon2 FROM step)),
time_key AS (SELECT bucket, row_number() OVER (ORDER BY bucket) AS time_id FROM (SELECT DISTINCT bucket FROM step))
"""


def linestrings(t: Tables) -> DataFrame:
    """Each report with a WKT path of two to five points."""
    u = F.col("user_id")
    pts = F.transform(F.sequence(F.lit(0).cast("bigint"), 1 + F.col("event_id") % 4), lambda i: F.concat(
        F.lit("-117."), F.lpad(((u * 13 + i * 7) % 40 + 10).cast("string"), 3, "0"),
        F.lit(" 32."), F.lpad(((u * 29 + i * 3) % 40 + 10).cast("string"), 3, "0")))
    wkt = F.concat(F.lit("LINESTRING ("), F.array_join(pts, ", "), F.lit(")"))
    return t.events.select("event_id", timeparts.time_bucket(F.col("ts"), 30).alias("bucket"), wkt.alias("wkt"))


def path_steps(t: Tables) -> DataFrame:
    parsed = linestrings(t).select("event_id", "bucket", geo.parse_linestring(F.col("wkt")).alias("pts"))
    return (parsed.select("event_id", "bucket", F.posexplode(geo.consecutive_pairs(F.col("pts"))).alias("pos", "s"))
            .select("event_id", "bucket", (F.col("pos") + 1).cast("bigint").alias("path"), "s.*"))


@query("WITH " + PATH_SQL + """SELECT event_id, len(pts) AS n_points, pts[1][1]::DOUBLE AS first_lon, pts[len(pts)][2]::DOUBLE AS last_lat FROM path""")
def parse_linestrings(t: Tables) -> DataFrame:
    p = linestrings(t).withColumn("pts", geo.parse_linestring(F.col("wkt")))
    return p.select("event_id", F.size("pts").cast("bigint").alias("n_points"), F.col("pts")[0]["lon"].alias("first_lon"),
                    F.element_at("pts", -1)["lat"].alias("last_lat"))


@query("WITH " + PATH_SQL + """SELECT event_id, path, time_id, segment_id FROM step JOIN seg_key USING (lat1, lon1, lat2, lon2)
  JOIN time_key USING (bucket)""")
def path_bridge(t: Tables) -> DataFrame:
    """One row per report and path position with surrogate keys of time and segment."""
    steps = materialise(path_steps(t), "steps")
    keys = ["lat1", "lon1", "lat2", "lon2"]
    with_seg = sequence.attach_dense_key(steps, keys, "segment_id")
    times = sequence.dense_key(steps, ["bucket"], "time_id")
    return with_seg.join(times, "bucket").select("event_id", "path", "time_id", "segment_id")


@query("WITH " + PATH_SQL + "SELECT lat1, lon1, lat2, lon2, segment_id FROM seg_key")
def segment_keys(t: Tables) -> DataFrame:
    return sequence.dense_key(path_steps(t), ["lat1", "lon1", "lat2", "lon2"], "segment_id")


@query("WITH " + REPORT_SQL + """, a AS (SELECT *, CASE WHEN lat1 <> lat2 OR lon1 <> lon2 THEN
  (degrees(atan2(lon2 - lon1, lat2 - lat1)) + 360.0) % 360.0 END AS az FROM segment)
SELECT segment_id, round(sqrt((lat2-lat1)**2 + (lon2-lon1)**2), 9) AS seg_length, round(az, 6) AS azimuth,
  CASE WHEN az > 315 OR az <= 45 THEN 1 WHEN az <= 135 THEN 2 WHEN az <= 225 THEN 3 WHEN az <= 315 THEN 4 END AS direction FROM a""")
def segment_geometry(t: Tables) -> DataFrame:
    c = [F.col(x) for x in ("lat1", "lon1", "lat2", "lon2")]
    return segments(t).select("segment_id", F.round(geo.segment_length(*c), 9).alias("seg_length"),
                              F.round(geo.azimuth(*c), 6).alias("azimuth"), geo.segment_direction(*c).alias("direction"))


@query("WITH " + REPORT_SQL + """SELECT segment_id, lat1 AS lat, lon1 AS lon, round((1 + segment_id % 3) * 1609.344)::DOUBLE AS meters FROM segment""")
def parse_coordinates(t: Tables) -> DataFrame:
    """Coordinates written as text with compass letters and read back."""
    written = segments(t).select("segment_id", F.concat(F.col("lat1").cast("string"), F.lit(" N, "), (-F.col("lon1")).cast("string"), F.lit(" W")).alias("place"))
    lat, lon = geo.parse_latlon(F.col("place"))
    return written.select("segment_id", lat.alias("lat"), lon.alias("lon"),
                          geo.miles_to_meters(1 + F.col("segment_id") % 3).cast("double").alias("meters"))


@query("WITH " + REPORT_SQL + """SELECT event_id, segment_id FROM report JOIN segment USING (segment_id)
  WHERE lat1 BETWEEN 32.5625 AND 32.8125 AND lon1 BETWEEN -117.25 AND -117.03125""")
def reports_in_range_box(t: Tables) -> DataFrame:
    near = select.within_box(segments(t), "lat1", "lon1", BOX).select("segment_id")
    return report(t).join(near, "segment_id").select("event_id", "segment_id")


@query("WITH " + REPORT_SQL + """, b AS (SELECT min(lat1) a, max(lat1) b, min(lon1) c, max(lon1) d FROM segment WHERE road_type = 1)
SELECT segment_id FROM segment, b WHERE lat1 BETWEEN a AND b.b AND lon1 BETWEEN c AND d""")
def segments_in_extent(t: Tables) -> DataFrame:
    """Segments inside the extent of one road type."""
    seg = segments(t)
    return select.within_box_of(seg, "lat1", "lon1", seg.filter("road_type = 1"), "lat1", "lon1").select("segment_id")


@query("WITH " + REPORT_SQL + """SELECT road_type, min(lat1) AS lat_min, max(lat1) AS lat_max, min(lon1) AS lon_min, max(lon1) AS lon_max
  FROM segment GROUP BY road_type""")
def bounding_boxes(t: Tables) -> DataFrame:
    return aggregate.bounding_box(segments(t), "lat1", "lon1", ["road_type"])


# ---- entities over time ----------------------------------------------------

@query("""SELECT user_id, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts, count(*) AS n,
  date_sub('second', min(ts), max(ts)) / 60.0 AS minutes FROM events GROUP BY user_id
  HAVING date_sub('second', min(ts), max(ts)) / 60.0 > 1440""")
def entity_lifespans(t: Tables) -> DataFrame:
    return text(aggregate.entity_lifespan(t.events, "user_id", "ts").filter(F.col("minutes") > 1440))


@query("""SELECT n_values, count(*) AS n_entities FROM (SELECT user_id, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1) GROUP BY 1""")
def values_per_entity(t: Tables) -> DataFrame:
    return aggregate.values_per_entity_histogram(t.events, "user_id", "event_type")


@query("""SELECT event_id, user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)::VARCHAR AS previous_ts FROM events""")
def entity_timeline(t: Tables) -> DataFrame:
    out = sequence.entity_timeline(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")
    return text(out.select("event_id", "user_id", "previous_ts"))


@query("""SELECT event_id, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE)::INTEGER AS date_idx,
  (hour(ts) * 60 + minute(ts))::INTEGER AS time_idx FROM events""")
def date_time_index(t: Tables) -> DataFrame:
    return timeparts.date_index(t.events.select("event_id", "ts"), "ts").drop("ts")


@query("WITH " + REPORT_SQL + """SELECT DISTINCT slot, (CASE WHEN slot // 60 % 12 = 0 THEN 12 ELSE slot // 60 % 12 END) || ':' ||
  lpad((slot % 60)::VARCHAR, 2, '0') || CASE WHEN slot < 720 THEN ' a.m.' ELSE ' p.m.' END AS label FROM report""")
def clock_labels(t: Tables) -> DataFrame:
    return buckets(t).select("slot", timeparts.clock_label(F.col("bucket")).alias("label")).distinct()


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed, (o_orderkey % 5 * 60 + o_orderkey % 60) AS minutes,
  (o_orderdate + to_minutes(o_orderkey % 5 * 60 + o_orderkey % 60))::VARCHAR AS ends FROM orders""")
def parse_dates(t: Tables) -> DataFrame:
    """Dates in three notations and an ``h:mm`` duration, rendered and read back."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(k % 3 == 0, F.date_format(d, "EEEE MMM d yyyy")).when(k % 3 == 1, F.date_format(d, "MM/dd/yy")).otherwise(
        F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    length = F.concat((k % 5).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    lines = t.orders.select("o_orderkey", written.alias("w"), length.alias("len"))
    day = F.coalesce(timeparts.parse_date(F.regexp_replace("w", "^[A-Za-z]+ ", ""), "MMM d yyyy"),
                     timeparts.parse_date(F.col("w"), "MM/dd/yy", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    parsed = lines.select("o_orderkey", day.alias("p"), timeparts.parse_duration(F.col("len")).alias("m"))
    return parsed.select("o_orderkey", F.col("p").cast("string").alias("parsed"), F.col("m").cast("bigint").alias("minutes"),
                         timeparts.add_minutes(F.col("p"), F.col("m")).cast("string").alias("ends"))
