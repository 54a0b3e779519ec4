"""Explicit schemas of the inputs the library reads (DDL strings)."""

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
ORDER_LINE = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"
PRICE = "date string, price double"
SPECIAL_EVENT = "title string, event_start timestamp_ntz, event_end timestamp_ntz, attendance int, latitude double, longitude double"
REPORT = ("uuid bigint, ts timestamp_ntz, street string, start_node string, end_node string, city string, "
          "length int, delay int, speed double, level int, road_type int, geom string")
SEGMENT = ("lat1 double, lon1 double, lat2 double, lon2 double, segment_id int, street string, city string, "
           "road_type int, geom string, direction int, seg_length double")
BRIDGE = "uuid_instance_id int, path int, time_id int, segment_id int"
POST = ("created_at string, id_str string, text string, user struct<id_str: string, name: string, screen_name: string>, "
        "retweeted_status string, entities struct<hashtags: array<struct<text: string>>, urls: array<struct<url: string>>>")
STATION_YEAR = ("station string, measurement string, year int, latitude double, longitude double, elevation double, "
                "vector array<double>")
REVIEW = ("reviewerID string, itemID string, rating double, price double, summary string, reviewText string, "
          "helpful struct<nHelpful: int, outOf: int>, categories array<array<string>>, reviewHash string, unixReviewTime bigint")
MATCH = "home string, away string, home_score bigint, away_score bigint"
POINT = "name string, lat double, lon double"
TRIPLET = "doc_id bigint, word_id bigint, count bigint"
