"""Recommendations over a like graph: users like videos and have friends.

A like is a distinct (customer, part) pair of an order line; customers whose keys
differ by one to three are friends, in both directions; user X has the smallest key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import semi_join
from sparkloom.operators.setops import union_distinct
from sparkloom.plans.registry import Tables, query
from sparkloom.runtime import materialise

LIKES_SQL = """likes AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS video_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
video AS (SELECT p_partkey AS video_id, p_name AS video_name FROM part),
friend AS (SELECT a.c_custkey AS user_id, b.c_custkey AS friend_id FROM customer a
  JOIN (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS step) ON TRUE JOIN customer b ON b.c_custkey = a.c_custkey + step),
x AS (SELECT min(c_custkey) AS x_id FROM customer)
"""


def likes(t: Tables) -> DataFrame:
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("video_id")).distinct())


def videos(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("video_name"))


def friends(t: Tables) -> DataFrame:
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    steps = F.array(*[F.lit(s).cast("bigint") for s in (-3, -2, -1, 1, 2, 3)])
    wanted = users.select("user_id", F.explode(F.transform(steps, lambda s: F.col("user_id") + s)).alias("friend_id"))
    return semi_join(wanted, users.select(F.col("user_id").alias("friend_id")), "friend_id").select("user_id", "friend_id")


def user_x(t: Tables):
    return t.customer.agg(F.min("c_custkey")).scalar()


def top_videos(t: Tables, chosen: DataFrame, n: int = 10) -> DataFrame:
    """Names are joined after the top rows are known."""
    best = (chosen.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_likes"))
            .orderBy(F.desc("num_likes"), "video_id").limit(n))
    return best.join(videos(t), "video_id").select("video_id", "video_name", "num_likes")


TOP_SQL = """SELECT v.video_id, v.video_name, count(*) AS num_likes FROM video v JOIN likes l ON l.video_id = v.video_id
{where} GROUP BY v.video_id, v.video_name ORDER BY num_likes DESC, v.video_id LIMIT 10"""


@query("WITH " + LIKES_SQL + TOP_SQL.format(where=""))
def overall_likes(t: Tables) -> DataFrame:
    return top_videos(t, likes(t))


@query("WITH " + LIKES_SQL + TOP_SQL.format(
    where="WHERE l.user_id IN (SELECT friend_id FROM friend WHERE user_id = (SELECT x_id FROM x))"))
def friend_likes(t: Tables) -> DataFrame:
    f = friends(t).filter(F.col("user_id") == user_x(t)).select(F.col("friend_id").alias("user_id"))
    return top_videos(t, semi_join(likes(t), f, "user_id"))


@query("WITH " + LIKES_SQL + TOP_SQL.format(
    where="""WHERE l.user_id IN (SELECT friend_id FROM friend WHERE user_id = (SELECT x_id FROM x) UNION
 SELECT friend_id FROM friend WHERE user_id IN (SELECT friend_id FROM friend WHERE user_id = (SELECT x_id FROM x)))"""))
def friends_of_friends_likes(t: Tables) -> DataFrame:
    f = friends(t)
    one = f.filter(F.col("user_id") == user_x(t)).select(F.col("friend_id").alias("user_id"))
    two = semi_join(f, one, "user_id").select(F.col("friend_id").alias("user_id"))
    return top_videos(t, semi_join(likes(t), union_distinct(one, two), "user_id"))


@query("WITH " + LIKES_SQL + TOP_SQL.format(
    where="""WHERE l.user_id IN (SELECT user_id FROM likes WHERE video_id IN
 (SELECT video_id FROM likes WHERE user_id = (SELECT x_id FROM x)))"""))
def my_kind_likes(t: Tables) -> DataFrame:
    """Likes of every user who shares a liked video with X (X included)."""
    l = materialise(likes(t), "likes")
    liked = l.filter(F.col("user_id") == user_x(t)).select("video_id")
    kin = semi_join(l, liked, "video_id").select("user_id").distinct()
    return top_videos(t, semi_join(l, kin, "user_id"))


def co_likes(l: DataFrame, x) -> DataFrame:
    """Number of videos each other user shares with X: a semi-join, no pairs."""
    liked = l.filter(F.col("user_id") == x).select("video_id")
    others = l.filter(F.col("user_id") != x)
    return semi_join(others, liked, "video_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_shared"))


@query("WITH " + LIKES_SQL + """SELECT y.user_id, count(*) AS n_shared FROM likes x_l JOIN likes y
  ON x_l.video_id = y.video_id WHERE x_l.user_id = (SELECT x_id FROM x) AND y.user_id <> (SELECT x_id FROM x)
  GROUP BY y.user_id""")
def shared_likes(t: Tables) -> DataFrame:
    return co_likes(likes(t), user_x(t))


@query("WITH " + LIKES_SQL + """, w AS (SELECT y.user_id, log10(1 + count(*)) AS wt FROM likes x_l JOIN likes y
  ON x_l.video_id = y.video_id WHERE x_l.user_id = (SELECT x_id FROM x) AND y.user_id <> (SELECT x_id FROM x)
  GROUP BY y.user_id)
SELECT video_id, video_name, weighted_likes FROM (
  SELECT l.video_id, round(sum(wt), 6) AS weighted_likes FROM likes l JOIN w ON w.user_id = l.user_id
  GROUP BY l.video_id) JOIN video USING (video_id) ORDER BY weighted_likes DESC, video_id LIMIT 10""")
def weighted_recommend(t: Tables) -> DataFrame:
    l = materialise(likes(t), "likes")
    weights = co_likes(l, user_x(t)).select("user_id", F.log10(1 + F.col("n_shared")).alias("wt"))
    best = (l.join(weights, "user_id").groupBy("video_id").agg(F.round(F.sum("wt"), 6).alias("weighted_likes"))
            .orderBy(F.desc("weighted_likes"), "video_id").limit(10))
    return best.join(videos(t), "video_id").select("video_id", "video_name", "weighted_likes")
