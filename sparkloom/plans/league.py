"""League: matches between nations, points, coaches and boards.

All pairings of a customer nation (home) and a supplier nation (away) that trade.
A score is a small number from the counts of returned and accepted lines plus the
strength of the team, which makes ties, an undefeated leader and a team that only the
leader beats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import joins, setops
from sparkloom.operators.aggregate import league_points
from sparkloom.operators.select import count_where
from sparkloom.plans.registry import Tables, query
from sparkloom.runtime import cut_lineage

LEAGUE_SQL = """teams AS (SELECT n_name AS name, 'coach_' || n_nationkey AS coach FROM nation),
matches AS (
  SELECT h.n_name AS home, a.n_name AS away,
         count(*) FILTER (WHERE l_returnflag = 'A') % 3 + CASE c_nationkey WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 2 * ((24 - c_nationkey) // 6) END AS home_score,
         count(*) FILTER (WHERE l_returnflag = 'R') % 3 + CASE s_nationkey WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 2 * ((24 - s_nationkey) // 6) END AS away_score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation h ON h.n_nationkey = c_nationkey
       JOIN nation a ON a.n_nationkey = s_nationkey
  WHERE c_nationkey <> s_nationkey
  GROUP BY c_nationkey, s_nationkey, h.n_name, a.n_name),
wins AS (SELECT home AS winner, away AS loser, 2 AS points FROM matches WHERE home_score > away_score
  UNION ALL SELECT away, home, 3 FROM matches WHERE home_score < away_score),
ties AS (SELECT home AS name FROM matches WHERE home_score = away_score
  UNION ALL SELECT away FROM matches WHERE home_score = away_score),
board AS (SELECT t.name, (2 * coalesce(h.n, 0) + 3 * coalesce(a.n, 0) + coalesce(d.n, 0))::BIGINT AS points FROM teams t
  LEFT JOIN (SELECT winner, count(*) AS n FROM wins WHERE points = 2 GROUP BY 1) h ON h.winner = t.name
  LEFT JOIN (SELECT winner, count(*) AS n FROM wins WHERE points = 3 GROUP BY 1) a ON a.winner = t.name
  LEFT JOIN (SELECT name, count(*) AS n FROM ties GROUP BY 1) d ON d.name = t.name)
"""


def teams(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("coach_"), "n_nationkey").alias("coach"))


def matches(t: Tables) -> DataFrame:
    home = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_nationkey", F.col("n_name").alias("home"))
    away = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_nationkey", F.col("n_name").alias("away"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    played = (lines.join(away, F.col("l_suppkey") == F.col("s_suppkey"))
              .join(home, F.col("o_custkey") == F.col("c_custkey"))
              .filter(F.col("c_nationkey") != F.col("s_nationkey")))
    counts = played.groupBy("home", "away", "c_nationkey", "s_nationkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return counts.select("home", "away", (F.col("a") % 3 + strength("c_nationkey")).alias("home_score"), (F.col("r") % 3 + strength("s_nationkey")).alias("away_score"))


def strength(nation: str) -> Column:
    k = F.col(nation)
    return F.when(k == 0, 12).when(k == 1, 8).otherwise(2 * F.floor((24 - k) / 6)).cast("bigint")


def winners(m: DataFrame) -> DataFrame:
    home = m.filter("home_score > away_score").select(F.col("home").alias("winner"), F.col("away").alias("loser"))
    away = m.filter("home_score < away_score").select(F.col("away").alias("winner"), F.col("home").alias("loser"))
    return setops.union_all(home, away)


def ties(m: DataFrame) -> DataFrame:
    even = m.filter("home_score = away_score")
    return setops.union_all(even.select(F.col("home").alias("name")), even.select(F.col("away").alias("name")))


@query("WITH " + LEAGUE_SQL + "SELECT * FROM matches")
def league_matches(t: Tables) -> DataFrame:
    return matches(t)


@query("WITH " + LEAGUE_SQL + "SELECT count(*) AS wins FROM wins WHERE winner = 'NATION_3'")
def count_wins(t: Tables) -> DataFrame:
    return count_where(winners(matches(t)), "winner", "NATION_3", "wins")


@query("WITH " + LEAGUE_SQL + "SELECT winner, loser FROM wins")
def all_winners(t: Tables) -> DataFrame:
    return winners(matches(t))


@query("WITH " + LEAGUE_SQL + "SELECT name FROM ties")
def tied_teams(t: Tables) -> DataFrame:
    return ties(matches(t))


@query("WITH " + LEAGUE_SQL + """SELECT t.name, count(w.winner) AS wins FROM teams t LEFT JOIN wins w
  ON t.name = w.winner GROUP BY t.name""")
def win_counts(t: Tables) -> DataFrame:
    return joins.count_matches(teams(t).select("name"), winners(matches(t)), "name", "winner", "wins")


@query("WITH " + LEAGUE_SQL + "SELECT * FROM board")
def points_table(t: Tables) -> DataFrame:
    return league_points(teams(t).select("name"), matches(t)).orderBy(F.desc("points"), "name")


@query("WITH " + LEAGUE_SQL + """SELECT coach FROM teams t WHERE NOT EXISTS
  (SELECT 1 FROM wins w WHERE w.loser = t.name)""")
def undefeated_coaches(t: Tables) -> DataFrame:
    lost = winners(matches(t)).select(F.col("loser").alias("name"))
    return joins.anti_join(teams(t), lost, "name").select("coach")


@query("WITH " + LEAGUE_SQL + """SELECT w.loser AS name FROM wins w JOIN board s ON w.winner = s.name
  WHERE s.points = (SELECT max(points) FROM board)
EXCEPT SELECT w.loser FROM wins w JOIN board s ON w.winner = s.name WHERE s.points < (SELECT max(points) FROM board)
UNION SELECT name FROM teams t WHERE NOT EXISTS (SELECT 1 FROM wins w WHERE w.loser = t.name)""")
def beaten_only_by_leaders(t: Tables) -> DataFrame:
    m = cut_lineage(matches(t))  # at most one row per pair of teams
    won = winners(m)
    board = league_points(teams(t).select("name"), m)
    top = board.agg(F.max("points")).scalar()
    by = won.join(board, F.col("winner") == F.col("name")).withColumn("leads", F.col("points") == top)
    undefeated = joins.anti_join(teams(t), won.select(F.col("loser").alias("name")), "name").select("name")
    return setops.except_then_union(
        by.filter("leads").select(F.col("loser").alias("name")),
        by.filter("NOT leads").select(F.col("loser").alias("name")), undefeated)


@query("WITH " + LEAGUE_SQL + """SELECT w.loser AS name FROM wins w JOIN board s ON w.winner = s.name
  WHERE s.points = (SELECT max(points) FROM board)
EXCEPT SELECT w.loser FROM wins w JOIN board s ON w.winner = s.name WHERE s.points < (SELECT max(points) FROM board)""")
def beaten_by_leader_alone(t: Tables) -> DataFrame:
    m = cut_lineage(matches(t))  # at most one row per pair of teams
    won = winners(m)
    board = league_points(teams(t).select("name"), m)
    top = board.agg(F.max("points")).scalar()
    by = won.join(board, F.col("winner") == F.col("name")).withColumn("leads", F.col("points") == top)
    return setops.except_distinct(by.filter("leads").select(F.col("loser").alias("name")),
                                  by.filter("NOT leads").select(F.col("loser").alias("name")))


@query("WITH " + LEAGUE_SQL + """SELECT name, points FROM board WHERE points = (SELECT max(points) FROM board)""")
def league_leaders(t: Tables) -> DataFrame:
    board = cut_lineage(league_points(teams(t).select("name"), matches(t)))
    return board.filter(F.col("points") == board.agg(F.max("points")).scalar())
