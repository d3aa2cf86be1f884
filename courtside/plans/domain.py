"""The driver's tables seen as the domain's: one definition for Spark, one for the SQL oracle.

nation and region are teams and leagues, orders are games, lineitem rows are box scores by supplier,
customers are rosters, documents are games as several sources report them, events are job requests.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.session import load


def _number(name: str) -> Column:
    return F.regexp_extract(name, r"#0*(\d+)$", 1).cast("long")


@dataclass(frozen=True)
class Tables:
    """The domain's tables of one data set. Lazy: a query reads what it uses."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    @cached_property
    def teams(self) -> DataFrame:
        region = self.raw("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        return self.raw("nation").join(region, "n_regionkey").select(F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), F.col("r_name").alias("league"))

    @cached_property
    def games(self) -> DataFrame:
        key, played = F.col("o_orderkey"), F.col("o_orderstatus") != "O"
        home = F.col("o_custkey") % 25
        day = F.col("o_orderdate").cast("date")
        return self.raw("orders").select(
            key.alias("id"),
            S.date_text(day).alias("date"),
            day.alias("game_date"),
            S.season_of(day).alias("season"),
            F.col("o_orderpriority").alias("league"),
            home.alias("home_team_id"),
            ((home + 1 + key % 24) % 25).alias("away_team_id"),
            F.when(played, 60 + key % 41).cast("int").alias("home_score"),
            F.when(played, 60 + (key * 7) % 43).cast("int").alias("away_score"),
            F.when(key % 10 != 0, F.concat(F.lit("https://stats.example/boxscores/"), key.cast("string"))).alias("boxscore_url"),
            F.lit(None).cast("string").alias("notes"),
        )

    @cached_property
    def boxscores(self) -> DataFrame:
        """One row for each game and player: of several lines the first by (linenumber, partkey, quantity)."""
        line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
        first = W.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_partkey", "q")
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
        # dealt by game: the fold, the join with the games and sums by game then need no other shuffle
        lines = lines.repartition("l_orderkey").withColumn("r", F.row_number().over(first)).where("r = 1")
        sides = self.games.select(F.col("id").alias("l_orderkey"), "home_team_id", "away_team_id")
        fga, fg3a, fta = (line + F.col("q") % 15).cast("int"), (part % 8).cast("int"), (supp % 7).cast("int")
        rows = lines.join(sides, "l_orderkey").join(self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
        clock = F.concat(F.lpad((part % 41).cast("string"), 2, "0"), F.lit(":"), F.lpad((supp % 60).cast("string"), 2, "0"))
        rows = rows.select(
            F.col("l_orderkey").alias("game_id"),
            F.when(line % 2 == 1, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"),
            F.col("s_name").alias("player_name"),
            F.when(part % 13 == 0, "").otherwise(clock).alias("minutes"),
            F.col("q").alias("points"),
            (part % 11).cast("int").alias("rebounds"),
            (part % 4).cast("int").alias("offensive_rebounds"),
            (supp % 9).cast("int").alias("assists"),
            F.nullif((supp % 5).cast("int"), F.lit(0)).alias("turnovers"),
            F.floor(fga / 2).cast("int").alias("fg_made"),
            fga.alias("fg_attempted"),
            F.floor(fg3a / 3).cast("int").alias("fg3_made"),
            fg3a.alias("fg3_attempted"),
            F.floor(fta / 2).cast("int").alias("ft_made"),
            fta.alias("ft_attempted"),
            (part % 31 - 15).cast("double").alias("plus_minus"),
        )
        efg = S.effective_fg(F.col("fg_made"), F.col("fg_attempted"), F.col("fg3_made"))
        return rows.withColumn("efg_pct", efg).withColumn("ts_pct", S.true_shooting(F.col("points"), F.col("fg_attempted"), F.col("ft_attempted")))

    @cached_property
    def team_game_stats(self) -> DataFrame:
        from courtside.operators import teams

        return teams.game_ratings(self.games, self.boxscores)

    @cached_property
    def players(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").cast("long").alias("team_id"),
            F.col("c_mktsegment").alias("position"),
            F.when(key % 17 == 0, F.lit(None)).when(key % 19 == 0, "00A").otherwise((key % 100).cast("string")).alias("number"),
            F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("https://img.example/"), key.cast("string"))).alias("photo_url"),
        )

    @cached_property
    def source_games(self) -> DataFrame:
        """Games as sources report them: the opponent is a whole text, so copies name one game."""
        n, key = F.substring("source", 4, 9).cast("int"), F.col("doc_id")
        opponent = F.regexp_replace(F.col("text"), r"\s+", " ")
        return self.raw("documents").select(
            F.col("source"),
            n.alias("priority"),
            key.alias("src_ord"),
            F.col("lang").alias("date"),
            opponent.alias("opponent"),
            F.when(key % 3 == 0, F.concat(F.lit("slug-"), (key % 50).cast("string"))).otherwise("").alias("opponent_slug"),
            F.when(key % 4 == 0, F.concat(F.lit("/boxscores/"), key.cast("string"))).alias("boxscore_url"),
            (F.col("n_chars") % 2 == 0).alias("is_home"),
            F.when(key % 5 != 0, (F.col("n_chars") % 60 + 50).cast("int")).alias("points"),
            F.when(key % 5 != 0, (F.col("n_chars") % 47 + 50).cast("int")).alias("opp_points"),
            F.when(key % 7 == 0, "aplazado").alias("notes"),
            F.col("lang").alias("league"),
        )

    @cached_property
    def player_game_logs(self) -> DataFrame:
        """Box-score rows of players, whose id is the number in their name."""
        stats = ["points", "rebounds", "assists", "turnovers", "fg_made", "fg_attempted", "fg3_made", "fg3_attempted", "ft_made", "ft_attempted", "plus_minus", "efg_pct", "ts_pct"]
        rows = self.boxscores.join(self.games.select(F.col("id").alias("game_id"), "season"), "game_id")
        return rows.select((F.col("game_id") * 100_000 + _number("player_name")).alias("id"), _number("player_name").alias("player_id"), "game_id", "season", "minutes", *stats)

    @cached_property
    def ingest_jobs(self) -> DataFrame:
        """A request for each event of a user: the user names the team, the type the status."""
        status = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "done", "view", "queued", "purchase", "running", "signup", "failed", "logout", "queued")]), F.col("event_type"))
        return self.raw("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("team_id"), (F.col("event_id") % 15 + 1).cast("int").alias("last_n"), F.coalesce(status, F.lit("done")).alias("status"), F.col("ts").alias("created_at"))


#: The same tables as DuckDB CTEs, in the order in which they build on each other.
CTES = r"""
teams AS (
  SELECT n_nationkey::BIGINT AS id, lower(n_name) AS slug, n_name AS name, r_name AS league FROM nation JOIN region ON n_regionkey = r_regionkey
), games AS (
  SELECT o_orderkey AS id, strftime(o_orderdate, '%a, %b %d, %Y') AS date, o_orderdate::DATE AS game_date,
    (CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END)::INTEGER AS season, o_orderpriority AS league,
    o_custkey % 25 AS home_team_id, (o_custkey % 25 + 1 + o_orderkey % 24) % 25 AS away_team_id,
    (CASE WHEN o_orderstatus <> 'O' THEN 60 + o_orderkey % 41 END)::INTEGER AS home_score, (CASE WHEN o_orderstatus <> 'O' THEN 60 + (o_orderkey * 7) % 43 END)::INTEGER AS away_score,
    CASE WHEN o_orderkey % 10 <> 0 THEN 'https://stats.example/boxscores/' || o_orderkey END AS boxscore_url
  FROM orders
), firsts AS (
  SELECT *, l_quantity::INTEGER AS q FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_quantity::INTEGER) AS r FROM lineitem) WHERE r = 1
), boxes AS (
  SELECT l_orderkey AS game_id, CASE WHEN l_linenumber % 2 = 1 THEN home_team_id ELSE away_team_id END AS team_id, s_name AS player_name,
    CASE WHEN l_partkey % 13 = 0 THEN '' ELSE lpad((l_partkey % 41)::VARCHAR, 2, '0') || ':' || lpad((l_suppkey % 60)::VARCHAR, 2, '0') END AS minutes,
    q AS points, (l_partkey % 11)::INTEGER AS rebounds, (l_partkey % 4)::INTEGER AS offensive_rebounds, (l_suppkey % 9)::INTEGER AS assists, nullif(l_suppkey % 5, 0)::INTEGER AS turnovers,
    ((l_linenumber + q % 15) // 2)::INTEGER AS fg_made, (l_linenumber + q % 15)::INTEGER AS fg_attempted, ((l_partkey % 8) // 3)::INTEGER AS fg3_made, (l_partkey % 8)::INTEGER AS fg3_attempted,
    ((l_suppkey % 7) // 2)::INTEGER AS ft_made, (l_suppkey % 7)::INTEGER AS ft_attempted, (l_partkey % 31 - 15)::DOUBLE AS plus_minus
  FROM firsts JOIN games ON l_orderkey = id JOIN supplier ON l_suppkey = s_suppkey
), boxscores AS (
  SELECT *, (fg_made + 0.5::DOUBLE * fg3_made) / nullif(fg_attempted, 0) AS efg_pct, points / nullif(2.0::DOUBLE * (fg_attempted + 0.44::DOUBLE * ft_attempted), 0) AS ts_pct,
    CASE WHEN minutes <> '' THEN split_part(minutes, ':', 1)::INTEGER + split_part(minutes, ':', 2)::INTEGER / 60.0::DOUBLE END AS mins
  FROM boxes
), team_games AS (
  SELECT id AS game_id, date, game_date, season, league, home_team_id AS team_id, away_team_id AS opponent_id, true AS is_home, home_score AS own_score, away_score AS opp_score, boxscore_url FROM games
  UNION ALL
  SELECT id, date, game_date, season, league, away_team_id, home_team_id, false, away_score, home_score, boxscore_url FROM games
), totals AS (
  SELECT t.game_id, t.team_id, t.own_score, t.opp_score, t.is_home, coalesce(sum(fg_attempted), 0)::BIGINT AS fga, coalesce(sum(ft_attempted), 0)::BIGINT AS fta, coalesce(sum(offensive_rebounds), 0)::BIGINT AS orb,
    coalesce(sum(turnovers), 0)::BIGINT AS tov, coalesce(sum(points), 0)::BIGINT AS pts, coalesce(sum(rebounds), 0)::BIGINT AS reb, coalesce(sum(assists), 0)::BIGINT AS ast
  FROM team_games t LEFT JOIN boxscores b ON b.game_id = t.game_id AND b.team_id = t.team_id WHERE t.own_score IS NOT NULL GROUP BY ALL
), sides AS (
  SELECT *, fga - orb + tov + 0.4::DOUBLE * fta AS poss FROM totals
), team_game_stats AS (
  SELECT a.game_id, a.team_id, round(a.poss, 4) AS possessions, round((a.poss + b.poss) / 2, 4) AS pace, round(100.0::DOUBLE * a.own_score / nullif(a.poss, 0), 4) AS off_rating,
    round(100.0::DOUBLE * a.opp_score / nullif(b.poss, 0), 4) AS def_rating, round(100.0::DOUBLE * a.own_score / nullif(a.poss, 0) - 100.0::DOUBLE * a.opp_score / nullif(b.poss, 0), 4) AS net_rating,
    a.pts AS team_points, a.reb AS team_rebounds, a.ast AS team_assists, a.tov AS team_turnovers, a.fga AS team_fg_attempted, a.fta AS team_ft_attempted
  FROM sides a JOIN sides b ON a.game_id = b.game_id AND a.is_home <> b.is_home WHERE a.fga + b.fga > 0
), players AS (
  SELECT c_custkey AS id, c_name AS name, c_nationkey::BIGINT AS team_id, c_mktsegment AS position,
    CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN '00A' ELSE (c_custkey % 100)::VARCHAR END AS number, CASE WHEN c_acctbal >= 0 THEN 'https://img.example/' || c_custkey END AS photo_url
  FROM customer
), source_games AS (
  SELECT source, substr(source, 4)::INTEGER AS priority, doc_id AS src_ord, lang AS date, regexp_replace(text, '\s+', ' ', 'g') AS opponent,
    CASE WHEN doc_id % 3 = 0 THEN 'slug-' || (doc_id % 50) ELSE '' END AS opponent_slug, CASE WHEN doc_id % 4 = 0 THEN '/boxscores/' || doc_id END AS boxscore_url, n_chars % 2 = 0 AS is_home,
    (CASE WHEN doc_id % 5 <> 0 THEN n_chars % 60 + 50 END)::INTEGER AS points, (CASE WHEN doc_id % 5 <> 0 THEN n_chars % 47 + 50 END)::INTEGER AS opp_points,
    CASE WHEN doc_id % 7 = 0 THEN 'aplazado' END AS notes, lang AS league
  FROM documents
), ingest_jobs AS (
  SELECT event_id AS id, user_id % 25 AS team_id, (event_id % 15 + 1)::INTEGER AS last_n, ts AS created_at,
    CASE event_type WHEN 'click' THEN 'done' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'running' WHEN 'signup' THEN 'failed' WHEN 'logout' THEN 'queued' ELSE 'done' END AS status
  FROM events
)
"""
