"""Team analytics: ratings from box scores, summaries, season tables, seasons and leagues."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators.base import mean, places, scoped, season_boxes, team_games


def box_totals(games: DataFrame, boxscores: DataFrame) -> DataFrame:
    """Sums of both sides of every played game; a side without rows has zeros."""
    names = {"fga": "fg_attempted", "fta": "ft_attempted", "orb": "offensive_rebounds", "tov": "turnovers", "pts": "points", "reb": "rebounds", "ast": "assists"}
    sums = boxscores.groupBy("game_id", "team_id").agg(*[F.sum(c).alias(k) for k, c in names.items()])
    sides = team_games(games).where("own_score is not null").select("game_id", "team_id", "is_home", "own_score", "opp_score")
    return sides.join(sums, ["game_id", "team_id"], "left").fillna(0, list(names))


def game_ratings(games: DataFrame, boxscores: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Possessions, pace and ratings of both sides of each played game with any shot.

    The opponent's side is the game's other row, by a window, so the box scores are read once. Games whose two sides are both in ``done`` are left out.
    """
    side = box_totals(games, boxscores).withColumn("poss", S.possessions(F.col("fga"), F.col("orb"), F.col("tov"), F.col("fta")))
    if done is not None:
        ready = done.groupBy("game_id").agg(F.countDistinct("team_id").alias("n")).where("n >= 2").select("game_id")
        side = side.join(ready, "game_id", "left_anti")
    game = W.partitionBy("game_id")
    of = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c))).over(game)
    rival = lambda c: F.when(F.col("is_home"), of(c, False)).otherwise(of(c, True))
    both = side.withColumns({"opp_poss": rival("poss"), "opp_fga": rival("fga")}).where(F.col("fga") + F.col("opp_fga") > 0)
    off, against = S.rating(F.col("own_score"), F.col("poss")), S.rating(F.col("opp_score"), F.col("opp_poss"))
    return both.select(
        "game_id",
        "team_id",
        places("poss", 4).alias("possessions"),
        places((F.col("poss") + F.col("opp_poss")) / 2, 4).alias("pace"),
        places(off, 4).alias("off_rating"),
        places(against, 4).alias("def_rating"),
        places(off - against, 4).alias("net_rating"),
        F.col("pts").alias("team_points"),
        F.col("reb").alias("team_rebounds"),
        F.col("ast").alias("team_assists"),
        F.col("tov").alias("team_turnovers"),
        F.col("fga").alias("team_fg_attempted"),
        F.col("fta").alias("team_ft_attempted"),
    )


def fill_advanced(boxscores: DataFrame) -> DataFrame:
    """Shooting percentages where effective field goal is missing."""
    missing = F.col("efg_pct").isNull()
    efg = S.effective_fg(F.col("fg_made"), F.col("fg_attempted"), F.col("fg3_made"))
    ts = S.true_shooting(F.col("points"), F.col("fg_attempted"), F.col("ft_attempted"))
    return boxscores.withColumns({"efg_pct": F.when(missing, efg).otherwise(F.col("efg_pct")), "ts_pct": F.when(missing, ts).otherwise(F.col("ts_pct"))})


def advanced_summary(games: DataFrame, boxscores: DataFrame, stats: DataFrame, *, team_id: int | None = None, season: int | None = None, league: str | None = None, by_season: bool = False) -> DataFrame:
    """Unweighted means of a team's game ratings, and of its player rows' shooting, played or not; null where empty."""
    keys = ["team_id", "season"] if by_season else ["team_id"]
    of = scoped(games.select(F.col("id").alias("game_id"), "season", "league"), season=season, league=league)
    rated = scoped(stats, team_id=team_id).join(of, "game_id").groupBy(*keys).agg(
        mean("pace").alias("avg_pace"), mean("off_rating").alias("avg_off_rating"), mean("def_rating").alias("avg_def_rating"), mean("net_rating").alias("avg_net_rating")
    )
    shots = season_boxes(games, boxscores, team_id=team_id, season=season, league=league).groupBy(*keys).agg(mean("efg_pct").alias("avg_efg_pct"), mean("ts_pct").alias("avg_ts_pct"))
    return rated.join(shots, keys, "full")


def season_stats(games: DataFrame, boxscores: DataFrame, stats: DataFrame, *, team_id: int | None = None, season: int | None = None, pooled: bool = False) -> DataFrame:
    """Season table of each team: games, wins and losses (a tie is neither), means to one place.

    With ``pooled`` the four ratings are all the mean of their pooled values, which is what the reference stores.
    """
    played = scoped(team_games(games), team_id=team_id, season=season).where("own_score is not null and season is not null")
    sums = boxscores.groupBy("game_id", "team_id").agg(F.sum("rebounds").alias("reb"), F.sum("assists").alias("ast"))
    rated = stats.select("game_id", "team_id", "pace", "off_rating", "def_rating", "net_rating")
    rows = played.join(sums, ["game_id", "team_id"], "left").join(rated, ["game_id", "team_id"], "left")
    metrics = ["pace", "off_rating", "def_rating", "net_rating"]
    per_game = lambda c: places(F.sum(F.coalesce(c, F.lit(0))) / F.count("*"), 1, half_even=True)
    values = sum((F.coalesce(F.sum(m), F.lit(0.0)) for m in metrics), F.lit(0.0))
    pool = places(values / F.nullif(sum((F.count(m) for m in metrics), F.lit(0)), F.lit(0)), 1, half_even=True)
    return rows.groupBy("team_id", "season").agg(
        F.count("*").alias("games_played"),
        F.count_if(F.col("own_score") > F.col("opp_score")).alias("wins"),
        F.count_if(F.col("own_score") < F.col("opp_score")).alias("losses"),
        per_game("own_score").alias("points_per_game"),
        per_game("reb").alias("rebounds_per_game"),
        per_game("ast").alias("assists_per_game"),
        *[(pool if pooled else places(mean(m), 1, half_even=True)).alias(m) for m in metrics],
    )


def league_counts(games: DataFrame) -> DataFrame:
    return games.where("home_score is not null").groupBy("league").agg(F.count("*").alias("games"))


def freshness(games: DataFrame, boxscores: DataFrame, teams: DataFrame) -> DataFrame:
    """Date text of the game with the largest id, and row counts of three tables: one row."""
    last = games.agg(F.max_by("date", "id").alias("last_game_date"), F.count("*").alias("n_games"))
    return last.join(boxscores.agg(F.count("*").alias("n_boxscores"))).join(teams.agg(F.count("*").alias("n_teams")))  # one row each


def seasons(games: DataFrame, *, team_id: int | None = None) -> DataFrame:
    """Seasons of a team, pending games included."""
    return scoped(team_games(games), team_id=team_id).select("team_id", "season").where("season is not null").distinct()


def leagues(games: DataFrame, *, team_id: int | None = None) -> DataFrame:
    named = scoped(team_games(games), team_id=team_id).where("league is not null and league <> ''")
    return named.select("team_id", "league").distinct().withColumn("label", S.league_label(F.col("league")))


def current_season(games: DataFrame, stats: DataFrame, reference: date, *, team_id: int | None = None) -> DataFrame:
    """Of each team: the reference date's season if it has statistics, else the last that has; without
    statistics the reference season if a game is scheduled in it, else the newest."""
    now = S.season_of(F.lit(reference))
    own = scoped(team_games(games), team_id=team_id).where("season is not null").select("team_id", "game_id", "season")
    rated = stats.select("game_id", "team_id", F.lit(1).alias("rated"))
    rows = own.join(rated, ["game_id", "team_id"], "left").withColumn("played", F.when(F.col("rated") == 1, F.col("season")))
    found = rows.groupBy("team_id").agg(F.max("played").alias("last"), F.coalesce(F.bool_or(F.col("played") == now), F.lit(False)).alias("has"), F.bool_or(F.col("season") == now).alias("due"), F.max("season").alias("newest"))
    pick = F.when(F.col("has"), now).when(F.col("last").isNotNull(), F.col("last")).when(F.col("due"), now).otherwise(F.col("newest"))
    return found.select("team_id", pick.cast("int").alias("season"))


def summary(games: DataFrame, boxscores: DataFrame, stats: DataFrame, **scope) -> DataFrame:
    """The advanced summary with the number of played games in scope and of all pending ones."""
    own = team_games(games)
    played = scoped(own, **scope).where("own_score is not null").groupBy("team_id").agg(F.count("*").alias("games_played"))
    pending = scoped(own, team_id=scope.get("team_id")).where("own_score is null").groupBy("team_id").agg(F.count("*").alias("games_pending"))
    out = advanced_summary(games, boxscores, stats, **scope).join(played, "team_id", "full").join(pending, "team_id", "full")
    return out.fillna(0, ["games_played", "games_pending"])


def filter_options(games: DataFrame, stats: DataFrame, reference: date) -> DataFrame:
    """Of each team: its seasons (newest first), leagues and the default season."""
    years = seasons(games).groupBy("team_id").agg(F.sort_array(F.collect_list("season"), asc=False).alias("seasons"))
    codes = leagues(games).groupBy("team_id").agg(F.sort_array(F.collect_list(F.struct("league", "label"))).alias("leagues"))
    return years.join(codes, "team_id", "full").join(current_season(games, stats, reference).withColumnRenamed("season", "default_season"), "team_id", "left")
