"""Player analytics: recent form, streaks, workload, comparison with the team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators.base import bounded, mean, places, season_boxes

PLAYER = ["team_id", "player_name"]


def recent_form(games: DataFrame, boxscores: DataFrame, last_n: int = 5, *, team_id: int | None = None, season: int | None = None, league: str | None = None, by_date: bool = False) -> DataFrame:
    """Means of each player over the newest ``last_n`` rows, of which those without minutes then fall away.

    Newest by game id, or by the game's day and then id. Null points are zero in the mean and left out per 36 minutes; shot shares are over
    sums. A player with no minutes in the window is absent. One shuffle, by player; ranks are cut before it.
    """
    rows = season_boxes(games, boxscores, team_id=team_id, season=season, league=league)
    newest = W.partitionBy(*PLAYER).orderBy(*([F.desc_nulls_last("game_date")] if by_date else []), F.desc("game_id"))
    played = rows.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= bounded("last_n", last_n, 20)).where("mins > 0")
    return played.groupBy(*PLAYER).agg(
        F.count("*").alias("games"),
        mean("mins").alias("avg_minutes"),
        F.avg(F.coalesce("points", F.lit(0))).alias("avg_pts"),
        mean(S.per_36(F.col("points"), F.col("mins"))).alias("avg_pts_per36"),
        mean("efg_pct").alias("avg_efg_pct"),
        mean("ts_pct").alias("avg_ts_pct"),
        mean("plus_minus").alias("avg_plus_minus"),
        F.avg("turnovers").alias("avg_turnovers"),
        F.try_divide(F.sum("fg3_attempted"), F.sum("fg_attempted")).alias("fg3a_rate"),
        F.try_divide(F.sum("ft_attempted"), F.sum("fg_attempted")).alias("ft_rate"),
    )


def season_profile(
    games: DataFrame, boxscores: DataFrame, season: int | None = None, recent_n: int = 5, min_season_games: int = 6, form_n: int | None = 1000, *, team_id: int | None = None, league: str | None = None
) -> DataFrame:
    """Of each player and season: streak figures and, over the newest ``form_n`` rows, points and the share of threes.

    Box scores are read, shuffled and sorted once: every rank is a running count in one order, newest game first.
    """
    rows = season_boxes(games, boxscores, team_id=team_id, season=season, league=league)
    of = [*PLAYER, "season"]
    newest = W.partitionBy(*of).orderBy(F.desc("game_id"))
    so_far = newest.rowsBetween(W.unboundedPreceding, W.currentRow)
    played = F.col("mins") > 0
    with_ts = played & F.col("ts_pct").isNotNull()
    points = F.coalesce(F.col("points"), F.lit(0)).cast("double")
    ranked = rows.select(
        *of,
        points.alias("p"),
        F.col("ts_pct").alias("ts"),
        *(["fg3_attempted", "fg_attempted"] if form_n else []),
        played.alias("played"),
        with_ts.alias("has_ts"),
        (F.row_number().over(newest) <= (form_n or 0)).alias("in_form"),
        (F.count_if(played).over(so_far) <= recent_n).alias("recent"),
        (F.count_if(with_ts).over(so_far) <= recent_n).alias("recent_ts"),
    ).where("played")
    ts = F.when(F.col("has_ts"), F.col("ts"))
    enough = F.count(ts) >= min_season_games
    form = lambda c: F.when(F.col("in_form"), F.col(c))
    shown = [F.count_if("in_form").alias("form_games"), F.avg(form("p")).alias("form_avg_pts"), F.try_divide(F.sum(form("fg3_attempted")), F.sum(form("fg_attempted"))).alias("fg3a_rate")]
    found = ranked.groupBy(*of).agg(
        F.count("*").alias("games_season"),
        F.avg(F.when(F.col("recent"), F.col("p"))).alias("recent_avg_pts"),
        F.avg("p").alias("season_avg_pts"),
        F.stddev_pop("p").alias("season_std_pts"),
        F.when(enough, mean(F.when(F.col("recent_ts"), ts))).alias("recent_avg_ts_pct"),
        F.when(enough, mean(ts)).alias("season_avg_ts_pct"),
        F.when(enough, F.stddev_pop(ts)).alias("season_std_ts_pct"),
        *(shown if form_n else []),
    )
    some = F.col("games_season") >= min_season_games
    z = lambda kind: F.when(some, F.try_divide(F.col(f"recent_avg_{kind}") - F.col(f"season_avg_{kind}"), F.col(f"season_std_{kind}")))
    out = found.withColumn("z_score_pts", z("pts")).withColumn("z_score_ts", z("ts_pct"))
    return out.withColumn("enough", some).withColumn("streak", S.streak_label(places("z_score_pts", 6)))


def streaks(
    games: DataFrame, boxscores: DataFrame, season: int | None = None, recent_n: int = 5, min_season_games: int = 6, *, team_id: int | None = None, league: str | None = None
) -> DataFrame:
    """z-score of the newest games against the player's own season, in points and in true shooting.

    Rows without minutes go first, then the window is cut; true shooting has a window of its own, over the
    rows that have it. Without a season every (player, season) is a row. A deviation of 0 gives a null z.
    """
    out = season_profile(games, boxscores, season, recent_n, min_season_games, None, team_id=team_id, league=league)
    return out.where("enough").drop("enough")


def load(boxscores: DataFrame, window: DataFrame) -> DataFrame:
    """Minutes of each player over the games of ``window(game_id, team_id)``, some days of games.

    A player's games are added from the longest down, as doubles that are added as they come differ from run to run.
    """
    rows = boxscores.join(window.select("game_id", "team_id").distinct(), ["game_id", "team_id"], "left_semi").withColumn("mins", S.parse_minutes(F.col("minutes"))).where("mins > 0")
    total = F.aggregate(F.sort_array(F.collect_list("mins"), asc=False), F.lit(0.0), lambda a, b: a + b)
    return rows.groupBy(*PLAYER).agg(total.alias("total_minutes"), mean("mins").alias("avg_minutes"), F.count("*").alias("games"))


def sliding_load(games: DataFrame, boxscores: DataFrame, days: int = 14) -> DataFrame:
    """Minutes of each player over the trailing days of every date on which they played, that date included."""
    dated = boxscores.join(games.select(F.col("id").alias("game_id"), "game_date"), "game_id")
    rows = dated.withColumn("mins", S.parse_minutes(F.col("minutes"))).where("mins > 0 and game_date is not null")
    per_day = rows.groupBy(*PLAYER, "game_date").agg(F.sum("mins").alias("mins"), F.count("*").alias("n"))
    day = F.unix_date("game_date")
    trailing = W.partitionBy(*PLAYER).orderBy(day).rangeBetween(-(days - 1), 0)
    return per_day.select(*PLAYER, "game_date", F.sum("mins").over(trailing).alias("load_minutes"), F.sum("n").over(trailing).alias("load_games"))


def against_team(form: DataFrame) -> DataFrame:
    """Each form statistic next to the mean of the team's players, with a verdict; few turnovers are good."""
    out = form
    for column, more_is_better in (("avg_pts", True), ("avg_efg_pct", True), ("avg_ts_pct", True), ("avg_turnovers", False)):
        mean = places(F.avg(column).over(W.partitionBy("team_id")), 6)
        own = places(column, 6)
        good, bad = ("good", "bad") if more_is_better else ("bad", "good")
        verdict = F.when(own.isNull() | mean.isNull(), "neutral").when(own == mean, "good").when(own > mean, good).otherwise(bad)
        out = out.withColumn(f"team_{column}", mean).withColumn(f"{column}_mark", verdict)
    return out


def roster(players: DataFrame) -> DataFrame:
    """Players with a photo, in order of jersey number; ``jersey`` is 999 where the number is no number."""
    number = F.when(F.col("number").rlike("^[0-9]+$"), F.col("number").try_cast("int")).otherwise(999)
    return players.where("photo_url is not null").withColumn("jersey", F.coalesce(number, F.lit(999)))


def roster_with_form(players: DataFrame, form: DataFrame) -> DataFrame:
    """The roster with each player's recent form, matched on the exact name; null where there is none."""
    stats = form.withColumnRenamed("player_name", "name")
    return roster(players).join(stats, ["team_id", "name"], "left")


def teams_with_roster(teams: DataFrame, players: DataFrame) -> DataFrame:
    return teams.join(players.select(F.col("team_id").alias("id")), "id", "left_semi")
