"""Calendars: past, pending, windows, head to head, pages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators.base import bounded, placed, ranked, scoped, team_games

#: A date that no parseable one exceeds: pending games without a date stay in, last.
FAR = date(9999, 12, 31)


def _stretch() -> Column:
    """Games of a day (or of none) with ids near each other, in a calendar's order: a team's list is numbered stretch by stretch."""
    return F.struct("game_date", F.floor(F.col("game_id") / 1_000_000))


def calendar(games: DataFrame, **scope) -> DataFrame:
    """All games of a team; ``place`` is earliest first, games without a date before all."""
    return ranked(scoped(team_games(games), **scope), "place", [F.asc("game_id")], _stretch(), ("team_id",))


def past(games: DataFrame, **scope) -> DataFrame:
    """Played games with their result; ``place`` is newest first, games without a date last."""
    rows = scoped(team_games(games), **scope).where("own_score is not null")
    rows = rows.withColumn("result", S.result_label(F.col("own_score"), F.col("opp_score"))).withColumn("score", S.score_label(F.col("own_score"), F.col("opp_score")))
    return ranked(rows, "place", [F.desc("game_id")], _stretch(), ("team_id",), descending=True)


def _pending(games: DataFrame, reference: date, **scope) -> DataFrame:
    rows = scoped(team_games(games), **scope).where("own_score is null")
    return rows.where(F.coalesce("game_date", F.lit(FAR)) >= F.lit(reference))


def upcoming(games: DataFrame, reference: date, **scope) -> DataFrame:
    """Games without a score from the reference date on; ``place`` is earliest first, those without a date last.
    Notes don't matter."""
    return placed(_pending(games, reference, **scope), ["team_id"], F.asc_nulls_last("game_date"), F.asc("game_id"))


def in_window(games: DataFrame, reference: date, days: int = 14, **scope) -> DataFrame:
    """Played games of the trailing days, both ends included."""
    return scoped(team_games(games), **scope).where("own_score is not null").where(F.col("game_date").between(F.date_sub(F.lit(reference), bounded("days", days, 90)), F.lit(reference)))


def head_to_head(games: DataFrame, team_id: int | None = None, opponent_id: int | None = None, **scope) -> DataFrame:
    """Games between two teams from the first one's side, pending ones too; all pairs without ids."""
    rows = scoped(team_games(games), team_id=team_id, **scope)
    return rows if opponent_id is None else rows.where(F.col("opponent_id") == opponent_id)


def newest(rows: DataFrame, keys: list[str], n: int, *, by: Column | str = "game_date", id_column: str = "game_id") -> DataFrame:
    """The ``n`` newest rows of each key; ties and missing dates by id. The rank is cut before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.desc_nulls_last(by) if isinstance(by, str) else by, F.desc(id_column))
    return rows.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def recent(games: DataFrame, stats: DataFrame, last_n: int = 5, **scope) -> DataFrame:
    """The last played games of each team with their ratings, where there are any."""
    rows = newest(scoped(team_games(games), **scope).where("own_score is not null"), ["team_id"], last_n)
    rated = stats.select("game_id", "team_id", "pace", "off_rating", "def_rating", "net_rating")
    return rows.join(rated, ["game_id", "team_id"], "left")


def next_games(pending: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` pending games of each team, of ``upcoming``. The place is cut before the shuffle."""
    return pending.where(F.col("place") <= n).withColumn("ahead", F.col("place"))


def page(games: DataFrame, stats: DataFrame, reference: date, team_id: int, limit: int = 50, offset: int = 0, season: int | None = None, league: str | None = None) -> DataFrame:
    """A page of a team's list: played games (newest first), then pending ones, each with ratings and the total."""
    scope = {"team_id": team_id, "season": season, "league": league}
    both = past(games, **scope).drop("result", "score").withColumn("branch", F.lit(0)).unionByName(upcoming(games, reference, **scope).withColumn("branch", F.lit(1)))
    total = both.agg(F.count("*").alias("total"))
    cut = both.orderBy("branch", "place").offset(offset).limit(limit)  # a page of one team: the top of its list
    rated = stats.where(F.col("team_id") == team_id).select("game_id", "pace", "net_rating")
    return cut.join(rated, "game_id", "left").join(total)  # one row


def recurring_rivals(games: DataFrame) -> DataFrame:
    """Opponents that a team has played more than once, with its record."""
    rows = team_games(games).where("own_score is not null").groupBy("team_id", "opponent_id")
    return rows.agg(F.count("*").alias("games"), F.count_if(F.col("own_score") > F.col("opp_score")).alias("wins")).where("games > 1")


def box_selection(games: DataFrame, teams: DataFrame, of_interest: list[str], last_n: int = 10) -> DataFrame:
    """Box scores to fetch: the last games of the teams of interest and those between two of them, each url once."""
    ids = teams.where(F.col("slug").isin(of_interest)).select(F.col("id").alias("team_id"), F.col("slug").alias("own_slug"))
    rows = team_games(games).where("boxscore_url is not null").join(ids, "team_id")
    names = teams.select(F.col("id").alias("opponent_id"), F.regexp_replace(F.lower("name"), r"[\s-]+", "").alias("opponent_key"))
    between = rows.join(names, "opponent_id").where(F.exists(F.array(*map(F.lit, of_interest)), lambda s: (s != F.col("own_slug")) & F.contains(F.col("opponent_key"), s)))
    last = newest(rows, ["team_id"], last_n)
    keep = ["boxscore_url", "game_id", "team_id"]
    every = last.select(*keep, F.lit("last").alias("reason")).unionByName(between.select(*keep, F.lit("between").alias("reason")))
    first = W.partitionBy("boxscore_url").orderBy(F.desc("reason"), "team_id")
    return every.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def pending_downloads(games: DataFrame, boxscores: DataFrame, delay_seconds: int = 20) -> DataFrame:
    """Played games with a link and no box-score row on either side, and how long fetching them takes."""
    waiting = games.where("home_score is not null and coalesce(boxscore_url, '') <> ''")
    left = waiting.join(boxscores.select(F.col("game_id").alias("id")), "id", "left_anti")
    return left.groupBy("league").agg(F.count("*").alias("games"), (F.count("*") * delay_seconds).alias("seconds"))
