"""From fused source games to stored rows: resolve the opponent, orient by side, upsert; and a whole capture run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators import entities, fusion, teams, upsert


def oriented(fused: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fused games ``(team_id, src_ord, date, opponent, opponent_slug, is_home, points, opp_points, ...)`` as rows of the
    games table, home and away after ``is_home``; ``resolved`` has the opponents' ids."""
    found = resolved.select(F.col("src_ord").alias("o"), F.col("opponent").alias("n"), F.col("opponent_slug").alias("s"), F.col("team_id").alias("opponent_id"))
    rows = fused.join(found, (F.col("src_ord") == F.col("o")) & (F.col("opponent") == F.col("n")) & (F.coalesce("opponent_slug", F.lit("")) == F.col("s")))
    own, other, home = F.col("team_id").cast("long"), F.col("opponent_id"), F.col("is_home")
    return rows.select(
        "src_ord",
        "date",
        F.when(home, own).otherwise(other).alias("home_team_id"),
        F.when(home, other).otherwise(own).alias("away_team_id"),
        F.when(home, F.col("points")).otherwise(F.col("opp_points")).alias("home_score"),
        F.when(home, F.col("opp_points")).otherwise(F.col("points")).alias("away_score"),
        "boxscore_url",
        "notes",
        "league",
        "season",
    ).where("home_team_id is not null and away_team_id is not null")


def settled_rows(fused: DataFrame, teams: DataFrame, team_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fused games as rows of the games table, and ``teams`` with those that their opponents make of them.

    The games are those of ``team_id``, or of the teams that the rows' ``team_id`` names. Opponents are settled in the
    order of ``src_ord``: blank ones are left out, unknown ones become teams, of the league of the team whose calendar
    names them first, and slugs move to the teams that are called by them. A game without a league takes that of the
    calendar's team.
    """
    rows = (fused if team_id is None else fused.withColumn("team_id", F.lit(team_id))).where("trim(coalesce(opponent, '')) <> ''")
    own = teams.select(F.col("id").alias("team_id"), F.col("league").alias("own_league"))
    rows = rows.join(own, "team_id", "left").withColumn("league", F.coalesce(F.nullif("league", F.lit("")), "own_league"))
    resolved, every, _ = entities.settle(rows.select("src_ord", "opponent", "opponent_slug", F.col("own_league").alias("league")), teams)
    return oriented(rows, resolved), every


def persist_schedule(stored: DataFrame, teams: DataFrame, fused: DataFrame, team_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(games, teams) after storing fused games, as ``settled_rows`` makes them. Scores of 0 count as missing, as in the
    reference's storage."""
    rows, every = settled_rows(fused, teams, team_id)
    return upsert.upsert(stored, rows, upsert.rules("games"), order="src_ord", zero_is_missing=True), every


def capture_run(folder: str, tables: dict[str, DataFrame], source_games: DataFrame, box_rows: DataFrame, team_id: int, order: str | None = None) -> dict[str, DataFrame]:
    """One whole capture of a team: fuse what the sources report, store it, store the box-score rows, fill and rate
    them, and make the season table. ``tables`` holds teams, games and boxscores; all tables are written to
    ``folder`` as new versions and come back as stored. ``order`` names the arrival of the box-score rows, if one may
    come twice. All seasons are made anew here; ``increments`` has the form that moves the changed ones only.
    """

    def stored(name: str, df: DataFrame) -> DataFrame:
        upsert.replace_table(df, f"{folder}/{name}")
        return upsert.current(df.sparkSession, f"{folder}/{name}")

    fused = fusion.fuse(source_games)
    dated = fused if "season" in fused.columns else fused.withColumn("season", S.season_of(S.parse_date(F.col("date"))))
    new_games, new_teams = persist_schedule(tables["games"], tables["teams"], dated, team_id)
    out = {"teams": stored("teams", new_teams), "games": stored("games", new_games.drop("change"))}
    boxes = upsert.upsert(tables["boxscores"], box_rows, upsert.rules("boxscores"), order=order).drop("change")
    out["boxscores"] = stored("boxscores", teams.fill_advanced(boxes))
    dated_games = out["games"].withColumn("game_date", S.parse_date(F.col("date")))
    out["team_game_stats"] = stored("team_game_stats", teams.game_ratings(dated_games, out["boxscores"]))
    out["season_team_stats"] = stored("season_team_stats", teams.season_stats(dated_games, out["boxscores"], out["team_game_stats"]))
    return out
