"""Tables as they are shown: Spanish headers, figures to fixed places, percentages in hundredths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators.base import places

# What a streak is shown as.
SHOWN_HOT, SHOWN_COLD, SHOWN_NEUTRAL, SHOWN_NONE = "🔥 en racha", "❄️ bajo forma", "➖", "-"


def _to(column: str, n: int = 1, factor: int = 1) -> Column:
    return places(F.col(column) * factor if factor != 1 else F.col(column), n, half_even=True)


def _streak(z: str) -> Column:
    c = F.col(z)
    return F.when(c.isNull(), SHOWN_NONE).when(c >= S.HOT, SHOWN_HOT).when(c <= S.COLD, SHOWN_COLD).otherwise(SHOWN_NEUTRAL)


def form_table(form: DataFrame) -> DataFrame:
    """Recent form: 3PA% is the share of shots that are threes, FTr free throws per shot."""
    return form.select(
        "team_id",
        F.col("player_name").alias("Jugador"),
        F.col("games").alias("PJ"),
        _to("avg_minutes").alias("MIN"),
        _to("avg_pts").alias("PTS"),
        _to("avg_pts_per36").alias("PTS/36"),
        _to("avg_efg_pct", 1, 100).alias("eFG%"),
        _to("avg_ts_pct", 1, 100).alias("TS%"),
        _to("fg3a_rate", 1, 100).alias("3PA%"),
        _to("ft_rate", 2).alias("FTr"),
    )


def streak_table(streaks: DataFrame, recent_n: int = 5) -> DataFrame:
    """Streaks in points and in true shooting side by side: they are signals of their own."""
    return streaks.select(
        "team_id",
        "season",
        F.col("player_name").alias("Jugador"),
        F.col("games_season").alias("PJ temporada"),
        _to("recent_avg_pts").alias(f"PTS últimos {recent_n}"),
        _to("season_avg_pts").alias("PTS temporada"),
        _to("z_score_pts", 2).alias("z-score PTS"),
        _streak("z_score_pts").alias("Racha PTS"),
        _to("recent_avg_ts_pct", 1, 100).alias(f"TS% últimos {recent_n}"),
        _to("season_avg_ts_pct", 1, 100).alias("TS% temporada"),
        _to("z_score_ts", 2).alias("z-score TS%"),
        _streak("z_score_ts").alias("Racha TS%"),
    )


def load_table(load: DataFrame) -> DataFrame:
    return load.select("team_id", F.col("player_name").alias("Jugador"), F.col("games").alias("PJ ventana"), _to("total_minutes").alias("MIN totales"), _to("avg_minutes").alias("MIN/partido"))


def difficulty_table(difficulty: DataFrame) -> DataFrame:
    """One row for each next opponent, in order."""
    rows = difficulty.select("team_id", F.inline("opponents"))
    return rows.select("team_id", F.col("ahead").alias("#"), S.long_date_es(F.col("date")).alias("Fecha"), F.col("opponent").alias("Rival"), _to("net").alias("Net Rating"))


def games_table(rows: DataFrame, stats: DataFrame, teams: DataFrame) -> DataFrame:
    """Games of a side with their ratings: ``rows`` of the two-sided view, played or pending."""
    names = teams.select(F.col("id").alias("opponent_id"), F.col("name").alias("Rival"))
    rated = stats.select("game_id", "team_id", "pace", "off_rating", "def_rating", "net_rating")
    both = rows.join(names, "opponent_id", "left").join(rated, ["game_id", "team_id"], "left")
    score = F.when(F.col("own_score").isNull(), "-").otherwise(S.score_label(F.col("own_score"), F.col("opp_score")))
    return both.select("team_id", "game_id", S.long_date_es(F.col("date")).alias("Fecha"), "Rival", score.alias("Resultado"), _to("pace").alias("Pace"), _to("off_rating").alias("ORtg"), _to("def_rating").alias("DRtg"), _to("net_rating").alias("Net"))


def box_table(boxscores: DataFrame) -> DataFrame:
    per36 = places(S.per_36(F.col("points"), S.parse_minutes(F.col("minutes"))), 1, half_even=True)
    return boxscores.select(
        "game_id",
        "team_id",
        F.col("player_name").alias("Jugador"),
        S.blank_to_null(F.col("minutes")).alias("MIN"),
        F.col("points").alias("PTS"),
        F.col("rebounds").alias("REB"),
        F.col("assists").alias("AST"),
        per36.alias("PTS/36"),
        _to("efg_pct", 1, 100).alias("eFG%"),
        _to("ts_pct", 1, 100).alias("TS%"),
    )
