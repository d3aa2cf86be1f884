"""Data quality: box scores against results, missing minutes, what sources deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators.base import team_games

#: Points that a box score and a result may differ by.
TOLERANCE = 2
# The sides and the two messages.
HOME, AWAY = "local", "visitante"
POINTS = "Partido %s (%s): puntos del box score %s (%s) no cuadran con el resultado guardado (%s)"
MINUTES = "Partido %s (%s): jugadores sin minutos registrados en el box score %s: %s"


def warnings(games: DataFrame, boxscores: DataFrame) -> DataFrame:
    """One row for each fault of a side of a game that has box-score rows: ``kind`` points or minutes, and the text.

    Null points count as zero. Minutes are missing if their text is null or empty; ``0:00`` is not.
    """
    missing = F.coalesce(F.col("minutes"), F.lit("")) == ""
    sides = boxscores.groupBy("game_id", "team_id").agg(
        F.sum(F.coalesce("points", F.lit(0))).alias("summed"), F.array_join(F.sort_array(F.collect_list(F.when(missing, F.col("player_name")))), ", ").alias("players")
    )
    rows = team_games(games).select("game_id", "team_id", "date", "is_home", "own_score").join(sides, ["game_id", "team_id"])
    text = lambda c: F.col(c).cast("string")
    head = [text("game_id"), F.coalesce("date", F.lit("-")), F.when(F.col("is_home"), HOME).otherwise(AWAY)]
    off = F.abs(F.col("summed") - F.col("own_score")) > TOLERANCE
    points = F.when(off, F.format_string(POINTS, *head, text("summed"), text("own_score")))
    minutes = F.when(F.col("players") != "", F.format_string(MINUTES, *head, F.col("players")))
    faults = F.array(F.struct(F.lit("points").alias("kind"), points.alias("message")), F.struct(F.lit("minutes").alias("kind"), minutes.alias("message")))
    return rows.select("game_id", "team_id", F.inline(faults)).where("message is not null")


def source_report(source_games: DataFrame, expected: list[str]) -> DataFrame:
    """Rows of each source, expected ones with none included, and whether a warning is due."""
    spark = source_games.sparkSession
    counts = source_games.groupBy("source").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(s, i) for i, s in enumerate(expected)], "source string, place int")
    rows = counts.join(wanted, "source", "full").fillna(0, ["n"])
    return rows.select("source", "n", ((F.col("n") == 0) & (F.coalesce("place", F.lit(-1)) == 0)).alias("primary_empty"))
