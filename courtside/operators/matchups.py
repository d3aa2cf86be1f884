"""Match-ups: schedule difficulty, projection of a game, the scouting paragraph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators import calendar, players
from courtside.operators.base import bounded, mean, places, scoped

# Thresholds and sentences of the paragraph; {} stands for a figure or for names.
PACE_FAST, PACE_SLOW, THREES_HIGH, THREES_LOW = 75.0, 68.0, 0.40, 0.25
FAST = "Juega a ritmo alto ({} posesiones estimadas por partido)."
SLOW = "Juega a ritmo bajo ({} posesiones estimadas por partido)."
MEDIUM = "Juega a ritmo intermedio ({} posesiones estimadas por partido)."
BALANCE = "Balance {}: {} de Net Rating medio."
MANY_THREES = "Ataque muy volcado al triple: {}% de los intentos son de 3."
FEW_THREES = "Ataque poco dependiente del triple: solo {}% de los intentos son de 3."
SOME_THREES = "Reparto de tiro equilibrado: {}% de los intentos son de 3."
TOP_SCORER = "Máximo anotador: {} ({} puntos por partido)."
ON_FIRE = "En racha anotadora (últimos {} partidos): {}."
OUT_OF_FORM = "Bajo forma anotadora (últimos {} partidos): {}."


def _sentence(when: Column, template: str, *values: Column) -> Column:
    """The template with its gaps filled, where the condition holds."""
    parts = template.split("{}")
    filled = [x for text, value in zip(parts, [*values, None]) for x in ([F.lit(text)] if value is None else [F.lit(text), value])]
    return F.when(when, F.concat(*filled))


def difficulty(pending: DataFrame, summaries: DataFrame, team_names: DataFrame, next_n: int = 5) -> DataFrame:
    """How strong the next opponents of each team are: means of their net rating, a repeated one counted again.

    The opponents' summaries are grouped once for all teams and joined, not asked for game by game.
    """
    ahead = calendar.next_games(pending, bounded("next_n", next_n, 20))
    net = summaries.select(F.col("team_id").alias("opponent_id"), F.col("avg_net_rating").alias("net"))
    names = team_names.select(F.col("id").alias("opponent_id"), F.col("name").alias("opponent"))
    rows = ahead.join(net, "opponent_id", "left").join(names, "opponent_id", "left")
    listed = F.sort_array(F.collect_list(F.struct("ahead", "opponent", "date", "net")))
    return rows.groupBy("team_id").agg(F.count("*").alias("games_considered"), F.count("net").alias("opponents_scouted"), mean("net").alias("avg_opponent_net_rating"), listed.alias("opponents"))


def projection(summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Possessions, ratings and score that two teams' means lead to, for ``pairs(team_id, opponent_id)``; all null or none."""
    def side(prefix: str, key: str) -> DataFrame:
        return summaries.select(F.col("team_id").alias(key), *[F.col(f"avg_{c}").alias(f"{prefix}_{c}") for c in ("pace", "off_rating", "def_rating")])

    both = pairs.join(side("own", "team_id"), "team_id", "left").join(side("opp", "opponent_id"), "opponent_id", "left")
    c = F.col
    poss = (c("own_pace") + c("opp_pace")) / 2
    own, other = (c("own_off_rating") + c("opp_def_rating")) / 2, (c("opp_off_rating") + c("own_def_rating")) / 2
    known = poss.isNotNull() & own.isNotNull() & other.isNotNull()
    values = {"possessions": poss, "own_rating": own, "opp_rating": other, "own_points": own * poss / 100, "opp_points": other * poss / 100, "margin": (own - other) * poss / 100}
    return both.select("team_id", "opponent_id", *[F.when(known, v).alias(k) for k, v in values.items()])


def narrative(games: DataFrame, boxscores: DataFrame, stats: DataFrame, season: int, recent_n: int = 5, league: str | None = None) -> DataFrame:
    """A paragraph in Spanish on each team's season; null without a rated game.

    Pace, balance, share of threes, top scorer, and who is hot or cold. Box scores are read once, for the players'
    profiles, and the ratings once; names in a list are in order of z-score.
    """
    of = scoped(games.select(F.col("id").alias("game_id"), "season", "league"), season=season, league=league)
    style = stats.join(of, "game_id").groupBy("team_id").agg(mean("pace").alias("avg_pace"), mean("net_rating").alias("avg_net_rating"))
    found = players.season_profile(games, boxscores, season, recent_n, league=league).withColumn("z", places("z_score_pts", 6))
    in_form = lambda v: F.when(F.col("form_games") > 0, v)
    names = lambda label, key: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("enough") & (F.col("streak") == label), F.struct(key.alias("k"), "player_name")))), lambda s: s["player_name"]), ", ")
    lists = found.groupBy("team_id").agg(
        mean(in_form(F.col("fg3a_rate"))).alias("threes"),
        F.min(in_form(F.struct((-places("form_avg_pts", 6)).alias("p"), "player_name"))).alias("top"),
        names("hot", -F.col("z")).alias("hot"),
        names("cold", F.col("z")).alias("cold"),
    )
    rows = style.join(lists, "team_id", "full")
    pace, net, threes = places("avg_pace", 6), places("avg_net_rating", 6), places("threes", 6)
    number, share = S.fixed(pace), S.fixed(threes * 100, 0)
    signed = F.concat(F.when(net >= 0, "+").otherwise(""), S.fixed(net))
    recent = F.lit(str(recent_n))
    text = F.concat_ws(
        " ",
        _sentence(pace >= PACE_FAST, FAST, number),
        _sentence(pace <= PACE_SLOW, SLOW, number),
        _sentence((pace > PACE_SLOW) & (pace < PACE_FAST), MEDIUM, number),
        _sentence(net.isNotNull(), BALANCE, F.when(net > 0, "positivo").otherwise("negativo"), signed),
        _sentence(threes >= THREES_HIGH, MANY_THREES, share),
        _sentence(threes <= THREES_LOW, FEW_THREES, share),
        _sentence((threes > THREES_LOW) & (threes < THREES_HIGH), SOME_THREES, share),
        _sentence(F.col("top").isNotNull(), TOP_SCORER, F.col("top.player_name"), S.fixed(-F.col("top.p"))),
        _sentence(F.col("hot") != "", ON_FIRE, recent, F.col("hot")),
        _sentence(F.col("cold") != "", OUT_OF_FORM, recent, F.col("cold")),
    )
    return rows.select("team_id", F.when(pace.isNotNull(), text).alias("narrative"))
