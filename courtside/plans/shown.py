"""Queries for the tables as they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame

from courtside.operators import calendar, matchups, players, teams
from courtside.operators.base import team_games
from courtside.plans.analytics import FORM5, REFERENCE, SEASON, STREAKS_ALL, SUMMARY_ALL, registrar
from courtside.plans.domain import Tables
from courtside.sources import display

QUERIES, SQL, query = registrar()

_LONG = """['domingo','lunes','martes','miércoles','jueves','viernes','sábado'][dayofweek(game_date) + 1] || ', ' || day(game_date) || ' de ' || ['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'][month(game_date)] || ' de ' || year(game_date)"""
_MARK = "CASE WHEN {z} IS NULL THEN '-' WHEN {z} >= 1 THEN '🔥 en racha' WHEN {z} <= -1 THEN '❄️ bajo forma' ELSE '➖' END"


@query(f"""
WITH {FORM5} SELECT team_id, player_name AS "Jugador", games AS "PJ", round_even(avg_minutes, 1) AS "MIN", round_even(avg_pts, 1) AS "PTS", round_even(avg_pts_per36, 1) AS "PTS/36",
  round_even(avg_efg_pct * 100, 1) AS "eFG%", round_even(avg_ts_pct * 100, 1) AS "TS%", round_even(fg3a_rate * 100, 1) AS "3PA%", round_even(ft_rate, 2) AS "FTr" FROM form""")
def form_table(t: Tables) -> DataFrame:
    return display.form_table(players.recent_form(t.games, t.boxscores, 5))


@query(f"""
WITH {STREAKS_ALL} SELECT team_id, season, player_name AS "Jugador", games_season AS "PJ temporada", round_even(recent_avg_pts, 1) AS "PTS últimos 5", round_even(season_avg_pts, 1) AS "PTS temporada",
  round_even(z_score_pts, 2) AS "z-score PTS", {_MARK.format(z="z_score_pts")} AS "Racha PTS", round_even(recent_avg_ts_pct * 100, 1) AS "TS% últimos 5", round_even(season_avg_ts_pct * 100, 1) AS "TS% temporada",
  round_even(z_score_ts, 2) AS "z-score TS%", {_MARK.format(z="z_score_ts")} AS "Racha TS%" FROM streaks""")
def streak_table(t: Tables) -> DataFrame:
    return display.streak_table(players.streaks(t.games, t.boxscores))


@query(f"""
WITH loads AS (
  SELECT b.team_id, player_name, sum(mins) AS total, sum(round(mins * 1e9::DOUBLE)::BIGINT)::DOUBLE / nullif(count(mins), 0) / 1e9::DOUBLE AS per_game, count(*) AS n FROM boxscores b JOIN team_games t ON t.game_id = b.game_id AND t.team_id = b.team_id
  WHERE own_score IS NOT NULL AND game_date BETWEEN DATE '{REFERENCE}' - 30 AND DATE '{REFERENCE}' AND mins > 0 GROUP BY b.team_id, player_name)
SELECT team_id, player_name AS "Jugador", n AS "PJ ventana", round_even(total, 1) AS "MIN totales", round_even(per_game, 1) AS "MIN/partido" FROM loads""")
def load_table(t: Tables) -> DataFrame:
    return display.load_table(players.load(t.boxscores, calendar.in_window(t.games, REFERENCE, 30)))


@query(f"""
WITH {SUMMARY_ALL}, ahead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS k FROM team_games WHERE own_score IS NULL AND game_date >= DATE '{REFERENCE}') WHERE k <= 5)
SELECT a.team_id, k::INTEGER AS "#", {_LONG} AS "Fecha", n.name AS "Rival", round_even(avg_net_rating, 1) AS "Net Rating" FROM ahead a LEFT JOIN summaries s ON s.team_id = a.opponent_id LEFT JOIN teams n ON n.id = a.opponent_id""")
def difficulty_table(t: Tables) -> DataFrame:
    summaries = teams.advanced_summary(t.games, t.boxscores, t.team_game_stats)
    return display.difficulty_table(matchups.difficulty(calendar.upcoming(t.games, REFERENCE), summaries, t.teams, 5))


@query(f"""
SELECT g.team_id, g.game_id, {_LONG} AS "Fecha", n.name AS "Rival", CASE WHEN own_score IS NULL THEN '-' ELSE own_score || '-' || opp_score END AS "Resultado", round_even(pace, 1) AS "Pace", round_even(off_rating, 1) AS "ORtg", round_even(def_rating, 1) AS "DRtg", round_even(net_rating, 1) AS "Net"
FROM team_games g LEFT JOIN teams n ON n.id = g.opponent_id LEFT JOIN team_game_stats s ON s.game_id = g.game_id AND s.team_id = g.team_id WHERE season = {SEASON}""")
def games_table(t: Tables) -> DataFrame:
    return display.games_table(team_games(t.games).where(f"season = {SEASON}"), t.team_game_stats, t.teams)


@query("""
SELECT game_id, team_id, player_name AS "Jugador", nullif(minutes, '') AS "MIN", points AS "PTS", rebounds AS "REB", assists AS "AST", round_even(points * 36.0::DOUBLE / nullif(mins, 0), 1) AS "PTS/36", round_even(efg_pct * 100, 1) AS "eFG%", round_even(ts_pct * 100, 1) AS "TS%" FROM boxscores""")
def box_table(t: Tables) -> DataFrame:
    return display.box_table(t.boxscores)
