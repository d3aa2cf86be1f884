"""Queries over players, teams, calendars and match-ups, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators import calendar, jobs, matchups, players, quality, teams
from courtside.operators.base import placed, places, rounded, team_games
from courtside.plans.domain import CTES, Tables

#: "Now" of the checked queries: none of them asks the clock.
REFERENCE = date(2001, 3, 1)
SEASON = 2000
TEAM, OPPONENT = 3, 7

def registrar() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """An empty registry of queries, one of SQL, and the decorator that fills both.

    The decorator takes the SQL that follows the shared CTEs; the query's name is the function's.
    """
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    twins: dict[str, str] = {}

    def query(sql: str):
        def register(f: Callable[[Tables], DataFrame]):
            found[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            body = sql.strip()
            head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.startswith(h)), None)
            twins[f.__name__] = f"{head}{CTES.strip()}, {body[len(head):]}" if head else f"WITH {CTES.strip()} {body}"
            return f

        return register

    return found, twins, query


QUERIES, SQL, query = registrar()


def m(column: str) -> str:
    """The mean of ``operators.base.mean``."""
    return f"sum(round({column} * 1e9::DOUBLE)::BIGINT)::DOUBLE / nullif(count({column}), 0) / 1e9::DOUBLE"


def _fixed(value: str, n: int = 1) -> str:
    """A figure as it is printed: fixed places, half to even."""
    return f"printf('%.{n}f', round_even({value}, {n}))"


_FORM = """
form_rows AS (
  SELECT b.*, row_number() OVER (PARTITION BY team_id, player_name ORDER BY game_id DESC) AS r FROM boxscores b JOIN games g ON g.id = b.game_id {where}
), form AS (
  SELECT team_id, player_name, count(*) AS games, """+m("mins")+""" AS avg_minutes, avg(coalesce(points, 0)) AS avg_pts, """+m("points * 36.0::DOUBLE / mins")+""" AS avg_pts_per36, """+m("efg_pct")+""" AS avg_efg_pct, """+m("ts_pct")+""" AS avg_ts_pct,
    """+m("plus_minus")+""" AS avg_plus_minus, avg(turnovers) AS avg_turnovers, sum(fg3_attempted)::DOUBLE / nullif(sum(fg_attempted), 0)::DOUBLE AS fg3a_rate, sum(ft_attempted)::DOUBLE / nullif(sum(fg_attempted), 0)::DOUBLE AS ft_rate
  FROM form_rows WHERE r <= {n} AND mins > 0 GROUP BY team_id, player_name
)"""
_FORM_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in "avg_minutes avg_pts avg_pts_per36 avg_efg_pct avg_ts_pct avg_plus_minus avg_turnovers fg3a_rate ft_rate".split())
FORM5 = _FORM.format(where="", n=5)

_STREAKS = """
streak_rows AS (
  SELECT b.team_id, b.player_name, g.season, coalesce(points, 0)::DOUBLE AS p, ts_pct, row_number() OVER (PARTITION BY b.team_id, player_name, season ORDER BY game_id DESC) AS r,
    row_number() OVER (PARTITION BY b.team_id, player_name, season ORDER BY ts_pct IS NULL, game_id DESC) AS rt
  FROM boxscores b JOIN games g ON g.id = b.game_id WHERE mins > 0 {where}
), streaks AS (
  SELECT *, (recent_avg_pts - season_avg_pts) / nullif(season_std_pts, 0) AS z_score_pts, (recent_avg_ts_pct - season_avg_ts_pct) / nullif(season_std_ts_pct, 0) AS z_score_ts FROM (
    SELECT team_id, player_name, season, count(*) AS games_season, avg(p) FILTER (r <= 5) AS recent_avg_pts, avg(p) AS season_avg_pts, stddev_pop(p) AS season_std_pts,
      CASE WHEN count(ts_pct) >= 6 THEN """+m("CASE WHEN rt <= 5 THEN ts_pct END")+""" END AS recent_avg_ts_pct, CASE WHEN count(ts_pct) >= 6 THEN """+m("ts_pct")+""" END AS season_avg_ts_pct,
      CASE WHEN count(ts_pct) >= 6 THEN stddev_pop(ts_pct) END AS season_std_ts_pct
    FROM streak_rows GROUP BY ALL HAVING count(*) >= 6)
)"""
STREAKS_ALL = _STREAKS.format(where="")
_STREAK_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in "recent_avg_pts season_avg_pts season_std_pts recent_avg_ts_pct season_avg_ts_pct season_std_ts_pct z_score_pts z_score_ts".split())

_SUMMARY = """
rated AS (
  SELECT s.team_id, """+m("pace")+""" AS avg_pace, """+m("off_rating")+""" AS avg_off_rating, """+m("def_rating")+""" AS avg_def_rating, """+m("net_rating")+""" AS avg_net_rating FROM team_game_stats s JOIN games g ON g.id = s.game_id {where} GROUP BY s.team_id
), shots AS (
  SELECT b.team_id, """+m("efg_pct")+""" AS avg_efg_pct, """+m("ts_pct")+""" AS avg_ts_pct FROM boxscores b JOIN games g ON g.id = b.game_id {where} GROUP BY b.team_id
), summaries AS (
  SELECT coalesce(rated.team_id, shots.team_id) AS team_id, avg_pace, avg_off_rating, avg_def_rating, avg_net_rating, avg_efg_pct, avg_ts_pct FROM rated FULL JOIN shots ON rated.team_id = shots.team_id
)"""
SUMMARY_ALL, SUMMARY_SEASON = _SUMMARY.format(where=""), _SUMMARY.format(where=f"WHERE g.season = {SEASON}")
_SUMMARY_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in "avg_pace avg_off_rating avg_def_rating avg_net_rating avg_efg_pct avg_ts_pct".split())


def _scores(df: DataFrame) -> DataFrame:
    """Scores that may be null as doubles, which every client reads alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in ("own_score", "opp_score")})


@query(f"WITH {FORM5} SELECT team_id, player_name, games, {_FORM_OUT} FROM form")
def recent_form(t: Tables) -> DataFrame:
    return rounded(players.recent_form(t.games, t.boxscores, 5))


@query(f"WITH {STREAKS_ALL} SELECT team_id, player_name, season, games_season, {_STREAK_OUT}, CASE WHEN round(z_score_pts, 6) >= 1 THEN 'hot' WHEN round(z_score_pts, 6) <= -1 THEN 'cold' ELSE 'neutral' END AS streak FROM streaks")
def streak_zscore(t: Tables) -> DataFrame:
    return rounded(players.streaks(t.games, t.boxscores))


@query(f"""
WITH {STREAKS_ALL}, loads AS (
  SELECT b.team_id, player_name, round(sum(mins), 6) AS total FROM boxscores b JOIN team_games t ON t.game_id = b.game_id AND t.team_id = b.team_id
  WHERE own_score IS NOT NULL AND game_date BETWEEN DATE '{REFERENCE}' - 30 AND DATE '{REFERENCE}' AND mins > 0 GROUP BY b.team_id, player_name)
SELECT 'streak' AS list, team_id, season, player_name, row_number() OVER (PARTITION BY team_id, season ORDER BY round(z_score_pts, 6) DESC NULLS LAST, player_name)::INTEGER AS place FROM streaks
UNION ALL SELECT 'load', team_id, {SEASON}, player_name, row_number() OVER (PARTITION BY team_id ORDER BY total DESC, player_name)::INTEGER FROM loads""")
def player_orders(t: Tables) -> DataFrame:
    """The orders in which streaks and loads are listed."""
    hot = placed(rounded(players.streaks(t.games, t.boxscores)), ["team_id", "season"], F.desc_nulls_last("z_score_pts"), "player_name")
    tired = placed(rounded(players.load(t.boxscores, calendar.in_window(t.games, REFERENCE, 30))), ["team_id"], F.desc("total_minutes"), "player_name")
    cols = ["list", "team_id", "season", "player_name", "place"]
    return hot.withColumn("list", F.lit("streak")).select(*cols).union(tired.withColumn("list", F.lit("load")).withColumn("season", F.lit(SEASON)).select(*cols))


@query("WITH " + _FORM.format(where="WHERE g.league = '1-URGENT'", n=5) + f" SELECT team_id, player_name, games, {_FORM_OUT} FROM form")
def league_form(t: Tables) -> DataFrame:
    """Recent form within one league: games of others neither count nor fill the window."""
    return rounded(players.recent_form(t.games, t.boxscores, 5, league="1-URGENT"))


@query("WITH " + _FORM.format(where="", n=5).replace("ORDER BY game_id DESC", "ORDER BY game_date DESC, game_id DESC") + f" SELECT team_id, player_name, games, {_FORM_OUT} FROM form")
def form_by_date(t: Tables) -> DataFrame:
    """Recent form, newest by the games' day."""
    return rounded(players.recent_form(t.games, t.boxscores, 5, by_date=True))


@query(f"""
SELECT b.team_id, player_name, round(sum(mins), 6) AS total_minutes, round({m('mins')}, 6) AS avg_minutes, count(*) AS games FROM boxscores b JOIN team_games t ON t.game_id = b.game_id AND t.team_id = b.team_id
WHERE own_score IS NOT NULL AND game_date BETWEEN DATE '{REFERENCE}' - 30 AND DATE '{REFERENCE}' AND mins > 0 GROUP BY b.team_id, player_name""")
def minute_load(t: Tables) -> DataFrame:
    return rounded(players.load(t.boxscores, calendar.in_window(t.games, REFERENCE, 30)))


@query("""
WITH days AS (
  SELECT b.team_id, player_name, game_date, sum(mins) AS mins, count(*) AS n FROM boxscores b JOIN games g ON g.id = b.game_id WHERE mins > 0 GROUP BY ALL
) SELECT team_id, player_name, game_date::VARCHAR AS game_date, round(sum(mins) OVER w, 6) AS load_minutes, (sum(n) OVER w)::BIGINT AS load_games FROM days
WINDOW w AS (PARTITION BY team_id, player_name ORDER BY game_date RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW)""")
def sliding_load(t: Tables) -> DataFrame:
    return rounded(players.sliding_load(t.games, t.boxscores, 14)).withColumn("game_date", F.col("game_date").cast("string"))


@query(f"""
WITH {FORM5}, means AS (SELECT *, round(avg(avg_pts) OVER w, 6) AS m1, round(avg(avg_efg_pct) OVER w, 6) AS m2, round(avg(avg_ts_pct) OVER w, 6) AS m3, round(avg(avg_turnovers) OVER w, 6) AS m4 FROM form WINDOW w AS (PARTITION BY team_id))
SELECT team_id, player_name, m1 AS team_avg_pts, m2 AS team_avg_efg_pct, m3 AS team_avg_ts_pct, m4 AS team_avg_turnovers,
  CASE WHEN round(avg_pts, 6) IS NULL THEN 'neutral' WHEN round(avg_pts, 6) >= m1 THEN 'good' ELSE 'bad' END AS avg_pts_mark, CASE WHEN round(avg_efg_pct, 6) IS NULL THEN 'neutral' WHEN round(avg_efg_pct, 6) >= m2 THEN 'good' ELSE 'bad' END AS avg_efg_pct_mark,
  CASE WHEN round(avg_ts_pct, 6) IS NULL THEN 'neutral' WHEN round(avg_ts_pct, 6) >= m3 THEN 'good' ELSE 'bad' END AS avg_ts_pct_mark, CASE WHEN round(avg_turnovers, 6) IS NULL THEN 'neutral' WHEN round(avg_turnovers, 6) <= m4 THEN 'good' ELSE 'bad' END AS avg_turnovers_mark
FROM means""")
def form_vs_team(t: Tables) -> DataFrame:
    marks = ["avg_pts", "avg_efg_pct", "avg_ts_pct", "avg_turnovers"]
    return players.against_team(players.recent_form(t.games, t.boxscores, 5)).select("team_id", "player_name", *[f"team_{c}" for c in marks], *[f"{c}_mark" for c in marks])


@query("SELECT *, CASE WHEN regexp_full_match(number, '[0-9]+') THEN number::INTEGER ELSE 999 END AS jersey, row_number() OVER (PARTITION BY team_id ORDER BY CASE WHEN regexp_full_match(number, '[0-9]+') THEN number::INTEGER ELSE 999 END, name)::INTEGER AS place FROM players WHERE photo_url IS NOT NULL")
def roster(t: Tables) -> DataFrame:
    return placed(players.roster(t.players), ["team_id"], "jersey", "name")


@query(f"""
WITH {FORM5}, renamed AS (SELECT team_id, replace(player_name, 'Supplier', 'Customer') AS name, games, round(avg_minutes, 6) AS avg_minutes, round(avg_pts, 6) AS avg_pts, round(avg_turnovers, 6) AS avg_turnovers FROM form)
SELECT p.team_id, p.name, p.number, games::DOUBLE AS games, avg_minutes, avg_pts, avg_turnovers FROM players p LEFT JOIN renamed r ON r.team_id = p.team_id AND r.name = p.name WHERE photo_url IS NOT NULL""")
def roster_with_form(t: Tables) -> DataFrame:
    # the driver's customers and suppliers have names of one pattern: a supplier's form stands for the customer's
    form = players.recent_form(t.games, t.boxscores, 5).withColumn("player_name", F.replace("player_name", F.lit("Supplier"), F.lit("Customer")))
    return rounded(players.roster_with_form(t.players, form).select("team_id", "name", "number", F.col("games").cast("double").alias("games"), "avg_minutes", "avg_pts", "avg_turnovers"))


@query("SELECT * FROM teams WHERE id IN (SELECT team_id FROM players)")
def has_roster(t: Tables) -> DataFrame:
    return players.teams_with_roster(t.teams, t.players)


@query("SELECT * FROM team_game_stats")
def game_ratings(t: Tables) -> DataFrame:
    return t.team_game_stats


@query("SELECT game_id, team_id, is_home, own_score, opp_score, fga, fta, orb, tov, pts, reb, ast FROM totals")
def box_totals(t: Tables) -> DataFrame:
    return teams.box_totals(t.games, t.boxscores)


@query(f"WITH {SUMMARY_ALL} SELECT team_id, {_SUMMARY_OUT} FROM summaries")
def advanced_summary(t: Tables) -> DataFrame:
    return rounded(teams.advanced_summary(t.games, t.boxscores, t.team_game_stats))


@query(f"""
WITH {SUMMARY_SEASON}, played AS (SELECT team_id, count(*) AS n FROM team_games WHERE own_score IS NOT NULL AND season = {SEASON} GROUP BY team_id), waiting AS (SELECT team_id, count(*) AS n FROM team_games WHERE own_score IS NULL GROUP BY team_id)
SELECT coalesce(s.team_id, p.team_id, w.team_id) AS team_id, {_SUMMARY_OUT}, coalesce(p.n, 0) AS games_played, coalesce(w.n, 0) AS games_pending FROM summaries s FULL JOIN played p ON p.team_id = s.team_id FULL JOIN waiting w ON w.team_id = coalesce(s.team_id, p.team_id)""")
def summary(t: Tables) -> DataFrame:
    return rounded(teams.summary(t.games, t.boxscores, t.team_game_stats, season=SEASON))


@query("""
WITH sums AS (SELECT game_id, team_id, sum(rebounds) AS reb, sum(assists) AS ast FROM boxscores GROUP BY ALL)
SELECT t.team_id, t.season, count(*) AS games_played, count(*) FILTER (own_score > opp_score) AS wins, count(*) FILTER (own_score < opp_score) AS losses,
  round_even(sum(own_score)::DOUBLE / count(*), 1) AS points_per_game, round_even(sum(coalesce(reb, 0))::DOUBLE / count(*), 1) AS rebounds_per_game, round_even(sum(coalesce(ast, 0))::DOUBLE / count(*), 1) AS assists_per_game,
  round_even("""+m("pace")+""", 1) AS pace, round_even("""+m("off_rating")+""", 1) AS off_rating, round_even("""+m("def_rating")+""", 1) AS def_rating,
  round_even("""+m("net_rating")+""", 1) AS net_rating
FROM team_games t LEFT JOIN sums b ON b.game_id = t.game_id AND b.team_id = t.team_id LEFT JOIN team_game_stats s ON s.game_id = t.game_id AND s.team_id = t.team_id WHERE own_score IS NOT NULL AND season IS NOT NULL GROUP BY t.team_id, t.season""")
def season_team_stats(t: Tables) -> DataFrame:
    return teams.season_stats(t.games, t.boxscores, t.team_game_stats)


@query("SELECT league, count(*) AS games FROM games WHERE home_score IS NOT NULL GROUP BY league")
def league_counts(t: Tables) -> DataFrame:
    return teams.league_counts(t.games)


@query("SELECT arg_max(date, id) AS last_game_date, count(*) AS n_games, (SELECT count(*) FROM boxscores) AS n_boxscores, (SELECT count(*) FROM teams) AS n_teams FROM games")
def freshness(t: Tables) -> DataFrame:
    return teams.freshness(t.games, t.boxscores, t.teams)


@query("SELECT DISTINCT team_id, season FROM team_games WHERE season IS NOT NULL")
def seasons(t: Tables) -> DataFrame:
    return teams.seasons(t.games)


@query("SELECT DISTINCT team_id, league, upper(league[1:1]) || lower(league[2:]) AS label FROM team_games WHERE league <> ''")
def leagues(t: Tables) -> DataFrame:
    return teams.leagues(t.games)


@query(f"""
WITH own AS (SELECT t.team_id, season, CASE WHEN s.game_id IS NOT NULL THEN season END AS played FROM team_games t LEFT JOIN team_game_stats s ON s.game_id = t.game_id AND s.team_id = t.team_id)
SELECT team_id, CASE WHEN coalesce(bool_or(played = {SEASON}), false) THEN {SEASON} WHEN max(played) IS NOT NULL THEN max(played) WHEN bool_or(season = {SEASON}) THEN {SEASON} ELSE max(season) END::INTEGER AS season FROM own GROUP BY team_id""")
def current_season(t: Tables) -> DataFrame:
    return teams.current_season(t.games, t.team_game_stats, REFERENCE)


@query(f"""
WITH own AS (SELECT t.team_id, season, league, CASE WHEN s.game_id IS NOT NULL THEN season END AS played FROM team_games t LEFT JOIN team_game_stats s ON s.game_id = t.game_id AND s.team_id = t.team_id)
SELECT team_id, array_to_string(list_reverse_sort(list(DISTINCT season)), ',') AS seasons, array_to_string(list_sort(list(DISTINCT league)), ',') AS leagues,
  CASE WHEN coalesce(bool_or(played = {SEASON}), false) THEN {SEASON} WHEN max(played) IS NOT NULL THEN max(played) WHEN bool_or(season = {SEASON}) THEN {SEASON} ELSE max(season) END::INTEGER AS default_season FROM own GROUP BY team_id""")
def filter_options(t: Tables) -> DataFrame:
    out = teams.filter_options(t.games, t.team_game_stats, REFERENCE)
    return out.select("team_id", F.array_join("seasons", ",").alias("seasons"), F.array_join(F.transform("leagues", lambda x: x["league"]), ",").alias("leagues"), "default_season")


@query("SELECT game_id, team_id, opponent_id, is_home, own_score, opp_score, season, CASE WHEN own_score > opp_score THEN 'W' ELSE 'L' END AS result, own_score || '-' || opp_score AS score, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC NULLS LAST, game_id DESC)::INTEGER AS place FROM team_games WHERE own_score IS NOT NULL")
def past_games(t: Tables) -> DataFrame:
    return calendar.past(t.games).select("game_id", "team_id", "opponent_id", "is_home", "own_score", "opp_score", "season", "result", "score", "place")


@query(f"SELECT game_id, team_id, opponent_id, date, is_home, row_number() OVER (PARTITION BY team_id ORDER BY game_date NULLS LAST, game_id)::INTEGER AS place FROM team_games WHERE own_score IS NULL AND game_date >= DATE '{REFERENCE}'")
def upcoming_games(t: Tables) -> DataFrame:
    return calendar.upcoming(t.games, REFERENCE).select("game_id", "team_id", "opponent_id", "date", "is_home", "place")


@query(f"SELECT game_id, date, season, league, opponent_id, is_home, CASE WHEN own_score IS NULL THEN 'pendiente' ELSE own_score || '-' || opp_score END AS score, row_number() OVER (PARTITION BY team_id ORDER BY game_date NULLS FIRST, game_id)::INTEGER AS place FROM team_games WHERE team_id = {TEAM} AND season = {SEASON}")
def team_calendar(t: Tables) -> DataFrame:
    return calendar.calendar(t.games, team_id=TEAM, season=SEASON).select("game_id", "date", "season", "league", "opponent_id", "is_home", S.score_label(F.col("own_score"), F.col("opp_score")).alias("score"), "place")


@query(f"SELECT game_id, date, is_home, own_score::DOUBLE AS own_score, opp_score::DOUBLE AS opp_score FROM team_games WHERE team_id = {TEAM} AND opponent_id = {OPPONENT}")
def head_to_head(t: Tables) -> DataFrame:
    return _scores(calendar.head_to_head(t.games, TEAM, OPPONENT)).select("game_id", "date", "is_home", "own_score", "opp_score")


@query("SELECT team_id, opponent_id, game_id, own_score, opp_score, r::INTEGER AS recency FROM (SELECT *, row_number() OVER (PARTITION BY team_id, opponent_id ORDER BY game_date DESC, game_id DESC) AS r FROM team_games WHERE own_score IS NOT NULL) WHERE r <= 2")
def last2_head_to_head(t: Tables) -> DataFrame:
    rows = calendar.newest(team_games(t.games).where("own_score is not null"), ["team_id", "opponent_id"], 2)
    return rows.select("team_id", "opponent_id", "game_id", "own_score", "opp_score", "recency")


@query("""
SELECT n.team_id, n.game_id, r::INTEGER AS recency, own_score, opp_score, pace, off_rating, def_rating, net_rating FROM (
  SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS r FROM team_games WHERE own_score IS NOT NULL) n LEFT JOIN team_game_stats s ON s.game_id = n.game_id AND s.team_id = n.team_id WHERE r <= 5""")
def recent_games(t: Tables) -> DataFrame:
    return calendar.recent(t.games, t.team_game_stats, 5).select("team_id", "game_id", "recency", "own_score", "opp_score", "pace", "off_rating", "def_rating", "net_rating")


@query(f"""
WITH lists AS (
  SELECT 0 AS branch, -epoch_day AS d, -game_id AS i, * FROM (SELECT *, (game_date - DATE '1970-01-01') AS epoch_day FROM team_games) WHERE team_id = {TEAM} AND own_score IS NOT NULL AND season = {SEASON}
  UNION ALL SELECT 1, epoch_day, game_id, * FROM (SELECT *, (game_date - DATE '1970-01-01') AS epoch_day FROM team_games) WHERE team_id = {TEAM} AND own_score IS NULL AND season = {SEASON} AND game_date >= DATE '{REFERENCE}'
), cut AS (SELECT *, (SELECT count(*) FROM lists) AS total FROM lists ORDER BY branch, d NULLS LAST, i LIMIT 50 OFFSET 10)
SELECT cut.game_id, branch, opponent_id, own_score::DOUBLE AS own_score, opp_score::DOUBLE AS opp_score, pace, net_rating, total FROM cut LEFT JOIN team_game_stats s ON s.game_id = cut.game_id AND s.team_id = {TEAM}""")
def games_page(t: Tables) -> DataFrame:
    return _scores(calendar.page(t.games, t.team_game_stats, REFERENCE, TEAM, 50, 10, SEASON)).select("game_id", "branch", "opponent_id", "own_score", "opp_score", "pace", "net_rating", "total")


@query("SELECT team_id, opponent_id, count(*) AS games, count(*) FILTER (own_score > opp_score) AS wins FROM team_games WHERE own_score IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def recurring_rivals(t: Tables) -> DataFrame:
    return calendar.recurring_rivals(t.games)


@query(f"""
WITH {SUMMARY_ALL}, ahead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS k FROM team_games WHERE own_score IS NULL AND game_date >= DATE '{REFERENCE}') WHERE k <= 5)
SELECT a.team_id, count(*) AS games_considered, count(avg_net_rating) AS opponents_scouted, round({m('avg_net_rating')}, 6) AS avg_opponent_net_rating, string_agg(n.name, '|' ORDER BY k) AS opponents
FROM ahead a LEFT JOIN summaries s ON s.team_id = a.opponent_id LEFT JOIN teams n ON n.id = a.opponent_id GROUP BY a.team_id""")
def schedule_difficulty(t: Tables) -> DataFrame:
    summaries = teams.advanced_summary(t.games, t.boxscores, t.team_game_stats)
    out = matchups.difficulty(calendar.upcoming(t.games, REFERENCE), summaries, t.teams, 5)
    return rounded(out.withColumn("opponents", F.array_join(F.transform("opponents", lambda o: o["opponent"]), "|")))


@query("WITH " + _SUMMARY.format(where="WHERE g.league = '1-URGENT'") + f""", ahead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date, game_id) AS k FROM team_games WHERE own_score IS NULL AND league = '1-URGENT' AND game_date >= DATE '{REFERENCE}') WHERE k <= 3)
SELECT a.team_id, count(*) AS games_considered, count(avg_net_rating) AS opponents_scouted, round({m('avg_net_rating')}, 6) AS avg_opponent_net_rating FROM ahead a LEFT JOIN summaries s ON s.team_id = a.opponent_id GROUP BY a.team_id""")
def league_difficulty(t: Tables) -> DataFrame:
    """Schedule difficulty within one league."""
    summaries = teams.advanced_summary(t.games, t.boxscores, t.team_game_stats, league="1-URGENT")
    return rounded(matchups.difficulty(calendar.upcoming(t.games, REFERENCE, league="1-URGENT"), summaries, t.teams, 3).drop("opponents"))


@query(f"""
WITH {SUMMARY_SEASON}, pairs AS (SELECT a.id AS team_id, b.id AS opponent_id FROM teams a JOIN teams b ON b.id = (a.id + 1) % 25), both_sides AS (
  SELECT p.team_id, p.opponent_id, (o.avg_pace + r.avg_pace) / 2 AS poss, (o.avg_off_rating + r.avg_def_rating) / 2 AS own, (r.avg_off_rating + o.avg_def_rating) / 2 AS opp FROM pairs p LEFT JOIN summaries o ON o.team_id = p.team_id LEFT JOIN summaries r ON r.team_id = p.opponent_id)
SELECT team_id, opponent_id, round(poss, 6) AS possessions, round(own, 6) AS own_rating, round(opp, 6) AS opp_rating, round(own * poss / 100, 6) AS own_points, round(opp * poss / 100, 6) AS opp_points, round((own - opp) * poss / 100, 6) AS margin FROM both_sides""")
def projection(t: Tables) -> DataFrame:
    pairs = t.teams.select(F.col("id").alias("team_id"), ((F.col("id") + 1) % 25).alias("opponent_id"))
    return rounded(matchups.projection(teams.advanced_summary(t.games, t.boxscores, t.team_game_stats, season=SEASON), pairs))


@query(f"""
WITH {SUMMARY_SEASON}, {_FORM.format(where=f"WHERE g.season = {SEASON}", n=1000)}, {_STREAKS.format(where=f"AND g.season = {SEASON}")},
profile AS (SELECT team_id, {m('fg3a_rate')} AS threes, arg_min(player_name, (-round(avg_pts, 6), player_name)) AS top_name, max(round(avg_pts, 6)) AS top_pts FROM form GROUP BY team_id),
lists AS (SELECT team_id, string_agg(player_name, ', ' ORDER BY round(z_score_pts, 6) DESC, player_name) FILTER (round(z_score_pts, 6) >= 1) AS hot, string_agg(player_name, ', ' ORDER BY round(z_score_pts, 6), player_name) FILTER (round(z_score_pts, 6) <= -1) AS cold FROM streaks GROUP BY team_id),
shown AS (SELECT s.team_id, round(avg_pace, 6) AS pace, round(avg_net_rating, 6) AS net, round(threes, 6) AS threes, top_name, top_pts, hot, cold FROM summaries s LEFT JOIN profile p ON p.team_id = s.team_id LEFT JOIN lists l ON l.team_id = s.team_id)
SELECT team_id, CASE WHEN pace IS NOT NULL THEN concat_ws(' ',
  'Juega a ritmo ' || CASE WHEN pace >= 75 THEN 'alto' WHEN pace <= 68 THEN 'bajo' ELSE 'intermedio' END || ' (' || {_fixed('pace')} || ' posesiones estimadas por partido).',
  'Balance ' || CASE WHEN net > 0 THEN 'positivo' ELSE 'negativo' END || ': ' || CASE WHEN net >= 0 THEN '+' ELSE '' END || {_fixed('net')} || ' de Net Rating medio.',
  CASE WHEN threes >= 0.4 THEN 'Ataque muy volcado al triple: ' || {_fixed('(threes * 100)', 0)} || '% de los intentos son de 3.' WHEN threes <= 0.25 THEN 'Ataque poco dependiente del triple: solo ' || {_fixed('(threes * 100)', 0)} || '% de los intentos son de 3.' WHEN threes IS NOT NULL THEN 'Reparto de tiro equilibrado: ' || {_fixed('(threes * 100)', 0)} || '% de los intentos son de 3.' END,
  'Máximo anotador: ' || top_name || ' (' || {_fixed('top_pts')} || ' puntos por partido).', 'En racha anotadora (últimos 5 partidos): ' || hot || '.', 'Bajo forma anotadora (últimos 5 partidos): ' || cold || '.') END AS narrative FROM shown""")
def narrative(t: Tables) -> DataFrame:
    return matchups.narrative(t.games, t.boxscores, t.team_game_stats, SEASON)


@query("""
WITH faults AS (
  SELECT t.game_id, t.team_id, date, CASE WHEN is_home THEN 'local' ELSE 'visitante' END AS side, own_score, sum(coalesce(points, 0))::BIGINT AS summed, string_agg(player_name, ', ' ORDER BY player_name) FILTER (coalesce(minutes, '') = '') AS players
  FROM team_games t JOIN boxscores b ON b.game_id = t.game_id AND b.team_id = t.team_id GROUP BY ALL)
SELECT game_id, team_id, 'points' AS kind, 'Partido ' || game_id || ' (' || date || '): puntos del box score ' || side || ' (' || summed || ') no cuadran con el resultado guardado (' || own_score || ')' AS message FROM faults WHERE abs(summed - own_score) > 2
UNION ALL SELECT game_id, team_id, 'minutes', 'Partido ' || game_id || ' (' || date || '): jugadores sin minutos registrados en el box score ' || side || ': ' || players FROM faults WHERE players <> ''""")
def data_quality(t: Tables) -> DataFrame:
    return quality.warnings(t.games, t.boxscores)


@query("SELECT coalesce(s.source, w.source) AS source, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AND coalesce(place, -1) = 0 AS primary_empty FROM (SELECT source, count(*) AS n FROM source_games GROUP BY source) s FULL JOIN (VALUES ('realgm', 0), ('src1', 1), ('src2', 2)) w(source, place) ON w.source = s.source")
def source_report(t: Tables) -> DataFrame:
    return quality.source_report(t.source_games, ["realgm", "src1", "src2"])


@query("SELECT league, count(*) AS games, count(*) * 20 AS seconds FROM games WHERE home_score IS NOT NULL AND boxscore_url <> '' AND id NOT IN (SELECT game_id FROM boxscores) GROUP BY league")
def pending_downloads(t: Tables) -> DataFrame:
    return calendar.pending_downloads(t.games, t.boxscores)


@query("SELECT game_id, team_id, player_name, points, round(points * 36.0::DOUBLE / nullif(mins, 0), 6) AS pts_per36, round_even(efg_pct * 100, 1) AS efg, round_even(ts_pct * 100, 1) AS ts, row_number() OVER (PARTITION BY game_id, team_id ORDER BY points DESC NULLS LAST, player_name)::INTEGER AS place FROM boxscores")
def boxscore(t: Tables) -> DataFrame:
    per36 = places(S.per_36(F.col("points"), S.parse_minutes(F.col("minutes"))), 6)
    rows = t.boxscores.select("game_id", "team_id", "player_name", "points", per36.alias("pts_per36"), places(F.col("efg_pct") * 100, 1, half_even=True).alias("efg"), places(F.col("ts_pct") * 100, 1, half_even=True).alias("ts"))
    return placed(rows, ["game_id", "team_id"], F.desc_nulls_last("points"), "player_name")


@query("""
WITH interest AS (SELECT id AS team_id, slug FROM teams WHERE slug IN ('nation_1', 'nation_2', 'nation_3', 'algeria', 'brazil', 'canada')), own AS (SELECT t.*, i.slug FROM team_games t JOIN interest i ON i.team_id = t.team_id WHERE boxscore_url IS NOT NULL),
picked AS (
  SELECT boxscore_url, game_id, team_id, 'last' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS r FROM own) WHERE r <= 10
  UNION ALL SELECT boxscore_url, game_id, o.team_id, 'between' FROM own o JOIN teams n ON n.id = o.opponent_id WHERE EXISTS (SELECT 1 FROM interest i WHERE i.slug <> o.slug AND contains(regexp_replace(lower(n.name), '[\\s-]+', '', 'g'), i.slug)))
SELECT boxscore_url, game_id, team_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY boxscore_url ORDER BY reason DESC, team_id) AS r FROM picked) WHERE r = 1""")
def box_selection(t: Tables) -> DataFrame:
    return calendar.box_selection(t.games, t.teams, ["nation_1", "nation_2", "nation_3", "algeria", "brazil", "canada"])


@query("SELECT team_id, id, last_n, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY created_at DESC, id DESC) AS r FROM ingest_jobs) WHERE r = 1")
def latest_job(t: Tables) -> DataFrame:
    return jobs.latest(t.ingest_jobs)


@query("SELECT * FROM ingest_jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1")
def claimed_job(t: Tables) -> DataFrame:
    return jobs.claim(t.ingest_jobs)


@query("SELECT team_id, id, last_n, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY created_at DESC, id DESC) AS r FROM ingest_jobs WHERE status IN ('queued', 'running')) WHERE r = 1")
def active_jobs(t: Tables) -> DataFrame:
    return jobs.active(t.ingest_jobs)


@query("""
WITH asked AS (SELECT id + 1000000000000 AS id, team_id + 25 * (id % 40) AS team_id, last_n, created_at FROM ingest_jobs), busy AS (SELECT DISTINCT team_id FROM ingest_jobs WHERE status IN ('queued', 'running'))
SELECT id, team_id, last_n, 'queued' AS status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY created_at, id) AS r FROM asked WHERE last_n BETWEEN 1 AND 15 AND team_id NOT IN (SELECT team_id FROM busy)) WHERE r = 1""")
def enqueued_jobs(t: Tables) -> DataFrame:
    """Every request again, of its own team or of one of many others."""
    asked = t.ingest_jobs.select((F.col("id") + 1_000_000_000_000).alias("id"), (F.col("team_id") + 25 * (F.col("id") % 40)).alias("team_id"), "last_n", "created_at")
    return jobs.enqueue(t.ingest_jobs, asked)


@query("""
SELECT id, team_id, CASE WHEN id % 2 = 1 THEN status WHEN id % 6 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN id % 6 = 0 THEN 'boom ' || id END AS error, CASE WHEN id % 2 = 0 THEN created_at + INTERVAL 1 HOUR END AS finished_at FROM ingest_jobs""")
def finished_jobs(t: Tables) -> DataFrame:
    """Half of the jobs come back, a third of them with an error."""
    known = t.ingest_jobs.withColumns({"error": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp")})
    back = known.where("id % 2 = 0").select("id", F.when(F.col("id") % 6 == 0, F.concat(F.lit("boom "), F.col("id").cast("string"))).alias("error"), (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"))
    return jobs.finish(known, back).select("id", "team_id", "status", "error", "finished_at")
