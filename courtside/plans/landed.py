"""Queries over landed pages and documents: the driver's tables written as sources write them, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators.base import team_games
from courtside.plans import pages as paging
from courtside.plans.analytics import registrar
from courtside.plans.domain import Tables
from courtside.sources import html_tables, json_games

QUERIES, SQL, query = registrar()


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _row(*cells: tuple[str, Column]) -> Column:
    """A table row of (attributes, text) cells."""
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<td{a}>"), v, F.lit("</td>")) for a, v in cells], F.lit("</tr>"))


def _page(before: str, after: str) -> Column:
    return F.concat(F.lit(before), F.col("trs"), F.lit(after))


@query("SELECT league, name AS team, id::VARCHAR AS wins FROM teams")
def standings_pages(t: Tables) -> DataFrame:
    """Pages of each league: its standings behind another table; a column that stands twice counts once."""
    tr = _row((' data-stat="team|a"', F.col("name")), (' data-stat="wins|a"', _text("id")), (' data-stat="wins|b"', F.lit("9")))
    pages = paging.listed(t.teams, ["league"], "id", tr).select("league", _page('<table id="x"><tr><td data-stat="team">No</td></tr></table><table id="all_standings"><tbody><tr class="thead"><th>-</th></tr>', "</tbody></table>").alias("html"))
    v = F.col("values")
    return html_tables.standings(pages, "league").select("league", v["team"].alias("team"), v["wins"].alias("wins"))


@query("SELECT team_id, name, coalesce(position, '') AS position, coalesce(number, '') AS more FROM players")
def team_pages(t: Tables) -> DataFrame:
    """Pages of each team: its per-game table, told by its id or by its caption, with a cell beyond the headers."""
    tr = _row(("", F.col("name")), ("", _text("position")), ("", _text("number")))
    head = F.when(F.col("team_id") % 2 == 0, '<table id="per_game">').otherwise("<table><caption>Per Game stats</caption>")
    pages = paging.listed(t.players, ["team_id"], "id", tr).select("team_id", F.concat(head, _page("<thead><tr><th>Player</th><th>Pos</th></tr></thead>", "</table>")).alias("html"))
    v = F.col("values")
    return html_tables.team_roster(pages).select("team_id", v["Player"].alias("name"), v["Pos"].alias("position"), v["col_2"].alias("more"))


@query("SELECT id, name || ' ' || position AS meta, coalesce(number, '') AS number, 'https://players.example/GameLogs/' || id AS logs FROM players")
def player_pages(t: Tables) -> DataFrame:
    """A page a player: who they are, a per-game table, and the link to their page found by their name."""
    html = F.concat(F.lit('<div id="meta"><p>'), F.col("name"), F.lit("</p> <b>"), _text("position"), F.lit('</b></div><a href="/other">Other</a><a href="https://players.example/Summary/'), _text("id"), F.lit('"> '), F.upper("name"), F.lit(' </a><table id="per_game"><thead><tr><th>No</th></tr></thead><tr><td>'), _text("number"), F.lit("</td></tr></table>"))
    pages = t.players.select("id", html.alias("html"), html_tables.game_log_url(html_tables.link_to(html, F.col("name"))).alias("logs"))
    return html_tables.player_pages(pages).select("id", "meta", F.col("values")["No"].alias("number"), "logs")


@query("""
SELECT g.game_date::VARCHAR AS date, g.league, t.name AS team, o.name AS opponent, is_home, own_score::DOUBLE AS points, opp_score::DOUBLE AS opp_points FROM team_games g JOIN teams t ON t.id = team_id JOIN teams o ON o.id = opponent_id""")
def day_pages(t: Tables) -> DataFrame:
    """Pages of each day and league: every game of it, away side first, from both sides."""
    name = lambda side: t.teams.select(F.col("id").alias(f"{side}_team_id"), F.col("name").alias(side))
    rows = t.games.join(name("home"), "home_team_id").join(name("away"), "away_team_id").withColumn("date", F.col("game_date").cast("string"))
    score = F.when(F.col("home_score").isNull(), "").otherwise(F.concat(_text("away_score"), F.lit(" - "), _text("home_score")))
    listed = paging.listed(rows, ["date", "league"], "id", _row(("", F.col("away")), ("", score), ("", F.col("home")), ("", F.lit("Hall"))))
    pages = listed.select("date", "league", _page("<table><thead><tr><th>Away Team</th><th>Score</th><th>Home Team</th><th>Venue</th></tr></thead>", "</table>").alias("html"))
    out = html_tables.day_schedule(pages)
    return out.withColumns({c: F.col(c).cast("double") for c in ("points", "opp_points")})


@query("SELECT player_id, g.date, nullif(minutes, '') AS minutes, points::DOUBLE AS points, coalesce(turnovers::VARCHAR, '') AS turnovers FROM (SELECT regexp_extract(player_name, '#0*([0-9]+)$', 1)::BIGINT AS player_id, * FROM boxscores) JOIN games g ON g.id = game_id")
def game_log_pages(t: Tables) -> DataFrame:
    """Pages of each player: the log of all games under the headers of its source, and a row without a date."""
    rows = t.player_game_logs.join(t.games.select(F.col("id").alias("game_id"), "date"), "game_id")
    listed = paging.listed(rows, ["player_id"], "game_id", _row(("", F.col("date")), ("", _text("minutes")), ("", _text("points")), ("", _text("turnovers"))))
    pages = listed.select("player_id", _page("<table><tr><td>x</td></tr></table><table><thead><tr><th>Date</th><th>MIN</th><th>PTS</th><th>TO</th></tr></thead>", "<tr><td></td><td></td><td>9</td></tr></table>").alias("html"))
    v = F.col("values")
    return html_tables.game_logs(pages).select("player_id", v["Date"].alias("date"), S.blank_to_null(v["MP"]).alias("minutes"), S.to_float(v["PTS"]).alias("points"), v["TOV"].alias("turnovers"))


def _named(value: Column) -> Column:
    """A name as content systems nest it."""
    return F.struct(F.struct(F.struct(value.alias("name")).alias("attributes")).alias("data"))


@query("""
SELECT g.team_id, g.date, o.name AS opponent, is_home, own_score::DOUBLE AS points, opp_score::DOUBLE AS opp_points, CASE game_id % 4 WHEN 0 THEN 'acb' WHEN 1 THEN 'copa-del-rey' WHEN 2 THEN 'club' ELSE 'gira-de-verano' END AS league
FROM team_games g JOIN teams o ON o.id = g.opponent_id WHERE game_date >= DATE '1995-01-01' AND game_date <= DATE '2001-06-30'""")
def cms_games(t: Tables) -> DataFrame:
    """Every team's games as its club's content system sends them, documents for each season, within day bounds."""
    name = lambda side: t.teams.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    rows = team_games(t.games).join(name("team"), "team_id").join(name("opponent"), "opponent_id")
    pick = lambda a, b: F.when(F.col("is_home"), F.col(a)).otherwise(F.col(b))
    k = F.col("game_id") % 4
    competition = F.when(k == 0, "Liga Endesa").when(k == 1, "Copa Del Rey").when(k == 3, "Gira de verano")
    item = F.struct(
        F.concat(F.col("game_date").cast("string"), F.lit("T18:00:00Z")).alias("gameDate"),
        pick("own_score", "opp_score").alias("homeScore"),
        pick("opp_score", "own_score").alias("awayScore"),
        _named(pick("team_name", "opponent_name")).alias("homeTeam"),
        _named(pick("opponent_name", "team_name")).alias("awayTeam"),
        _named(competition).alias("competition"),
    )
    landed = paging.document(rows, ["team_id", "team_name", "season"], "game_id", F.struct(item.alias("attributes")))
    out = json_games.cms_games(landed, F.col("team_name"), first="1995-01-01", last="2001-06-30").drop("team_name", "season", "page")
    return out.withColumns({c: F.col(c).cast("double") for c in ("points", "opp_points")})


@query("SELECT team_id, name || ' ' || id AS name, position, number, CASE WHEN photo_url IS NULL THEN NULL WHEN id % 2 = 0 THEN 'https://media.example/small/' || id ELSE 'https://media.example/full/' || id END AS photo_url FROM players")
def cms_rosters(t: Tables) -> DataFrame:
    """Every team's roster as its club's content system sends it, in documents; the small photo goes before the full one."""
    photo = lambda kind: F.concat(F.lit(f"/{kind}/"), F.col("id").cast("string"))
    small = F.when(F.col("id") % 2 == 0, F.struct(F.struct(photo("small").alias("url")).alias("small")))
    image = F.when(F.col("photo_url").isNotNull(), F.struct(F.struct(photo("full").alias("url"), small.alias("formats")).alias("attributes")))
    item = F.struct(
        F.concat(F.lit(" "), F.col("name")).alias("name"),
        F.concat(F.col("id").cast("string"), F.lit(" ")).alias("lastName"),
        F.col("number").alias("dorsal"),
        F.struct(F.struct(F.struct(F.col("position").alias("label")).alias("attributes")).alias("data")).alias("team_member_position"),
        F.struct(image.alias("data")).alias("photo"),
    )
    landed = paging.document(t.players, ["team_id"], "id", F.struct(item.alias("attributes")))
    return json_games.cms_roster(landed, "https://media.example").drop("page")
