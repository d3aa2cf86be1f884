"""Queries over sources, fusion, entities, upserts, parsing and scalar functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside import schemas
from courtside.functions import names
from courtside.functions import scalars as S
from courtside.operators import entities, fusion, ingest, players, teams, upsert
from courtside.operators.base import places, ranked, team_games
from courtside.plans import pages
from courtside.plans.analytics import FORM5, registrar
from courtside.plans.domain import Tables
from courtside.sources import html_tables, json_games, reports

QUERIES, SQL, query = registrar()

_KEYED = r"""
keyed AS (
  SELECT *, trim(regexp_replace(regexp_replace(lower(strip_accents(opponent)), '\b(bc|basket|basketball|club|sad|sporting|sports)\b', '', 'g'), '\s+', ' ', 'g'), ' ') AS rival,
    CASE WHEN points IS NOT NULL OR opp_points IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(boxscore_url, '') <> '' THEN 1 ELSE 0 END AS score FROM source_games
)"""


@query(f"WITH {_KEYED} SELECT src_ord, source, reports::BIGINT AS reports FROM (SELECT *, row_number() OVER (PARTITION BY date, rival, is_home ORDER BY priority, score DESC, src_ord) AS r, count(*) OVER (PARTITION BY date, rival, is_home) AS reports FROM keyed) WHERE r = 1")
def fusion_winners(t: Tables) -> DataFrame:
    return fusion.fuse(t.source_games, fill=False).select("src_ord", "source", "reports")


@query(f"""
WITH {_KEYED}, filled AS (
  SELECT src_ord, date, is_home, row_number() OVER (PARTITION BY date, rival, is_home ORDER BY priority, score DESC, src_ord) AS r,
    coalesce(nullif(opponent_slug, ''), first_value(nullif(opponent_slug, '') IGNORE NULLS) OVER w) AS opponent_slug, coalesce(boxscore_url, first_value(boxscore_url IGNORE NULLS) OVER w) AS boxscore_url,
    coalesce(points, first_value(points IGNORE NULLS) OVER w)::DOUBLE AS points, coalesce(opp_points, first_value(opp_points IGNORE NULLS) OVER w)::DOUBLE AS opp_points, coalesce(notes, first_value(notes IGNORE NULLS) OVER w) AS notes, league
  FROM keyed WINDOW w AS (PARTITION BY date, rival, is_home ORDER BY priority, src_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
) SELECT * EXCLUDE (r) FROM filled WHERE r = 1""")
def fusion_gapfill(t: Tables) -> DataFrame:
    out = fusion.fuse(t.source_games)
    return out.select("src_ord", "date", "is_home", "opponent_slug", "boxscore_url", F.col("points").cast("double").alias("points"), F.col("opp_points").cast("double").alias("opp_points"), "notes", "league")


#: Opponents one by one, in the order of their rows: each step takes the list of teams as the step before left it.
_SETTLED = r"""
asked AS (
  SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 <> 0 THEN p_brand || CASE p_partkey % 4 WHEN 0 THEN ' Basket' WHEN 1 THEN '' WHEN 2 THEN '-BC' ELSE ' Club' END WHEN p_partkey % 4 = 0 THEN t.name || ' Basket' WHEN p_partkey % 4 = 1 THEN substr(t.name, 1, 6) ELSE t.name END AS opponent,
    CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN lower(p_brand) ELSE '' END WHEN p_partkey % 5 = 0 THEN t.slug WHEN p_partkey % 7 = 0 THEN 'alt-' || t.id ELSE '' END AS opponent_slug
  FROM part JOIN teams t ON t.id = p_partkey % 25
), asked_rows AS (
  SELECT *, regexp_replace(lower(strip_accents(opponent)), '[\s-]+', '', 'g') AS key, row_number() OVER (ORDER BY ord) AS i FROM asked
), run AS (
  SELECT 0::BIGINT AS i, '' AS found_by, (SELECT list({'slug': slug, 'name': name, 'key': regexp_replace(lower(strip_accents(name)), '[\s-]+', '', 'g'), 'league': league} ORDER BY id) FROM teams) AS held, 0::BIGINT AS place
  UNION ALL
  SELECT i, CASE WHEN s > 0 THEN 'slug' WHEN n > 0 THEN 'name' ELSE 'new' END,
    CASE WHEN s > 0 OR n > 0 AND opponent_slug = '' THEN held WHEN n > 0 THEN list_transform(held, lambda t, j: {'slug': CASE WHEN j = n THEN opponent_slug ELSE t.slug END, 'name': t.name, 'key': t.key, 'league': t.league})
      ELSE list_append(held, {'slug': wanted, 'name': opponent, 'key': key, 'league': 'cup'}) END, CASE WHEN s > 0 THEN s WHEN n > 0 THEN n ELSE len(held) + 1 END
  FROM (SELECT e.*, r.held, coalesce(nullif(opponent_slug, ''), e.key) AS wanted, coalesce(list_position(list_transform(r.held, lambda t: t.slug), coalesce(nullif(opponent_slug, ''), e.key)), 0) AS s,
      CASE WHEN length(e.key) >= 4 THEN coalesce(list_position(list_transform(r.held, lambda t: t.key <> '' AND (contains(t.key, e.key) OR contains(e.key, t.key))), true), 0) ELSE 0 END AS n
    FROM run r JOIN asked_rows e ON e.i = r.i + 1)
), at_last AS (SELECT max_by(held, i) AS held FROM run)"""


def _opponents(t: Tables) -> DataFrame:
    """Opponents as sources might write them: of stored teams with a club word, cut short, under a slug of another source; and of teams that come up in the delivery."""
    k = F.col("p_partkey")
    rows = t.raw("part").select("p_brand", k, (k % 25).alias("id")).join(t.teams.select("id", "name", "slug"), "id")
    word = F.element_at(F.array(*map(F.lit, (" Basket", "", "-BC", " Club"))), (k % 4 + 1).cast("int"))
    stored = F.when(k % 4 == 0, F.concat("name", F.lit(" Basket"))).when(k % 4 == 1, F.substring("name", 1, 6)).otherwise(F.col("name"))
    slug = F.when(k % 3 != 0, F.when(k % 5 == 0, F.lower("p_brand")).otherwise("")).when(k % 5 == 0, F.col("slug")).when(k % 7 == 0, F.concat(F.lit("alt-"), F.col("id").cast("string"))).otherwise("")
    return rows.select(k.alias("src_ord"), F.when(k % 3 != 0, F.concat("p_brand", word)).otherwise(stored).alias("opponent"), slug.alias("opponent_slug"), F.lit("cup").alias("league"))


@query(f"""
WITH RECURSIVE {_SETTLED}
SELECT opponent, opponent_slug, min(ord) AS src_ord, arg_min(found_by, ord) AS found_by, arg_min(held[place].slug, ord) AS slug, arg_min(held[place].name, ord) AS name
FROM (SELECT a.opponent, a.opponent_slug, a.ord, r.found_by, r.place, l.held FROM asked_rows a JOIN run r ON r.i = a.i, at_last l) GROUP BY opponent, opponent_slug""")
def resolve_opponents(t: Tables) -> DataFrame:
    """Of each spelling the first row: how it finds its team, and what that is called in the end."""
    _, every, found = entities.settle(_opponents(t), t.teams)
    return found.join(every.select(F.col("id").alias("team_id"), "slug", "name"), "team_id").select("opponent", "opponent_slug", "src_ord", "found_by", "slug", "name")


@query(f"WITH RECURSIVE {_SETTLED} SELECT row_number() OVER (ORDER BY place)::INTEGER AS place, slug, name, league FROM (SELECT unnest(range(1, len(held) + 1)) AS place, unnest(held, recursive := true) FROM at_last)")
def settled_teams(t: Tables) -> DataFrame:
    """The teams after a delivery: slugs as they moved, and new teams in the order in which they came up."""
    every = entities.settle(_opponents(t), t.teams)[1]
    return ranked(every, "place", [F.asc("id")], F.floor(F.col("id") / 65536)).select("place", "slug", "name", "league")


@query(f"""
WITH RECURSIVE {_SETTLED}
SELECT slug, count(*) AS reports, min(ord) AS first_ord, max(ord) AS last_ord FROM (SELECT l.held[r.place].slug AS slug, a.ord FROM asked_rows a JOIN run r ON r.i = a.i, at_last l) GROUP BY slug""")
def reports_by_team(t: Tables) -> DataFrame:
    """Every row of a delivery under the team that it means in the end."""
    resolved, every, _ = entities.settle(_opponents(t), t.teams)
    named = resolved.join(every.select(F.col("id").alias("team_id"), "slug"), "team_id")
    return named.groupBy("slug").agg(F.count("*").alias("reports"), F.min("src_ord").alias("first_ord"), F.max("src_ord").alias("last_ord"))


def _ids(out: DataFrame, stored: DataFrame) -> DataFrame:
    """An upsert's rows with the ids of stored rows as doubles, and whether those of inserted ones are beyond all of them.

    Which inserted row has which id follows from a hash that SQL doesn't have; that they are unique is tested on a
    fixture.
    """
    new, most = F.col("change") == "inserted", stored.agg(F.max("id")).scalar()
    rest = [c for c in out.columns if c != "id"]
    return out.select(F.when(~new, F.col("id")).cast("double").alias("id"), *rest, F.when(new, F.col("id") > most).otherwise(True).alias("id_fits"))


_MERGED = """
more AS (
  SELECT * FROM teams UNION ALL SELECT id + 100, slug || '-2', 'Real ' || name || ' Basket', league FROM teams WHERE id % 5 = 0
), merged AS (
  SELECT m.id, min(c.id) AS canonical_id FROM more m JOIN teams c ON contains(regexp_replace(lower(m.name), '[\\s-]+', '', 'g'), c.slug) AND m.slug <> c.slug GROUP BY m.id HAVING m.id <> min(c.id)
)"""


def _more_teams(t: Tables) -> DataFrame:
    again = t.teams.where("id % 5 = 0").select((F.col("id") + 100).alias("id"), F.concat("slug", F.lit("-2")).alias("slug"), F.concat(F.lit("Real "), "name", F.lit(" Basket")).alias("name"), "league")
    return t.teams.unionByName(again)


@query(f"WITH {_MERGED} SELECT * FROM merged")
def duplicate_teams(t: Tables) -> DataFrame:
    return entities.duplicates(_more_teams(t), t.teams)


@query(f"""
WITH {_MERGED}, pointed AS (SELECT id, date, home_team_id + CASE WHEN id % 2 = 0 AND home_team_id % 5 = 0 THEN 100 ELSE 0 END AS home_team_id, away_team_id FROM games),
back AS (SELECT p.id, date, coalesce(h.canonical_id, home_team_id) AS home_team_id, coalesce(a.canonical_id, away_team_id) AS away_team_id FROM pointed p LEFT JOIN merged h ON h.id = home_team_id LEFT JOIN merged a ON a.id = away_team_id)
SELECT id, date, home_team_id, away_team_id FROM (SELECT *, row_number() OVER (PARTITION BY date, home_team_id, away_team_id ORDER BY id) AS r FROM back) WHERE r = 1""")
def remap_teams(t: Tables) -> DataFrame:
    twin = (F.col("id") % 2 == 0) & (F.col("home_team_id") % 5 == 0)
    pointed = t.games.withColumn("home_team_id", F.col("home_team_id") + F.when(twin, 100).otherwise(0))
    merged = entities.duplicates(_more_teams(t), t.teams)
    return entities.merge_duplicates({"games": pointed, "teams": _more_teams(t)}, merged)["games"].select("id", "date", "home_team_id", "away_team_id")


@query("""
WITH fresh AS (SELECT slug, upper(name) AS name, 'X' AS league FROM teams WHERE id % 2 = 0 UNION ALL SELECT 'new-' || slug, name, league FROM teams)
SELECT t.id::DOUBLE AS id, coalesce(t.slug, f.slug) AS slug, CASE WHEN f.slug IS NOT NULL THEN f.name ELSE t.name END AS name, CASE WHEN f.slug IS NOT NULL THEN f.league ELSE t.league END AS league,
  CASE WHEN t.slug IS NULL THEN 'inserted' WHEN f.slug IS NOT NULL THEN 'updated' ELSE 'kept' END AS change, true AS id_fits FROM teams t FULL JOIN fresh f ON f.slug = t.slug""")
def upsert_teams(t: Tables) -> DataFrame:
    fresh = t.teams.where("id % 2 = 0").select("slug", F.upper("name").alias("name"), F.lit("X").alias("league")).unionByName(t.teams.select(F.concat(F.lit("new-"), "slug").alias("slug"), "name", "league"))
    return _ids(upsert.upsert(t.teams, fresh, upsert.rules("teams")), t.teams)


@query("""
WITH fresh AS (SELECT name, team_id, '' AS position, (id % 7)::VARCHAR AS number, photo_url FROM players WHERE id % 3 = 0)
SELECT p.id::DOUBLE AS id, p.name, p.team_id, p.position, coalesce(f.number, p.number) AS number, p.photo_url, CASE WHEN f.name IS NOT NULL THEN 'updated' ELSE 'kept' END AS change, true AS id_fits FROM players p LEFT JOIN fresh f ON f.name = p.name AND f.team_id = p.team_id""")
def upsert_players(t: Tables) -> DataFrame:
    fresh = t.players.where("id % 3 = 0").select("name", "team_id", F.lit("").alias("position"), (F.col("id") % 7).cast("string").alias("number"), "photo_url")
    return _ids(upsert.upsert(t.players, fresh, upsert.rules("players")), t.players)


@query("""
WITH stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, home_team_id, away_team_id ORDER BY id) AS r FROM games WHERE id % 2 = 0) WHERE r = 1),
fresh AS (SELECT id AS ord, date, home_team_id, away_team_id, league, season, nullif(home_score % 5, 0) AS home_score, nullif(away_score % 5, 0) AS away_score, boxscore_url, game_date FROM games),
folded AS (SELECT date, home_team_id, away_team_id, arg_max(league, ord) AS league, arg_max(season, ord) AS season, arg_max(home_score, ord) FILTER (home_score IS NOT NULL) AS home_score, arg_max(away_score, ord) FILTER (away_score IS NOT NULL) AS away_score, arg_max(boxscore_url, ord) FILTER (boxscore_url IS NOT NULL) AS boxscore_url, arg_min(game_date, ord) AS game_date FROM fresh GROUP BY ALL)
SELECT s.id::DOUBLE AS id, coalesce(s.date, f.date) AS date, coalesce(s.game_date, f.game_date)::VARCHAR AS game_date, coalesce(s.home_team_id, f.home_team_id) AS home_team_id, coalesce(s.away_team_id, f.away_team_id) AS away_team_id, coalesce(f.league, s.league) AS league, coalesce(f.season, s.season) AS season,
  coalesce(f.home_score, s.home_score)::DOUBLE AS home_score, coalesce(f.away_score, s.away_score)::DOUBLE AS away_score, coalesce(f.boxscore_url, s.boxscore_url) AS boxscore_url, CASE WHEN s.date IS NULL THEN 'inserted' WHEN f.date IS NOT NULL THEN 'updated' ELSE 'kept' END AS change, true AS id_fits
FROM stored s FULL JOIN folded f ON f.date = s.date AND f.home_team_id = s.home_team_id AND f.away_team_id = s.away_team_id""")
def upsert_games(t: Tables) -> DataFrame:
    """Half of the games stored, all reported with scores that may be 0, which count as missing here."""
    first = F.row_number().over(W.partitionBy("date", "home_team_id", "away_team_id").orderBy("id"))
    stored = t.games.where("id % 2 = 0").withColumn("r", first).where("r = 1").drop("r", "notes")
    fresh = t.games.withColumns({c: (F.col(c) % 5).cast("int") for c in ("home_score", "away_score")}).drop("notes")
    out = _ids(upsert.upsert(stored, fresh.withColumnRenamed("id", "ord"), upsert.rules("games"), order="ord", zero_is_missing=True), stored)
    return out.withColumns({c: F.col(c).cast("double") for c in ("home_score", "away_score")} | {"game_date": F.col("game_date").cast("string")})


@query("""
WITH fresh AS (SELECT game_id, team_id, player_name, '' AS minutes, points + 1 AS points, NULL::INTEGER AS fg3_made, fg_attempted FROM boxscores WHERE points % 4 = 0),
gone AS (SELECT * FROM boxscores WHERE points % 8 <> 4)
SELECT coalesce(b.game_id, f.game_id) AS game_id, coalesce(b.player_name, f.player_name) AS player_name, coalesce(b.team_id, f.team_id) AS team_id, b.minutes, coalesce(f.points, b.points) AS points, coalesce(f.fg_attempted, b.fg_attempted) AS fg_attempted,
  round((coalesce(b.fg_made, 0) + 0.5::DOUBLE * coalesce(b.fg3_made, 0)) / nullif(coalesce(f.fg_attempted, b.fg_attempted), 0), 6) AS efg_pct,
  round(coalesce(f.points, b.points) / nullif(2.0::DOUBLE * (coalesce(f.fg_attempted, b.fg_attempted) + 0.44::DOUBLE * coalesce(b.ft_attempted, 0)), 0), 6) AS ts_pct,
  CASE WHEN b.game_id IS NULL THEN 'inserted' WHEN f.game_id IS NOT NULL THEN 'updated' ELSE 'kept' END AS change
FROM gone b FULL JOIN fresh f ON f.game_id = b.game_id AND f.player_name = b.player_name AND f.team_id = b.team_id""")
def upsert_boxscores(t: Tables) -> DataFrame:
    """Half of the rows that are reported again are stored; the rest come in without the columns that a source lacks."""
    fresh = t.boxscores.where("points % 4 = 0").select("game_id", "team_id", "player_name", F.lit("").alias("minutes"), (F.col("points") + 1).alias("points"), F.lit(None).cast("int").alias("fg3_made"), "fg_attempted")
    out = upsert.upsert(t.boxscores.where("points % 8 <> 4"), fresh, upsert.rules("boxscores"))
    return out.select("game_id", "player_name", "team_id", "minutes", "points", "fg_attempted", places("efg_pct", 6).alias("efg_pct"), places("ts_pct", 6).alias("ts_pct"), "change")


@query("""
WITH stored AS (SELECT game_id * 100 + team_id AS id, game_id, team_id, possessions, 0.0::DOUBLE AS pace FROM team_game_stats WHERE team_id % 2 = 0)
SELECT s.id::DOUBLE AS id, f.game_id, f.team_id, f.possessions, f.pace, f.net_rating, f.team_points, CASE WHEN s.id IS NULL THEN 'inserted' ELSE 'updated' END AS change, true AS id_fits
FROM team_game_stats f LEFT JOIN stored s ON s.game_id = f.game_id AND s.team_id = f.team_id""")
def upsert_team_game_stats(t: Tables) -> DataFrame:
    """One side of each game is stored with a pace to be overwritten, both are reported."""
    stats = t.team_game_stats
    stored = stats.where("team_id % 2 = 0").select((F.col("game_id") * 100 + F.col("team_id")).alias("id"), "game_id", "team_id", "possessions", F.lit(0.0).alias("pace"))
    return _ids(upsert.upsert(stored, stats, upsert.rules("team_game_stats")), stored).select("id", "game_id", "team_id", "possessions", "pace", "net_rating", "team_points", "change", "id_fits")


@query("""
WITH logs AS (SELECT game_id * 100000 + regexp_extract(player_name, '#0*([0-9]+)$', 1)::BIGINT AS id, regexp_extract(player_name, '#0*([0-9]+)$', 1)::BIGINT AS player_id, b.*, season FROM boxscores b JOIN games g ON g.id = game_id)
SELECT CASE WHEN game_id % 3 <> 0 THEN id END::DOUBLE AS id, player_id, game_id, season, CASE WHEN game_id % 3 <> 0 AND minutes <> '' THEN minutes ELSE nullif(minutes, '') END AS minutes, points + 1 AS points, round(efg_pct, 6) AS efg_pct,
  round((points + 1) / nullif(2.0::DOUBLE * (fg_attempted + 0.44::DOUBLE * ft_attempted), 0), 6) AS ts_pct, CASE WHEN game_id % 3 <> 0 THEN 'updated' ELSE 'inserted' END AS change, true AS id_fits FROM logs""")
def upsert_player_game_logs(t: Tables) -> DataFrame:
    """Logs of two games in three are stored, all are reported with a point more."""
    logs = t.player_game_logs.withColumn("minutes", S.blank_to_null(F.col("minutes")))
    stored = logs.where("game_id % 3 <> 0")
    out = _ids(upsert.upsert(stored, logs.withColumn("points", F.col("points") + 1), upsert.rules("player_game_logs")), stored)
    return out.select("id", "player_id", "game_id", "season", "minutes", "points", places("efg_pct", 6).alias("efg_pct"), places("ts_pct", 6).alias("ts_pct"), "change", "id_fits")


@query("""
WITH table_ AS (SELECT team_id, season, count(*) AS games_played, count(*) FILTER (own_score > opp_score) AS wins, count(*) FILTER (own_score < opp_score) AS losses FROM team_games WHERE own_score IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN season % 2 = 0 THEN team_id * 10000 + season END::DOUBLE AS id, team_id, season, games_played, wins, losses, CASE WHEN season % 2 = 0 THEN 'updated' ELSE 'inserted' END AS change, true AS id_fits FROM table_""")
def upsert_season_team_stats(t: Tables) -> DataFrame:
    """Season tables of every other season are stored, without a win; all are made anew."""
    table = teams.season_stats(t.games, t.boxscores, t.team_game_stats)
    stored = table.where("season % 2 = 0").select((F.col("team_id") * 10_000 + F.col("season")).alias("id"), "team_id", "season", F.lit(0).cast("long").alias("wins"))
    return _ids(upsert.upsert(stored, table, upsert.rules("season_team_stats")), stored).select("id", "team_id", "season", "games_played", "wins", "losses", "change", "id_fits")


@query("SELECT game_id, team_id, player_name FROM boxscores WHERE game_id NOT IN (SELECT id FROM games WHERE home_score IS NOT NULL) OR team_id NOT IN (SELECT id FROM teams WHERE id < 24)")
def orphan_boxscores(t: Tables) -> DataFrame:
    """Box scores whose game isn't among those played, or whose team isn't among all but the last."""
    key = ["game_id", "team_id", "player_name"]
    both = schemas.orphans(t.boxscores, "game_id", t.games.where("home_score is not null")).select(*key).union(schemas.orphans(t.boxscores, "team_id", t.teams.where("id < 24")).select(*key))
    return both.distinct()


@query("SELECT date, home_team_id, away_team_id, count(*) AS n FROM games GROUP BY ALL HAVING count(*) > 1")
def duplicate_game_keys(t: Tables) -> DataFrame:
    return schemas.duplicate_keys(t.games, "games")


@query("""
SELECT id, season, season || '-' || lpad(((season + 1) % 100)::VARCHAR, 2, '0') AS label, game_date::VARCHAR AS iso,
  ['domingo','lunes','martes','miércoles','jueves','viernes','sábado'][dayofweek(game_date) + 1] || ', ' || day(game_date) || ' de ' || ['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'][month(game_date)] || ' de ' || year(game_date) AS long_form,
  make_date(season, 10, 1)::VARCHAR AS first_day, make_date(season + 1, 6, 30)::VARCHAR AS last_day FROM games""")
def date_functions(t: Tables) -> DataFrame:
    text = F.col("date")
    season = S.season_of(S.parse_date(text))
    first, last = S.season_range(season)
    return t.games.select("id", season.alias("season"), S.season_label(season).alias("label"), S.iso_date(text).alias("iso"), S.long_date_es(text).alias("long_form"), first.cast("string").alias("first_day"), last.cast("string").alias("last_day"))


@query("SELECT game_id, player_name, round(mins, 6) AS mins, round(points * 36.0::DOUBLE / nullif(mins, 0), 6) AS pts36, round(turnovers * 36.0::DOUBLE / nullif(mins, 0), 6) AS tov36 FROM boxscores")
def minutes_per36(t: Tables) -> DataFrame:
    mins = S.parse_minutes(F.col("minutes"))
    return t.boxscores.select("game_id", "player_name", places(mins, 6).alias("mins"), places(S.per_36(F.col("points"), mins), 6).alias("pts36"), places(S.per_36(F.col("turnovers"), mins), 6).alias("tov36"))


@query("SELECT game_id, player_name, round(efg_pct, 6) AS efg, round(ts_pct, 6) AS ts, round(fg_attempted - offensive_rebounds + coalesce(turnovers, 0) + 0.4::DOUBLE * ft_attempted, 4) AS poss FROM boxscores")
def shooting(t: Tables) -> DataFrame:
    c = F.col
    poss = S.possessions(c("fg_attempted"), c("offensive_rebounds"), c("turnovers"), c("ft_attempted"))
    return t.boxscores.select("game_id", "player_name", places("efg_pct", 6).alias("efg"), places("ts_pct", 6).alias("ts"), places(poss, 4).alias("poss"))


@query(r"""
WITH texts AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN value::VARCHAR WHEN 1 THEN '' WHEN 2 THEN ' ' || (event_id % 90) || ' ' WHEN 3 THEN (event_id % 90) || 'd' WHEN 4 THEN 'nan' ELSE '-' || value END AS s FROM events),
numbers AS (SELECT event_id, CASE WHEN regexp_full_match(trim(s), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN trim(s)::DOUBLE END AS x FROM texts)
SELECT event_id, x AS as_float, trunc(x)::INTEGER::DOUBLE AS as_int FROM numbers""")
def safe_casts(t: Tables) -> DataFrame:
    e, v = F.col("event_id"), F.col("value").cast("string")
    digits = (e % 90).cast("string")
    text = F.when(e % 6 == 0, v).when(e % 6 == 1, "").when(e % 6 == 2, F.concat(F.lit(" "), digits, F.lit(" "))).when(e % 6 == 3, F.concat(digits, F.lit("d"))).when(e % 6 == 4, "nan").otherwise(F.concat(F.lit("-"), v))
    return t.raw("events").select("event_id", S.to_float(text).alias("as_float"), S.to_int(text).cast("double").alias("as_int"))


@query(r"SELECT doc_id, regexp_replace(lower(strip_accents(h)), '[\s-]+', '', 'g') AS team_key, trim(regexp_replace(regexp_replace(lower(strip_accents(h)), '\b(bc|basket|basketball|club|sad|sporting|sports)\b', '', 'g'), '\s+', ' ', 'g'), ' ') AS source_key FROM (SELECT doc_id, text || ' Basket Club' AS h FROM documents)")
def normalised_names(t: Tables) -> DataFrame:
    name = F.concat("text", F.lit(" Basket Club"))
    return t.raw("documents").select("doc_id", names.team_key(name).alias("team_key"), names.source_key(name).alias("source_key"))


@query(r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\xFF]', '?', 'g') AS plain FROM documents")
def latin1_texts(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", names.latin1(F.col("text")).alias("plain"))


@query(r"""
WITH ids AS (SELECT id, slug || CASE id % 5 WHEN 0 THEN '-ELG-regular-season' WHEN 1 THEN '-SPA-playoffs' WHEN 2 THEN '-ITA-regular-season' WHEN 3 THEN '-games' ELSE '-elg-regular-season' END AS table_id, CASE id % 4 WHEN 0 THEN 'Liga Endesa' WHEN 1 THEN 'Copa Del Rey' WHEN 2 THEN '' ELSE 'Gira de verano' END AS cms FROM teams)
SELECT id, CASE code WHEN '' THEN NULL WHEN 'SPA' THEN 'acb' WHEN 'ELG' THEN 'euroleague' ELSE lower(code) END AS competition, CASE cms WHEN '' THEN 'club' WHEN 'Liga Endesa' THEN 'acb' WHEN 'Copa Del Rey' THEN 'copa-del-rey' ELSE replace(lower(cms), ' ', '-') END AS league
FROM (SELECT *, regexp_extract(table_id, '-([A-Z]+)-(?:regular-season|playoffs)$', 1) AS code FROM ids)""")
def competition_code(t: Tables) -> DataFrame:
    k = F.col("id") % 5
    suffix = F.when(k == 0, "-ELG-regular-season").when(k == 1, "-SPA-playoffs").when(k == 2, "-ITA-regular-season").when(k == 3, "-games").otherwise("-elg-regular-season")
    n = F.col("id") % 4
    cms = F.when(n == 0, "Liga Endesa").when(n == 1, "Copa Del Rey").when(n == 2, "").otherwise("Gira de verano")
    return t.teams.select("id", S.table_competition(F.concat("slug", suffix)).alias("competition"), S.cms_league(cms).alias("league"))


@query("SELECT id, name, slug, league FROM teams WHERE slug = (SELECT slug FROM teams WHERE id = 3)")
def team_by_slug(t: Tables) -> DataFrame:
    wanted = t.teams.where("id = 3").select("slug")
    return t.teams.join(wanted, "slug", "left_semi").select("id", "name", "slug", "league")


@query("SELECT id, slug, CASE WHEN slug = 'nation_3' THEN 'Third' ELSE name END AS display, league, row_number() OVER (ORDER BY name)::INTEGER AS place FROM teams")
def teams_by_name(t: Tables) -> DataFrame:
    named = ranked(t.teams, "place", [F.asc("name")], F.substring("name", 1, 2))
    return named.select("id", "slug", S.display_name(F.col("slug"), F.col("name"), {"nation_3": "Third"}).alias("display"), "league", "place")


@query(r"SELECT page_id, regexp_matches(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'example\.com$') AS own_host FROM pages")
def host_predicate(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", S.is_host(F.col("url"), "example.com").alias("own_host"))


@query(r"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, (len(regexp_extract_all(html, '<!--')))::INTEGER AS comments, (len(regexp_extract_all(html, '<a href=\"')))::INTEGER AS links, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS first_link FROM pages")
def html_extract(t: Tables) -> DataFrame:
    h = "html"
    count = lambda p: F.regexp_count(h, F.lit(p)).cast("int")
    return t.raw("pages").select("page_id", F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1).alias("title"), count("<!--").alias("comments"), count('<a href="').alias("links"), F.regexp_extract(h, '<a href="([^"]*)"', 1).alias("first_link"))


def _landed_schedules(t: Tables) -> DataFrame:
    """Each team's calendar as landed schedule pages of its seasons, the table hidden in a comment."""
    rows = team_games(t.games).join(t.teams.select(F.col("id").alias("opponent_id"), F.col("name").alias("opp"), F.col("slug").alias("opp_slug")), "opponent_id")
    cell = lambda stat, v: F.concat(F.lit(f'<td data-stat="{stat}">'), F.coalesce(v.cast("string"), F.lit("")), F.lit("</td>"))
    link = F.when(F.col("boxscore_url").isNotNull(), F.concat(F.lit('<a href="'), F.col("boxscore_url"), F.lit('">'), F.col("date"), F.lit("</a>"))).otherwise(F.col("date"))
    rival = F.concat(F.lit('<a href="/teams/'), F.col("opp_slug"), F.lit('/2001.html">'), F.col("opp"), F.lit("</a>"))
    tr = F.concat(F.lit("<tr>"), cell("date_game_full", link), cell("opp_name_link|x", rival), cell("game_location", F.when(F.col("is_home"), "").otherwise("@")), cell("pts", F.col("own_score")), cell("opp_pts", F.col("opp_score")), F.lit("</tr>"))
    body = pages.listed(rows, ["team_id", "season"], "game_id", tr)
    page = F.concat(F.lit('<html><!-- <table id="team-ELG-regular-season"><thead><tr><th>Date</th></tr></thead><tbody>'), F.col("trs"), F.lit("</tbody></table> --></html>"))
    return body.select("team_id", "season", page.alias("html"))


@query("""
SELECT g.team_id, g.season, g.date, o.name AS opponent, o.slug AS opponent_slug, CASE WHEN contains(boxscore_url, 'boxscores') THEN boxscore_url END AS boxscore_url, is_home, own_score::DOUBLE AS points, opp_score::DOUBLE AS opp_points, 'euroleague' AS league
FROM team_games g JOIN teams o ON o.id = g.opponent_id""")
def parsed_schedules(t: Tables) -> DataFrame:
    out = html_tables.schedule(_landed_schedules(t)).drop("notes")
    return out.withColumns({c: F.col(c).cast("double") for c in ("points", "opp_points")})


def _landed_boxes(t: Tables, named: bool = True) -> DataFrame:
    """Every game's box score as a landed page of the source with headers of its own, home table first.

    Without ``named`` the tables' ids don't tell the sides, and they lie in a comment behind another table.
    """
    rows = t.boxscores.join(t.games.select(F.col("id").alias("game_id"), "home_team_id"), "game_id")
    cells = [F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in ("player_name", "minutes", "points", "rebounds", "turnovers", "fg_made", "fg_attempted", "fg3_made", "fg3_attempted", "ft_attempted")]
    head = "".join(f"<th>{h}</th>" for h in ("Player", "MIN", "PTS", "REB", "TO", "FGM", "FGA", "3PM", "3PA", "FTA"))
    side = F.when(F.col("team_id") == F.col("home_team_id"), 0).otherwise(1)
    tables = rows.withColumn("side", side).groupBy("game_id", "side").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")))), "").alias("trs"))
    ids = lambda s: F.when(s["side"] == 0, "box-score-home").otherwise("box-score-visitor") if named else F.lit("stats")
    page = F.transform(F.sort_array(F.collect_list(F.struct("side", "trs"))), lambda s: F.concat(F.lit('<table id="x-'), ids(s), F.lit(f'"><thead><tr>{head}</tr></thead><tbody>'), s["trs"], F.lit("</tbody></table>")))
    html = F.array_join(page, "")
    return tables.groupBy("game_id").agg((html if named else F.concat(F.lit("<table><tr><th>Quarter</th></tr></table><!-- "), html, F.lit(" -->"))).alias("html"))


@query("""
SELECT b.game_id, CASE WHEN b.team_id = home_team_id THEN 'home' ELSE 'away' END AS side, player_name, minutes, points::DOUBLE AS points, turnovers::DOUBLE AS turnovers, fg_attempted::DOUBLE AS fg_attempted, round(efg_pct, 6) AS efg_pct, round(ts_pct, 6) AS ts_pct
FROM (SELECT * REPLACE (nullif(minutes, '') AS minutes) FROM boxscores) b JOIN games g ON g.id = b.game_id""")
def parsed_boxes(t: Tables) -> DataFrame:
    out = html_tables.box_stats(html_tables.box_scores(_landed_boxes(t), "game_id"))
    numbers = [F.col(c).cast("double").alias(c) for c in ("points", "turnovers", "fg_attempted")]
    return out.select("game_id", "side", "player_name", "minutes", *numbers, places("efg_pct", 6).alias("efg_pct"), places("ts_pct", 6).alias("ts_pct"))


@query("""
WITH sided AS (SELECT b.game_id, player_name, points, dense_rank() OVER (PARTITION BY b.game_id ORDER BY CASE WHEN b.team_id = home_team_id THEN 0 ELSE 1 END) AS k FROM boxscores b JOIN games g ON g.id = b.game_id)
SELECT game_id, CASE k WHEN 1 THEN 'home' ELSE 'away' END AS side, player_name, points::DOUBLE AS points FROM sided""")
def boxes_by_order(t: Tables) -> DataFrame:
    """Where no table names its side the first is the home team's, be it the only one."""
    out = html_tables.box_stats(html_tables.box_scores(_landed_boxes(t, named=False), "game_id"))
    return out.select("game_id", "side", "player_name", F.col("points").cast("double").alias("points"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k, coalesce(nullif(props::JSON ->> '$.missing', ''), nullif(event_type, ''), 'none') AS kind FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), S.first_value(F.get_json_object("props", "$.missing"), F.col("event_type"), F.lit("none")).alias("kind"))


@query("""
SELECT g.team_id, g.game_date::VARCHAR AS date, o.name AS opponent, is_home, own_score::DOUBLE AS points, opp_score::DOUBLE AS opp_points, CASE WHEN game_id % 2 = 0 THEN 'copa-del-rey' ELSE 'acb' END AS league FROM team_games g JOIN teams o ON o.id = g.opponent_id""")
def service_games(t: Tables) -> DataFrame:
    """Every team's games as the league's service would send them, documents for each team and season, and parsed."""
    name = lambda side: t.teams.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    rows = team_games(t.games).join(name("team"), "team_id").join(name("opponent"), "opponent_id")
    pick = lambda a, b: F.when(F.col("is_home"), F.col(a)).otherwise(F.col(b))
    item = F.struct(
        F.col("game_date").cast("string").alias("fecha"),
        F.struct(pick("team_name", "opponent_name").alias("nombre")).alias("local"),
        pick("opponent_name", "team_name").alias("awayTeam"),
        pick("own_score", "opp_score").alias("homeScore"),
        pick("opp_score", "own_score").alias("visitanteScore"),
        F.when(F.col("game_id") % 2 == 0, "Copa del Rey").otherwise("Liga Endesa").alias("competition"),
    )
    landed = pages.document(rows, ["team_id", "team_name", "season"], "game_id", item)
    return json_games.service_games(landed, F.col("team_name")).drop("team_name", "season", "page").withColumns({c: F.col(c).cast("double") for c in ("points", "opp_points")})


@query("SELECT DISTINCT season, unnest(range(make_date(season, 10, 1), make_date(season + 1, 7, 1), INTERVAL 1 DAY))::DATE::VARCHAR AS day FROM (SELECT DISTINCT season FROM games)")
def fetch_days(t: Tables) -> DataFrame:
    """The days on which a page is fetched, of every season that there is."""
    first, last = S.season_range(F.col("season"))
    return t.games.select("season").distinct().select("season", F.explode(F.transform(F.sequence(first, last), lambda d: d.cast("string"))).alias("day"))


_FIXED = "CASE WHEN {0} IS NULL THEN '-' ELSE printf('%.1f', round_even({0}, 1)) END"
_LINE = " || ".join(["rpad(player_name, greatest(24, length(player_name))::INTEGER, ' ')", "lpad(games::VARCHAR, 4, ' ')"] + [f"lpad({_FIXED.format(x)}, 8, ' ')" for x in ("avg_minutes", "avg_pts", "avg_pts_per36", "(avg_efg_pct * 100)", "(avg_ts_pct * 100)")])


@query(f"WITH {FORM5} SELECT team_id, row_number() OVER (PARTITION BY team_id ORDER BY avg_pts DESC, player_name)::INTEGER AS place, {_LINE} AS line FROM form")
def report_lines(t: Tables) -> DataFrame:
    return reports.form_lines(players.recent_form(t.games, t.boxscores, 5))


@query("""
SELECT '{"league":"' || league || '","losses":' || l || ',"team_id":' || team_id || ',"wins":' || w || '}' AS json FROM (
  SELECT team_id, league, count(*) FILTER (own_score > opp_score) AS w, count(*) FILTER (own_score < opp_score) AS l FROM team_games WHERE own_score IS NOT NULL GROUP BY ALL)""")
def canonical_json(t: Tables) -> DataFrame:
    rows = team_games(t.games).where("own_score is not null").groupBy("team_id", "league").agg(F.count_if(F.col("own_score") > F.col("opp_score")).alias("wins"), F.count_if(F.col("own_score") < F.col("opp_score")).alias("losses"))
    return reports.canonical(rows)


@query("SELECT * FROM team_game_stats WHERE game_id % 2 = 1")
def ratings_backfill(t: Tables) -> DataFrame:
    """Ratings of the games that have none yet, half of them being there."""
    return teams.game_ratings(t.games, t.boxscores, t.team_game_stats.where("game_id % 2 = 0"))


@query("SELECT game_id, player_name, round(efg_pct, 6) AS efg_pct, round(ts_pct, 6) AS ts_pct FROM boxscores")
def advanced_backfill(t: Tables) -> DataFrame:
    gaps = t.boxscores.withColumns({c: F.when(F.col("game_id") % 3 != 0, F.col(c)) for c in ("efg_pct", "ts_pct")})
    return teams.fill_advanced(gaps).select("game_id", "player_name", places("efg_pct", 6).alias("efg_pct"), places("ts_pct", 6).alias("ts_pct"))


@query("""
WITH fresh AS (
  SELECT game_id AS ord, g.date, CASE WHEN is_home THEN team_id ELSE opponent_id END AS home_team_id, CASE WHEN is_home THEN opponent_id ELSE team_id END AS away_team_id,
    CASE WHEN is_home THEN own_score ELSE opp_score END AS home_score, CASE WHEN is_home THEN opp_score ELSE own_score END AS away_score, boxscore_url, season, game_date FROM team_games g)
SELECT min(ord) FILTER (ord % 2 = 0)::DOUBLE AS id, date, home_team_id, away_team_id, (arg_max(home_score, ord) FILTER (home_score IS NOT NULL))::DOUBLE AS home_score, (arg_max(away_score, ord) FILTER (away_score IS NOT NULL))::DOUBLE AS away_score,
  arg_max(boxscore_url, ord) FILTER (boxscore_url IS NOT NULL) AS boxscore_url, arg_max(season, ord) AS season, (arg_min(game_date, ord) FILTER (ord % 2 = 0))::VARCHAR AS game_date, CASE WHEN bool_or(ord % 2 = 0) THEN 'updated' ELSE 'inserted' END AS change, true AS id_fits FROM fresh GROUP BY date, home_team_id, away_team_id""")
def persisted_schedule(t: Tables) -> DataFrame:
    """Every team's calendar as a source reports it, stored over the half of it that is there already."""
    rival = t.teams.select(F.col("id").alias("opponent_id"), F.col("name").alias("opponent"), F.col("slug").alias("opponent_slug"))
    reported = team_games(t.games).join(rival, "opponent_id")
    fused = reported.select("team_id", F.col("game_id").alias("src_ord"), "date", "opponent", "opponent_slug", "is_home", F.col("own_score").alias("points"), F.col("opp_score").alias("opp_points"), "boxscore_url", F.lit(None).cast("string").alias("notes"), "league", "season")
    one = F.row_number().over(W.partitionBy("date", "home_team_id", "away_team_id").orderBy("id"))
    there = t.games.where("id % 2 = 0").withColumn("r", one).where("r = 1").drop("r")
    there = there.withColumns({"home_score": F.lit(None).cast("int"), "away_score": F.lit(None).cast("int"), "boxscore_url": F.lit(None).cast("string")})
    games, _ = ingest.persist_schedule(there, t.teams, fused)
    numbers = [F.col(c).cast("double").alias(c) for c in ("home_score", "away_score")]
    return _ids(games, there).select("id", "date", "home_team_id", "away_team_id", *numbers, "boxscore_url", "season", F.col("game_date").cast("string").alias("game_date"), "change", "id_fits")


@query("SELECT id, slug, name, NULL::VARCHAR AS league, id * 2 AS extra FROM teams")
def migrated_teams(t: Tables) -> DataFrame:
    """A table from before a column came in, and with one of its own."""
    return schemas.migrate(t.teams.select(F.col("id").cast("int").alias("id"), "name", "slug", (F.col("id") * 2).alias("extra")), "teams")


@query("SELECT event_id, abs(a - b) <= 0.11 OR abs(a - b) <= 0.005::DOUBLE * greatest(abs(a), abs(b)) AS agree FROM (SELECT event_id, value AS a, value + (event_id % 7)::DOUBLE * 0.1::DOUBLE + 0.05::DOUBLE AS b FROM events)")
def close_values(t: Tables) -> DataFrame:
    near = F.col("value") + (F.col("event_id") % 7).cast("double") * F.lit(0.1) + F.lit(0.05)
    return t.raw("events").select("event_id", S.close(F.col("value"), near).alias("agree"))


@query(r"""SELECT page_id, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS href FROM pages WHERE contains(html, '<a href="')""")
def page_links(t: Tables) -> DataFrame:
    """The link found by its text: here the text of each page's first link."""
    pages = t.raw("pages").where(F.contains("html", F.lit('<a href="'))).withColumn("label", F.regexp_extract("html", r'(?s)<a href="[^"]*">(.*?)</a>', 1))
    return pages.select("page_id", html_tables.link_to("html", F.col("label")).alias("href"))
