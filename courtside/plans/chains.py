"""Queries over what takes several steps: links, dumps, stored tables, moved sums, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from courtside.operators import entities, increments, store, teams, upsert
from courtside.operators.base import placed, places, rounded
from courtside.plans import analytics
from courtside.plans.analytics import registrar
from courtside.plans.domain import Tables
from courtside.plans.records import _MERGED, _more_teams
from courtside.sources import dumps, links
from courtside.streaming import capture, state
from courtside.written import Written

QUERIES, SQL, query = registrar()


def _link(href, text):
    return F.concat(F.lit('<a href="'), href, F.lit('">'), text, F.lit("</a>"))


@query("""
WITH RECURSIVE tree AS (
  SELECT 0::BIGINT AS k, 0 AS depth UNION ALL SELECT 2 * t.k + v.d, t.depth + 1 FROM tree t JOIN part p ON p.p_partkey = t.k AND t.k % 50 <> 13, (VALUES (1), (2)) v(d)
) SELECT 'https://p.example/' || k AS url, depth, k % 50 <> 13 AND k IN (SELECT p_partkey FROM part) AS landed FROM tree""")
def reached_pages(t: Tables) -> DataFrame:
    """Pages that link to two others and back to the one before, some of which nobody has landed."""
    k = F.col("p_partkey")
    to = lambda n: _link(F.concat(F.lit("/"), F.floor(n).cast("string")), F.lit("x"))
    pages = t.raw("part").where(k % 50 != 13).select(F.concat(F.lit("https://p.example/"), k.cast("string")).alias("url"), F.concat(to(2 * k + 1), to(2 * k + 2), to(F.greatest(k - 1, F.lit(0)) / 2)).alias("html"))
    return links.reached(pages, t.spark.createDataFrame([("https://p.example/0",)], "url string"))


@query("""
WITH p AS (SELECT s_suppkey AS id, s_name AS player_name, t.name AS team_name, t.id % 3 AS kind FROM supplier JOIN teams t ON t.id = s_suppkey % 25 WHERE s_suppkey % 9 <> 0)
SELECT p.player_name, p.team_name, g.date, nullif(b.minutes, '') AS minutes, b.points::DOUBLE AS points FROM p JOIN boxscores b ON b.player_name = p.player_name JOIN games g ON g.id = b.game_id""")
def player_logs_by_links(t: Tables) -> DataFrame:
    """Every player's log from the leagues' pages on: teams stand on one of two leagues' pages or on both, some players on no roster."""
    host = "https://logs.example"
    p = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("player_name"), (F.col("s_suppkey") % 25).alias("team_id")).join(t.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name")), "team_id")
    team_url = F.concat(F.lit("/team/"), F.col("team_id").cast("string"))
    teams = p.select("team_id", "team_name").distinct()
    on = F.array(*[F.when(F.col("team_id") % 3 != k, F.lit(n)) for n, k in (("euro", 0), ("acb", 1))])
    league = teams.select(F.explode(F.array_compact(on)).alias("league"), _link(team_url, F.upper("team_name")).alias("a")).groupBy("league").agg(F.array_join(F.sort_array(F.collect_list("a")), " ").alias("html"))
    roster = p.where("id % 9 <> 0").groupBy("team_id").agg(F.array_join(F.sort_array(F.collect_list(_link(F.concat(F.lit("/player/Summary/"), F.col("id").cast("string")), F.col("player_name")))), " ").alias("html"))
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>"))
    lines = t.boxscores.join(t.games.select(F.col("id").alias("game_id"), "date"), "game_id").join(p.select("id", "player_name"), "player_name")
    tr = F.concat(F.lit("<tr>"), cell("date"), F.lit("<td>x</td>"), cell("minutes"), cell("points"), F.lit("</tr>"))
    log = lines.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(tr)), "").alias("trs"))
    head = "<table><thead><tr><th>Date</th><th>Opponent</th><th>MIN</th><th>PTS</th></tr></thead>"
    url = lambda path, c: F.concat(F.lit(f"{host}/{path}"), F.col(c).cast("string"))
    pages = league.select(url("", "league").alias("url"), "html").union(roster.select(F.concat(url("team/", "team_id"), F.lit("/Rosters")), "html")).union(log.select(url("player/GameLogs/", "id"), F.concat(F.lit(head), "trs", F.lit("</table>"))))
    leagues = t.spark.createDataFrame([(1, f"{host}/euro"), (2, f"{host}/acb")], "rank int, league_url string")
    out = links.typed_logs(links.player_logs(pages, p, leagues))
    return out.select("player_name", "team_name", "date", "minutes", F.col("points").cast("double").alias("points"))


@query("""
WITH g AS (SELECT id, home_score, date, league, home_score + (id % 4) * 0.2::DOUBLE AS new_score FROM games)
SELECT id AS name, '$.score.home' AS path, 'different' AS change FROM g WHERE abs(new_score - home_score) > 0.11 AND abs(new_score - home_score) > 0.005::DOUBLE * home_score
UNION ALL SELECT id, '$.tags[1]', 'different' FROM g WHERE id % 9 = 0
UNION ALL SELECT id, '$.more[0].k', 'added' FROM g WHERE id % 7 = 0
UNION ALL SELECT id, '$.old', 'gone' FROM g WHERE id % 11 = 0""")
def dump_differences(t: Tables) -> DataFrame:
    """Two dumps of every game, the second with scores a little off, another tag, and paths that came and went."""
    k = F.col("id")
    tags = lambda league: F.array(F.col("date"), league).alias("tags")
    base = F.to_json(F.struct(F.struct(F.col("home_score").alias("home"), F.col("away_score").alias("away")).alias("score"), tags(F.col("league")), F.when(k % 11 == 0, 1).alias("old")))
    score = F.struct((F.col("home_score") + (k % 4) * F.lit(0.2)).alias("home"), F.col("away_score").alias("away"))
    now = F.to_json(F.struct(score.alias("score"), tags(F.when(k % 9 == 0, "other").otherwise(F.col("league"))), F.when(k % 7 == 0, F.array(F.struct(k.alias("k")))).alias("more")))
    one = lambda json: t.games.select(k.cast("string").alias("name"), json.alias("json"))
    return dumps.differences(one(now), one(base)).select(F.col("name").cast("long").alias("name"), "path", "change")


@query("SELECT 1")
def season_table_moved(t: Tables) -> DataFrame:
    """Season tables after a delivery that adds games and corrects scores, from their sums before and the changed games' shares."""
    k = F.col("id")
    before = t.games.where(k % 5 != 0).withColumn("home_score", F.when(k % 7 == 0, F.col("home_score") - 3).otherwise(F.col("home_score")))
    changed = lambda games: games.where((k % 5 == 0) | (k % 7 == 0))
    boxes, stats = t.boxscores, t.team_game_stats
    sums = increments.state(increments.shares(before, boxes, stats))
    moved = increments.moved(sums, increments.shares(changed(before), boxes, stats), increments.shares(changed(t.games), boxes, stats))
    return increments.season_table(moved)


SQL["season_table_moved"] = analytics.SQL["season_team_stats"]


@query(f"""
WITH {_MERGED}, to_team AS (SELECT id, canonical_id FROM merged),
rows AS (
  SELECT 'boxscores' AS table_name, game_id || ':' || player_name AS key, team_id + CASE WHEN game_id % 2 = 0 AND team_id % 5 = 0 THEN 100 ELSE 0 END AS team_id FROM boxscores
  UNION ALL SELECT 'players', id::VARCHAR, team_id + CASE WHEN id % 3 = 0 AND team_id % 5 = 0 THEN 100 ELSE 0 END FROM players
  UNION ALL SELECT 'team_game_stats', game_id || ':' || team_points, team_id + CASE WHEN game_id % 4 = 0 AND team_id % 5 = 0 THEN 100 ELSE 0 END FROM team_game_stats
  UNION ALL SELECT 'ingest_jobs', id::VARCHAR, team_id + CASE WHEN id % 2 = 1 AND team_id % 5 = 0 THEN 100 ELSE 0 END FROM ingest_jobs
  UNION ALL SELECT 'teams', slug, id FROM more)
SELECT table_name, key, coalesce(canonical_id, team_id) AS team_id FROM rows LEFT JOIN to_team ON id = team_id WHERE NOT (table_name = 'teams' AND canonical_id IS NOT NULL)""")
def merged_tables(t: Tables) -> DataFrame:
    """All tables after duplicate teams were merged: who played, who is listed, what was rated and asked for, and the teams left."""
    def pointed(df: DataFrame, twin) -> DataFrame:
        return df.withColumn("team_id", F.col("team_id") + F.when(twin & (F.col("team_id") % 5 == 0), 100).otherwise(0))

    game, k = F.col("game_id"), F.col("id")
    tables = {"boxscores": pointed(t.boxscores, game % 2 == 0), "players": pointed(t.players, k % 3 == 0), "team_game_stats": pointed(t.team_game_stats, game % 4 == 0), "ingest_jobs": pointed(t.ingest_jobs, k % 2 == 1), "teams": _more_teams(t)}
    out = entities.merge_duplicates(tables, entities.duplicates(_more_teams(t), t.teams))
    keys = {"boxscores": F.concat_ws(":", "game_id", "player_name"), "players": k.cast("string"), "team_game_stats": F.concat_ws(":", "game_id", "team_points"), "ingest_jobs": k.cast("string"), "teams": F.col("slug")}
    rows = [out[n].select(F.lit(n).alias("table_name"), key.alias("key"), F.col("id" if n == "teams" else "team_id").cast("long").alias("team_id")) for n, key in keys.items()]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.union(r)
    return whole


@query("""
WITH own AS (SELECT DISTINCT team_id, season::VARCHAR AS value, -season AS rank FROM team_games WHERE season IS NOT NULL), named AS (SELECT DISTINCT team_id, league AS value FROM team_games WHERE league <> '')
SELECT team_id, 'season' AS kind, value, row_number() OVER (PARTITION BY team_id ORDER BY rank)::INTEGER AS place FROM own
UNION ALL SELECT team_id, 'league', value, row_number() OVER (PARTITION BY team_id ORDER BY value)::INTEGER FROM named""")
def option_places(t: Tables) -> DataFrame:
    """Each team's seasons, newest first, and leagues by name, with their places in a list."""
    seasons = placed(teams.seasons(t.games), ["team_id"], F.desc("season")).select("team_id", F.lit("season").alias("kind"), F.col("season").cast("string").alias("value"), "place")
    leagues = placed(teams.leagues(t.games), ["team_id"], "league").select("team_id", F.lit("league").alias("kind"), F.col("league").alias("value"), "place")
    return seasons.union(leagues)


_STORED = """
WITH fresh AS (SELECT game_id, team_id, player_name, max(points) + 2 AS points, max(fg_attempted) AS fg_attempted FROM boxscores WHERE game_id % 10 = 3 AND points % 4 = 0 GROUP BY ALL),
gone AS (SELECT * FROM boxscores WHERE points % 8 <> 4)
SELECT {0} coalesce(b.game_id, f.game_id) AS game_id, coalesce(b.player_name, f.player_name) AS player_name, coalesce(b.team_id, f.team_id) AS team_id, b.minutes, coalesce(f.points, b.points) AS points,
  round((coalesce(b.fg_made, 0) + 0.5::DOUBLE * coalesce(b.fg3_made, 0)) / nullif(coalesce(f.fg_attempted, b.fg_attempted), 0), 6) AS efg_pct
FROM gone b FULL JOIN fresh f ON f.game_id = b.game_id AND f.player_name = b.player_name AND f.team_id = b.team_id"""


@query(_STORED.format(""))
def stored_boxscores(t: Tables) -> DataFrame:
    """A stored table after a delivery to some of its games that names each player twice."""
    path = f"{Written(t.spark, 'stored').root}/boxscores"
    store.create(t.boxscores.where("points % 8 <> 4"), path, ["game_id"], buckets=64)
    one = t.boxscores.where("game_id % 10 = 3 and points % 4 = 0").select("game_id", "team_id", "player_name", F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival"), (F.col("points") + F.col("arrival")).alias("points"), "fg_attempted")
    store.merge(t.spark, path, one, upsert.rules("boxscores"), order="arrival")
    return store.read(t.spark, path).select("game_id", "player_name", "team_id", "minutes", "points", places("efg_pct", 6).alias("efg_pct"))


@query("SELECT game_id, player_name, team_id, points, version FROM (SELECT * FROM boxscores), (VALUES (1), (2)) v(version) WHERE version = 1 AND points % 8 <> 4 OR version = 2 AND (points % 8 <> 4 OR game_id % 10 = 3)")
def stored_versions(t: Tables) -> DataFrame:
    """A table as it was kept before a delivery, and as it is after it and after cleaning."""
    path = f"{Written(t.spark, 'stored').root}/boxscores"
    own = t.boxscores.select("game_id", "team_id", "player_name", "points")
    store.create(own.where("points % 8 <> 4"), path, ["game_id"], buckets=64)
    store.snapshot(t.spark, path, "before")
    store.merge(t.spark, path, own.where("game_id % 10 = 3"), upsert.rules("boxscores"))
    store.clean(t.spark, path, last=1)
    cols = ["game_id", "player_name", "team_id", "points"]
    return store.at(t.spark, path, "before").select(*cols, F.lit(1).alias("version")).union(store.read(t.spark, path).select(*cols, F.lit(2)))


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def captured_events(t: Tables) -> DataFrame:
    """A captured stream of events: of each user and type the first, whatever batch it came in."""
    root = Written(t.spark, "captured").root
    rows = t.raw("events").select("event_type", "user_id", "event_id")
    rows.repartitionByRange(6, "event_id").sortWithinPartitions("event_id").write.parquet(f"{root}/landed")
    add = capture.append_new(f"{root}/table", ["event_type", "user_id"], "event_id", buckets=8, runs=3)
    # files arrive in the order of their ranges, a batch each
    names = sorted(n for n in store.names(t.spark, f"{root}/landed") if n.startswith("part-"))
    for batch, name in enumerate(names):
        add(t.spark.read.parquet(f"{root}/landed/{name}"), batch)
    return capture.captured(t.spark, f"{root}/table")


@query("SELECT 1")
def streamed_load(t: Tables) -> DataFrame:
    """The trailing load of every player by keyed state, from box scores that are landed in no order of days."""
    state.with_states(t.spark)
    root = Written(t.spark, "streamed").root
    rows = t.boxscores.join(t.games.select(F.col("id").alias("game_id"), F.col("game_date").cast("timestamp").alias("ts")), "game_id")
    last = t.spark.createDataFrame([("", "10:00")], "player_name string, minutes string").select(F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("team_id"), "player_name", "minutes")
    schema = "ts timestamp, team_id long, player_name string, minutes string"
    landed = Observation()
    rows.select("ts", "team_id", "player_name", "minutes").union(last).observe(landed, F.count(F.lit(1)).alias("rows")).write.parquet(f"{root}/landed")
    buckets = max(256, landed.get["rows"] // 16_384)
    out = state.trailing_load(t.spark.readStream.schema(schema).parquet(f"{root}/landed"), 14, "36500 days", buckets)
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/mark").trigger(availableNow=True).start().awaitTermination()
    return rounded(t.spark.read.schema(out.schema).parquet(f"{root}/out")).withColumn("game_date", F.col("game_date").cast("string"))


SQL["streamed_load"] = analytics.SQL["sliding_load"]


@query("""
WITH RECURSIVE asked AS (
  SELECT event_id AS id, user_id AS team_id, (event_id % 17)::INTEGER AS last_n, ts AS since, ts + to_hours((event_id % 48 + 1)::INTEGER) AS ends FROM events WHERE event_type IN ('view', 'logout') AND event_id % 17 BETWEEN 1 AND 15
), starts AS (SELECT team_id, since, min(id) AS id FROM asked GROUP BY ALL),
linked AS (SELECT a.*, s.id AS after FROM asked a ASOF LEFT JOIN starts s ON s.team_id = a.team_id AND a.ends < s.since),
jobs AS (
  SELECT * FROM linked WHERE id IN (SELECT arg_min(id, (since, id)) FROM asked GROUP BY team_id)
  UNION ALL SELECT l.* FROM jobs j JOIN linked l ON l.id = j.after
)
SELECT team_id, id, last_n, 'queued' AS status, NULL::VARCHAR AS error, epoch_us(since) AS micros FROM jobs
UNION ALL SELECT team_id, id, last_n, CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'done' END, CASE WHEN id % 3 = 0 THEN 'boom' END, epoch_us(ends) FROM jobs""")
def streamed_jobs(t: Tables) -> DataFrame:
    """Every job's way by keyed state: each user asks for a team, and each request's result comes hours later."""
    state.with_states(t.spark)
    root = Written(t.spark, "jobs").root
    k = F.col("event_id")
    asked = t.raw("events").where(F.col("event_type").isin("view", "logout")).select(k.alias("id"), F.col("user_id").alias("team_id"), (k % 17).cast("int").alias("last_n"), F.col("ts").cast("timestamp").alias("created_at"))
    hours = F.make_dt_interval(hours=(F.col("id") % 48 + 1).cast("int"))
    ended = asked.select("id", "team_id", F.when(F.col("id") % 3 == 0, "boom").alias("error"), (F.col("created_at") + hours).alias("finished_at"))
    state.events(asked, ended).write.parquet(f"{root}/landed")
    out = state.job_moves(t.spark.readStream.schema(state.EVENT).parquet(f"{root}/landed"), "36500 days")
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/mark").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{root}/out").select("team_id", "id", "last_n", "status", "error", F.unix_micros("at").alias("micros"))
