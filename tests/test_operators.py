"""Operators on small fixtures; the driver's tables are checked against SQL in test_oracle.py."""

import datetime

import pytest
from pyspark.sql import functions as F

from courtside import schemas
from courtside.operators import calendar, entities, fusion, ingest, jobs, matchups, players, quality, teams, upsert
from courtside.plans import domain

D = datetime.date


@pytest.fixture
def games(spark):
    rows = [(1, "Sun, Nov 23, 2025", D(2025, 11, 23), 2025, "acb", 1, 2, 88, 80, "u1"), (2, "Sun, Feb 8, 2026", D(2026, 2, 8), 2025, "euroleague", 2, 1, 70, 70, "u2"), (3, None, None, None, "acb", 1, 2, None, None, None), (4, "Wed, Aug 12, 2026", D(2026, 8, 12), 2026, "acb", 1, 3, None, None, "u4")]
    return spark.createDataFrame(rows, "id long, date string, game_date date, season int, league string, home_team_id long, away_team_id long, home_score int, away_score int, boxscore_url string")


BOX = "game_id long, team_id long, player_name string, minutes string, points int, rebounds int, offensive_rebounds int, assists int, turnovers int, fg_made int, fg_attempted int, fg3_made int, fg3_attempted int, ft_made int, ft_attempted int, plus_minus double, efg_pct double, ts_pct double"


@pytest.fixture
def boxes(spark):
    rows = [(1, 1, "Ana", "30:00", 22, 3, 1, 4, 2, 8, 15, 4, 9, 2, 2, None, 0.667, 0.690), (1, 2, "Bea", "28:00", 12, 5, 0, 6, 3, 4, 10, 2, 5, 2, 2, None, 0.5, 0.551), (2, 1, "Ana", "", 5, 0, 0, 0, None, 0, 0, 0, 0, 0, 0, None, None, None)]
    return spark.createDataFrame(rows, BOX)


def test_calendar(games):
    assert [r.game_id for r in calendar.calendar(games, team_id=1).orderBy("place").collect()] == [3, 1, 2, 4]
    assert [(r.game_id, r.result, r.score) for r in calendar.past(games, team_id=1).orderBy("place").collect()] == [(2, "L", "70-70"), (1, "W", "88-80")]
    assert [r.game_id for r in calendar.upcoming(games, D(2026, 8, 12), team_id=1).orderBy("place").collect()] == [4, 3]
    assert [r.game_id for r in calendar.upcoming(games, D(2026, 8, 13), team_id=1).collect()] == [3]
    assert {r.game_id for r in calendar.in_window(games, D(2026, 2, 8), 77, team_id=1).collect()} == {1, 2}
    assert {r.game_id for r in calendar.in_window(games, D(2026, 2, 8), 76, team_id=1).collect()} == {2}
    assert {r.game_id for r in calendar.head_to_head(games, 1, 2).collect()} == {1, 2, 3}


def test_form_cuts_the_window_before_unplayed_rows_fall_away(games, boxes):
    assert players.recent_form(games, boxes, 1).where("player_name = 'Ana'").count() == 0
    row = players.recent_form(games, boxes, 2).where("player_name = 'Ana'").first()
    assert (row.games, row.avg_minutes, row.avg_pts, row.fg3a_rate) == (1, 30.0, 22.0, 9 / 15)
    assert players.recent_form(games, boxes, 5, league="euroleague").count() == 0


def test_streaks(spark):
    games = spark.createDataFrame([(i, 2025, "acb") for i in range(1, 8)], "id long, season int, league string")
    points = [10, 10, 10, 10, 10, 40, 99]
    rows = [(i + 1, 1, "Ana", "" if i == 6 else "20:00", p, None if i else 0.5) for i, p in enumerate(points)]
    box = spark.createDataFrame(rows, "game_id long, team_id long, player_name string, minutes string, points int, ts_pct double")
    row = players.streaks(games, box, 2025, recent_n=1).first()
    mean = 90 / 6
    std = (sum((p - mean) ** 2 for p in points[:6]) / 6) ** 0.5
    assert (row.games_season, row.recent_avg_pts, row.season_avg_pts, row.z_score_ts, row.streak) == (6, 40.0, 15.0, None, "hot")
    assert row.z_score_pts == pytest.approx((40 - mean) / std)
    assert players.streaks(games, box, 2025, min_season_games=7).count() == 0
    flat = players.streaks(games, box.withColumn("points", F.lit(3)), 2025).first()
    assert flat.z_score_pts is None and flat.streak == "neutral"


def test_ratings(games, boxes):
    rows = {r.team_id: r for r in teams.game_ratings(games, boxes).where("game_id = 1").collect()}
    own, rival = 15 - 1 + 2 + 0.8, 10 - 0 + 3 + 0.8
    assert rows[1].possessions == pytest.approx(own)
    assert rows[1].off_rating == pytest.approx(100 * 88 / own, abs=1e-4)
    assert rows[1].def_rating == pytest.approx(100 * 80 / rival, abs=1e-4)
    assert rows[2].net_rating == pytest.approx(100 * 80 / rival - 100 * 88 / own, abs=1e-4)
    assert rows[1].pace == pytest.approx((own + rival) / 2)
    done = teams.game_ratings(games, boxes)
    assert teams.game_ratings(games, boxes, done).count() == 0  # game 2 has no shot


def test_season_stats_and_current_season(games, boxes):
    stats = teams.game_ratings(games, boxes)
    row = teams.season_stats(games, boxes, stats, team_id=1).first()
    assert (row.games_played, row.wins, row.losses, row.points_per_game) == (2, 1, 0, 79.0)
    pooled = teams.season_stats(games, boxes, stats, team_id=1, pooled=True).first()
    assert pooled.pace == pooled.net_rating
    assert teams.current_season(games, stats, D(2026, 9, 1), team_id=1).first().season == 2025
    assert teams.current_season(games, stats.limit(0), D(2026, 9, 1), team_id=1).first().season == 2026


def test_projection(spark):
    s = spark.createDataFrame([(1, 70.0, 120.0, 110.0), (2, 68.0, 115.0, 112.0), (3, None, 1.0, 1.0)], "team_id long, avg_pace double, avg_off_rating double, avg_def_rating double")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "team_id long, opponent_id long")
    rows = {r.opponent_id: r for r in matchups.projection(s, pairs).collect()}
    assert (rows[2].possessions, rows[2].own_rating, rows[2].opp_rating) == (69.0, 116.0, 112.5)
    assert rows[3].possessions is None and rows[3].own_points is None and rows[3].own_rating is None


def test_narrative(games, boxes):
    stats = teams.game_ratings(games, boxes)
    texts = {r.team_id: r.narrative for r in matchups.narrative(games, boxes, stats, 2025).collect()}
    assert texts[1].startswith("Juega a ritmo bajo (15.3 posesiones estimadas por partido).")
    assert "Máximo anotador: Ana (22.0 puntos por partido)." in texts[1]
    assert "Ataque muy volcado al triple: 60% de los intentos son de 3." in texts[1]


def test_quality(games, boxes):
    found = {(r.game_id, r.team_id, r.kind): r.message for r in quality.warnings(games, boxes).collect()}
    assert set(found) == {(1, 1, "points"), (1, 2, "points"), (2, 1, "points"), (2, 1, "minutes")}
    assert found[2, 1, "minutes"] == "Partido 2 (Sun, Feb 8, 2026): jugadores sin minutos registrados en el box score visitante: Ana"


SOURCE = "source string, src_ord long, date string, opponent string, opponent_slug string, boxscore_url string, is_home boolean, points int, opp_points int, notes string, league string"


def test_fusion(spark):
    rows = [
        ("acb", 1, "d1", "Río Plata SAD", None, None, True, 80, 70, "x", "acb"),
        ("realgm", 2, "d1", "Rio Plata", "", None, True, None, None, None, None),
        ("bbr", 3, "d1", "Rio  Plata", "rio", "/b", True, None, None, "y", "acb"),
        ("bbr", 4, "d1", "Rio Plata", None, None, False, None, None, None, "acb"),
        ("cms", 5, "d2", "Rio Plata", None, None, True, None, None, None, "acb"),
        ("cms", 6, "d2", "Rio Plata", None, "/c", True, None, None, None, "acb"),
    ]
    games = spark.createDataFrame(rows, SOURCE)
    got = {(r.date, r.is_home): r for r in fusion.fuse(games).collect()}
    assert len(got) == 3
    first = got["d1", True]
    assert (first.source, first.opponent_slug, first.boxscore_url, first.points, first.notes, first.reports) == ("realgm", "rio", "/b", 80, "y", 3)
    assert got["d2", True].src_ord == 6
    assert fusion.fuse(games.limit(0)).count() == 0


def test_entities(spark):
    base = spark.createDataFrame([(1, "rio", "Río Plata", "acb"), (2, "sol", "Solar City", "acb"), (3, "x", "Abc", "acb")], "id long, slug string, name string, league string")
    asked = spark.createDataFrame([("Rio-Plata Basket", ""), ("Solar", None), ("Abc", ""), ("Other", "sol"), ("Nobody", "")], "opponent string, opponent_slug string")
    got = {r.opponent: (r.team_id, r.found_by) for r in entities.resolve(asked, base).collect()}
    assert got == {"Rio-Plata Basket": (1, "name"), "Solar": (2, "name"), "Abc": (None, "new"), "Other": (2, "slug"), "Nobody": (None, "new")}
    merged = entities.duplicates(base.union(spark.createDataFrame([(9, "rio-2", "Club Rio", "acb")], base.schema)), base)
    assert [tuple(r) for r in merged.collect()] == [(9, 1)]


def test_upsert(spark):
    old = spark.createDataFrame([(7, "d", 1, 2, "acb", 10, "n", D(2025, 1, 1))], "id long, date string, home_team_id long, away_team_id long, league string, home_score int, notes string, game_date date")
    new = spark.createDataFrame([("d", 1, 2, "", 0, None, 1), ("d", 1, 2, "cup", None, "m", 2), ("e", 1, 2, "acb", 0, None, 3)], "date string, home_team_id long, away_team_id long, league string, home_score int, notes string, ord int")
    rule = upsert.rules("games")
    out = upsert.upsert(old, new, rule, order="ord", zero_is_missing=True)
    assert out.columns == [*old.columns, "change"]
    kept = {r.date: (r.id, r.league, r.home_score, r.notes, r.game_date, r.change) for r in out.collect()}
    assert kept == {"d": (7, "cup", 10, "m", D(2025, 1, 1), "updated"), "e": (kept["e"][0], "acb", None, None, None, "inserted")} and kept["e"][0] > 7
    zero = {r.date: r.home_score for r in upsert.upsert(old, new, rule, order="ord").collect()}
    assert zero == {"d": 0, "e": 0}
    once = upsert.upsert(old, new, rule, order="ord").drop("change")
    assert sorted(upsert.upsert(once, new, rule, order="ord").drop("change").collect()) == sorted(once.collect())
    # a stored box score can still be joined by the id that its game keeps
    box = spark.createDataFrame([(7, 22)], "game_id long, points int")
    assert box.join(out.withColumnRenamed("id", "game_id"), "game_id").first().date == "d"


def test_upsert_keys(spark):
    """Two players of one name in one game are two rows; keys with nulls are found again; absent inputs give nulls."""
    kinds = "id long, game_id long, team_id long, player_name string, points int"
    old = spark.createDataFrame([(1, 5, 100, "Ana", 10), (2, 5, 200, "Ana", 20), (3, None, 100, "Bea", 1)], kinds)
    new = spark.createDataFrame([(5, 200, "Ana", 21), (None, 100, "Bea", 2), (6, 100, "Ana", 3), (6, 200, "Ana", 4)], "game_id long, team_id long, player_name string, points int")
    out = upsert.upsert(old, new, upsert.rules("boxscores"))
    rows = {(r.game_id, r.team_id, r.player_name): (r.points, r.change) for r in out.collect()}
    assert rows == {(5, 100, "Ana"): (10, "kept"), (5, 200, "Ana"): (21, "updated"), (None, 100, "Bea"): (2, "updated"), (6, 100, "Ana"): (3, "inserted"), (6, 200, "Ana"): (4, "inserted")}
    assert {r.efg_pct for r in out.collect()} == {None}
    again = upsert.upsert(out.drop("change", "efg_pct", "ts_pct"), new, upsert.rules("boxscores"))
    assert again.count() == 5 and {r.change for r in again.collect()} == {"kept", "updated"}


def test_minted_ids_are_unique(spark):
    old = spark.createDataFrame([(41, "a", "A", "x")], "id long, slug string, name string, league string")
    new = spark.range(500).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("slug"), F.lit("n").alias("name"), F.lit("x").alias("league"))
    ids = lambda df: {r.slug: r.id for r in upsert.upsert(old, df, upsert.rules("teams")).collect()}
    first = ids(new)
    assert len(set(first.values())) == 501 and first["a"] == 41 and 41 < min(i for s, i in first.items() if s != "a") and max(first.values()) < 41 + 8 * 4096
    assert ids(new.repartition(7)) == first  # the same whatever the order of the rows


def test_replace_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert upsert.replace_table(spark.range(3).toDF("id"), path) == 1
    assert upsert.replace_table(upsert.current(spark, path).where("id > 0"), path) == 2  # reads the version before
    assert upsert.current(spark, path).count() == 2 and upsert.versions(spark, path) == [1, 2]
    spark.range(9).write.parquet(f"{path}/v=3")
    (tmp_path / "t" / "v=3" / "_SUCCESS").unlink()  # a write that was cut short is no version
    assert upsert.current(spark, path).count() == 2
    assert upsert.replace_table(spark.range(5).toDF("id"), path) == 3 and upsert.versions(spark, path) == [2, 3]
    assert upsert.snapshot(path, "s1", spark) and spark.read.parquet(f"{path}.s1").count() == 5
    assert upsert.snapshot(f"{path}-none", "s1", spark) is None


def test_jobs(spark):
    t = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    q = spark.createDataFrame([(1, 1, 5, "done", None, t(1), None), (2, 1, 5, "queued", None, t(3), None), (3, 2, 5, "queued", None, t(2), None)], "id long, team_id long, last_n int, status string, error string, created_at timestamp, finished_at timestamp")
    assert jobs.claim(q).first().id == 3
    assert {r.team_id: r.id for r in jobs.latest(q).collect()} == {1: 2, 2: 3}
    asked = spark.createDataFrame([(10, 1, 5, t(9)), (11, 3, 5, t(9)), (12, 3, 5, t(10)), (13, 4, 16, t(9))], "id long, team_id long, last_n int, created_at timestamp")
    assert [r.id for r in jobs.enqueue(q, asked).collect()] == [11]
    done = spark.createDataFrame([(2, None, t(20)), (3, "boom", t(21))], "id long, error string, finished_at timestamp")
    assert {r.id: (r.status, r.error) for r in jobs.finish(q, done).collect()} == {1: ("done", None), 2: ("done", None), 3: ("failed", "boom")}


def test_schemas(spark):
    old = spark.createDataFrame([(1, "a", "b", "c", 7)], "id int, slug string, name string, extra string, z int")
    new = schemas.migrate(old, "teams")
    assert new.columns == ["id", "slug", "name", "league", "extra", "z"] and dict(new.dtypes)["id"] == "bigint"
    twice = spark.createDataFrame([("a",), ("a",), ("b",)], "slug string")
    assert [tuple(r) for r in schemas.duplicate_keys(twice, "teams").collect()] == [("a", 2)]


def test_plans(spark, tmp_path):
    t = domain.Tables(spark, "/root/testdata/sf0.001")
    plan = players.recent_form(t.games, t.boxscores)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython"))
    scan = calendar.past(t.games, team_id=3)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in scan  # columns are pruned


def test_persist_schedule(spark):
    base = spark.createDataFrame([(1, "sol", "Solar City", "acb"), (2, "rio", "Río Plata", "acb")], "id long, slug string, name string, league string")
    stored = spark.createDataFrame([], "date string, home_team_id long, away_team_id long, league string, season int, home_score int, away_score int, boxscore_url string, notes string")
    rows = [(1, "d1", "Rio Plata", "", False, 80, 70, "/b", None, "acb", 2025), (2, "d2", "Luna FC", None, True, None, None, None, None, "acb", 2025), (3, "d3", " ", None, True, 1, 2, None, None, "acb", 2025)]
    fused = spark.createDataFrame(rows, "src_ord long, date string, opponent string, opponent_slug string, is_home boolean, points int, opp_points int, boxscore_url string, notes string, league string, season int")
    games, every = ingest.persist_schedule(stored, base, fused, 1)
    new = every.where("slug = 'lunafc'").first()  # the normal name, as later rows without a slug ask for it
    assert new.id > 2 and new.league == "acb"
    got = {r.date: (r.home_team_id, r.away_team_id, r.home_score, r.away_score, r.change) for r in games.collect()}
    assert got == {"d1": (2, 1, 70, 80, "inserted"), "d2": (1, new.id, None, None, "inserted")} and new.name == "Luna FC"


def test_capture_run(spark, games, boxes, tmp_path):
    """Read, fuse, persist, fill, rate and the season table in one go; a second run changes nothing."""
    base = spark.createDataFrame([(1, "sol", "Solar City", "acb"), (2, "rio", "Río Plata", "acb")], "id long, slug string, name string, league string")
    sources = spark.createDataFrame(
        [("bbr", 1, "Sun, Nov 23, 2025", "Rio Plata", None, "u1", True, 88, 80, None, "acb"), ("acb", 2, "Sun, Nov 23, 2025", "Río Plata SAD", None, None, True, 88, 80, "n", "acb"), ("bbr", 3, "Mon, Dec 1, 2025", "Luna", None, None, False, 70, 90, None, "acb")], SOURCE
    )
    tables = {"teams": base, "games": games.where("id < 3").withColumn("notes", F.lit(None).cast("string")), "boxscores": boxes.withColumn("id", F.col("game_id") * 10 + F.col("team_id")).where("game_id = 1 and team_id = 2")}
    out = ingest.capture_run(f"file://{tmp_path}/t", tables, sources, boxes.withColumns({c: F.lit(None).cast("double") for c in ("efg_pct", "ts_pct")}), 1)
    luna = out["teams"].where("slug = 'luna'").first().id
    assert {(r.home_team_id, r.away_team_id, r.notes) for r in out["games"].collect()} == {(1, 2, "n"), (2, 1, None), (luna, 1, None)}
    assert {r.id for r in out["games"].where("id < 3").collect()} == {1, 2}
    assert {r.slug for r in out["teams"].collect()} == {"sol", "rio", "luna"}
    assert out["boxscores"].count() == 3 and out["boxscores"].where("player_name = 'Ana' and game_id = 1").first().efg_pct == pytest.approx((8 + 2) / 15)
    assert {(r.game_id, r.team_id) for r in out["team_game_stats"].collect()} == {(1, 1), (1, 2)}
    assert {(r.team_id, r.season, r.wins) for r in out["season_team_stats"].where("team_id = 1").collect()} == {(1, 2025, 1)}
    again = ingest.capture_run(f"file://{tmp_path}/t", {**tables, **{k: out[k] for k in ("teams", "games", "boxscores")}}, sources, boxes, 1)
    assert again["games"].count() == 3 and again["teams"].count() == 3 and again["boxscores"].count() == 3


def test_bounds_and_recency_by_date(games, boxes):
    for call in (lambda: players.recent_form(games, boxes, 21), lambda: players.recent_form(games, boxes, 0), lambda: calendar.in_window(games, D(2026, 1, 1), 91), lambda: matchups.difficulty(calendar.upcoming(games, D(2026, 1, 1)), boxes, boxes, 21)):
        with pytest.raises(ValueError):
            call()
    swapped = games.withColumn("game_date", F.when(F.col("id") == 1, F.lit(D(2027, 1, 1))).otherwise(F.col("game_date")))
    assert players.recent_form(swapped, boxes, 1, by_date=True).where("player_name = 'Ana'").first().avg_pts == 22.0
    assert players.recent_form(swapped, boxes, 1).where("player_name = 'Ana'").count() == 0


def test_means_of_many_rows_do_not_overflow(spark):
    from courtside.operators.base import mean

    big = spark.createDataFrame([(9e8,)] * 20, "x double")  # whole billionths beyond a long
    assert big.agg(mean("x").alias("m")).first().m == 9e8


def test_duplicates_without_all_pairs(spark):
    teams_ = spark.createDataFrame([(1, "ab", "x", "l"), (2, "rio", "Old", "l"), (3, "q", "Club Rio AB", "l"), (4, "longslug", "", "l"), (5, "z9", "The Long-Slug", "l")], "id long, slug string, name string, league string")
    found = entities.duplicates(teams_, teams_)
    assert {tuple(r) for r in found.collect()} == {(3, 1), (5, 4), (2, None)} - {(2, None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_load_is_added_in_one_order(spark, games):
    """The same games of a player give the same total, in whatever order their rows come."""
    clocks = ["20:06", "00:12", "33:18", "07:07", "11:11"]
    for turn in range(5):
        rows = [(k, 1, name, m) for name, order in (("up", clocks[turn:] + clocks[:turn]), ("down", clocks[::-1])) for k, m in enumerate(order)]
        boxes = spark.createDataFrame(rows, "game_id long, team_id long, player_name string, minutes string").coalesce(1)
        window = spark.range(5).select(F.col("id").alias("game_id"), F.lit(1).cast("long").alias("team_id"))
        assert len({r.total_minutes for r in players.load(boxes, window).collect()}) == 1, turn


def test_dealt_upsert_meets_and_stays_in_one_shuffle(spark):
    kind = "game_id long, team_id long, player_name string, minutes string, points int"
    old = spark.createDataFrame([(1, 1, "Ana", "10:00", 5), (1, 1, "Ana", "11:00", 6), (None, 1, "Bea", "12:00", 7), (2, 1, "Eva", "13:00", 8)], kind)
    new = spark.createDataFrame([(1, 1, "Ana", None, 9, 1), (1, 1, "Ana", "", 10, 2), (None, 1, "Bea", "01:00", None, 3), (3, 2, "Zoe", "02:00", 1, 4), (3, 2, "Zoe", None, 2, 5)], f"{kind}, ord int")
    deal = F.pmod(F.xxhash64("game_id"), F.lit(4)).cast("int")
    met = upsert.upsert(old, new, upsert.rules("boxscores"), order="ord", deal=deal)
    plain = upsert.upsert(old, new, upsert.rules("boxscores"), order="ord")
    want = {(1, 1, "Ana", "10:00", 10, "updated"), (1, 1, "Ana", "11:00", 10, "updated"), (None, 1, "Bea", "01:00", 7, "updated"), (2, 1, "Eva", "13:00", 8, "kept"), (3, 2, "Zoe", "02:00", 2, "inserted")}
    for df in (met, plain):
        got = [tuple(r) for r in df.select("game_id", "team_id", "player_name", "minutes", "points", "change").collect()]
        assert len(got) == 5 and set(got) == want
    spread = met.groupBy(upsert.DEALT).count()  # needs no other shuffle: those of the delivery's fold and of the deal
    assert spread._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
