"""Season tables moved by deliveries against those made anew."""

import random

import pytest
from pyspark.sql import functions as F

from courtside.operators import increments, store, teams, upsert

GAME = "id long, date string, league string, season int, home_team_id long, away_team_id long, home_score int, away_score int, boxscore_url string, notes string"
BOX = "id long, game_id long, team_id long, player_name string, minutes string, points int, rebounds int, offensive_rebounds int, assists int, turnovers int, fg_made int, fg_attempted int, fg3_made int, fg3_attempted int, ft_made int, ft_attempted int, plus_minus double, efg_pct double, ts_pct double"


def game(rng, day, pair):
    scored = rng.random() < 0.7
    return (f"d{day}", "acb", rng.choice([2024, 2025, None]), *pair, rng.randrange(60, 100) if scored else None, rng.randrange(60, 100) if scored else None, None, None)


def line(rng, game_id, team_id, name):
    n = lambda k: rng.choice([None, *range(k)])
    return (game_id, team_id, name, "10:00", n(30), n(9), n(4), n(9), n(5), n(5), n(15), n(3), n(6), n(4), n(6), None, None, None)


def same(got, want):
    return sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_moved_sums_of_fifty_random_deliveries(spark):
    """Fifty deliveries of fifty leagues of their own, before and after at once."""
    rng = random.Random(9)
    games, boxes = ([], []), ([], [])
    for league in range(50):
        for k in range(12):
            gid, pair = league * 100 + k, tuple(league * 10 + t for t in rng.sample(range(5), 2))
            was = (gid, *game(rng, k, pair))
            fate = rng.random()
            now = (gid, *game(rng, k, pair)) if fate < 0.4 else was
            games[0].extend([was] * (fate >= 0.2))  # some games are new
            games[1].append(now)
            for team in pair:
                for p in range(rng.randrange(3)):
                    row = (gid * 10 + p, *line(rng, gid, team, f"p{p}"))
                    boxes[0].extend([row] * (fate >= 0.2 and rng.random() < 0.8))
                    boxes[1].append((row[0], *line(rng, gid, team, f"p{p}")) if rng.random() < 0.3 else row)
    g = [increments.dated(spark.createDataFrame(x, GAME)) for x in games]
    b = [spark.createDataFrame(x, BOX) for x in boxes]
    s = [teams.game_ratings(*x) for x in zip(g, b)]
    full = [increments.shares(*x) for x in zip(g, b, s)]
    changed = g[0].exceptAll(g[1]).union(g[1].exceptAll(g[0])).select("id").union(b[0].exceptAll(b[1]).union(b[1].exceptAll(b[0])).select("game_id")).distinct()
    only = lambda k: increments.shares(g[k].join(changed, "id", "left_semi"), b[k], s[k])
    moved = increments.moved(increments.state(full[0]), only(0), only(1))
    assert 200 < changed.count() < 600
    want = teams.season_stats(g[1], b[1], s[1])
    assert same(increments.season_table(moved), want) and want.count() > 200


def test_stored_tables_follow(spark, tmp_path, monkeypatch):
    """Deliveries one after another: season table and ratings as made anew, other buckets untouched."""
    rng, folder = random.Random(4), f"file://{tmp_path}/t"
    base = spark.createDataFrame([(k, f"t{k}", f"Team {k}", "acb") for k in range(6)], "id long, slug string, name string, league string")
    first = [(k, *game(rng, k, tuple(rng.sample(range(6), 2)))) for k in range(40)]
    lines = [(g[0] * 10 + t, *line(rng, g[0], g[5 - 1 + t], "Ana")) for g in first for t in (0, 1)]
    increments.create(folder, {"teams": base, "games": spark.createDataFrame(first, GAME), "boxscores": spark.createDataFrame(lines, BOX)}, buckets=8)
    anew = lambda: _anew(spark, folder)
    assert same(increments.season_stats(spark, folder), anew()[0])
    for k in range(2):
        since = store.manifest(spark, f"{folder}/season_state")["note"]
        new = [first[k][1:3] + (2025, *first[k][4:6], 90 + k, 80, None, None), game(rng, 50 + k, (1, 2))]
        store.merge(spark, f"{folder}/games", spark.createDataFrame([(i, *r) for i, r in enumerate(new)], GAME.replace("id long", "src_ord long", 1)), upsert.rules("games"), order="src_ord")
        rows = spark.createDataFrame([(9, *line(rng, first[20 + k][0], first[20 + k][4], "Bea"))], BOX)
        store.merge(spark, f"{folder}/boxscores", rows.drop("id"), upsert.rules("boxscores"))
        if k:  # a run that was cut short after it had stored the ratings
            with pytest.raises(RuntimeError), monkeypatch.context() as patch:
                patch.setattr(increments, "_moved", lambda *a: (_ for _ in ()).throw(RuntimeError()))
                increments.follow(spark, folder)
        assert increments.follow(spark, folder)
        now = store.manifest(spark, f"{folder}/season_state")["note"]
        table, ratings = anew()
        assert same(increments.season_stats(spark, folder), table)
        stored = store.read(spark, f"{folder}/team_game_stats").drop("id")
        assert same(stored.join(ratings.select("game_id", "team_id"), ["game_id", "team_id"], "left_semi"), ratings.select(*stored.columns))
        a, b = (store.manifest(spark, f"{folder}/boxscores", v)["folders"] for v in (since["boxscores"], now["boxscores"]))
        assert sum(a[x] != b[x] for x in a) == 1
    assert not increments.follow(spark, folder)  # nothing new, nothing written
    assert store.manifest(spark, f"{folder}/season_state")["note"] == now


def _anew(spark, folder):
    games, boxes = increments.dated(store.read(spark, f"{folder}/games")), store.read(spark, f"{folder}/boxscores")
    ratings = teams.game_ratings(games, boxes)
    return teams.season_stats(games, boxes, store.read(spark, f"{folder}/team_game_stats")), ratings


SOURCE = "source string, src_ord long, date string, opponent string, opponent_slug string, boxscore_url string, is_home boolean, points int, opp_points int, notes string, league string"


def test_a_capture_into_stored_tables(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    base = spark.createDataFrame([(1, "sol", "Solar City", "acb"), (2, "rio", "Rio Plata", "acb")], "id long, slug string, name string, league string")
    rng = random.Random(2)
    games = [(10, "Sun, Nov 23, 2025", "acb", 2025, 1, 2, None, None, None, None)]
    boxes = [(k, *line(rng, 10, k, "Ana")) for k in (1, 2)]
    increments.create(folder, {"teams": base, "games": spark.createDataFrame(games, GAME), "boxscores": spark.createDataFrame(boxes, BOX)}, buckets=4)
    sources = spark.createDataFrame([("bbr", 1, "Sun, Nov 23, 2025", "Rio Plata SAD", "rpl", "u1", True, 88, 80, None, None), ("bbr", 2, "Mon, Dec 1, 2025", "Luna", None, None, False, 70, 90, None, None)], SOURCE)
    more = spark.createDataFrame([(*line(rng, 10, 1, "Bea"), 1), (10, 1, "Bea", "12:00", *[7] * 11, None, None, None, 2)], BOX.replace("id long, ", "", 1) + ", src_ord long")
    for _ in range(2):  # the second time changes nothing
        increments.deliver(folder, sources, more, 1)
        assert {(r.slug, r.name, r.league) for r in store.read(spark, f"{folder}/teams").collect()} == {("sol", "Solar City", "acb"), ("rpl", "Rio Plata", "acb"), ("luna", "Luna", "acb")}
        got = store.read(spark, f"{folder}/games")
        assert {(r.date[:3], r.home_score, r.league) for r in got.collect()} == {("Sun", 88, "acb"), ("Mon", 90, "acb")} and got.where("home_team_id = 1").first().id == 10
        assert store.read(spark, f"{folder}/boxscores").where("player_name = 'Bea'").first().points == 7
        table, ratings = _anew(spark, folder)
        assert same(increments.season_stats(spark, folder), table) and ratings.count() == 2
