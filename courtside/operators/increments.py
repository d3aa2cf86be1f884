"""Ratings and season tables that follow deliveries: what changed is taken out as it was and put in as it is.

A team's season is a row of sums. Games whose row or box scores a delivery touched give their shares before and after;
the difference of both moves the sums. Sums are whole numbers (means in billionths), so the moved table equals the one
made anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators import fusion, ingest, store, teams, upsert
from courtside.operators.base import places, team_games
from courtside.written import Written

METRICS = ["pace", "off_rating", "def_rating", "net_rating"]
COUNTS = ["games_played", "wins", "losses", "points", "rebounds", "assists", *[f"{m}_{x}" for m in METRICS for x in ("sum", "n")]]


def shares(games: DataFrame, boxscores: DataFrame, stats: DataFrame) -> DataFrame:
    """``team_id, season`` and what one played game adds to that season's sums, a row a side of a game."""
    played = team_games(games).where("own_score is not null and season is not null")
    sums = boxscores.groupBy("game_id", "team_id").agg(F.sum("rebounds").alias("reb"), F.sum("assists").alias("ast"))
    rows = played.join(sums, ["game_id", "team_id"], "left").join(stats.select("game_id", "team_id", *METRICS), ["game_id", "team_id"], "left")
    own, other, zero = F.col("own_score"), F.col("opp_score"), F.lit(0)
    one = {
        "games_played": F.lit(1),
        "wins": F.when(own > other, 1).otherwise(0),
        "losses": F.when(own < other, 1).otherwise(0),
        "points": own,
        "rebounds": F.coalesce("reb", zero),
        "assists": F.coalesce("ast", zero),
    }
    for m in METRICS:
        one |= {f"{m}_sum": F.coalesce(F.round(F.col(m) * 1e9), F.lit(0.0)), f"{m}_n": F.when(F.col(m).isNotNull(), 1).otherwise(0)}
    return rows.select("team_id", "season", *[v.cast("decimal(20,0)").alias(k) for k, v in one.items()])


def state(rows: DataFrame) -> DataFrame:
    """Shares summed: the state of every team's season."""
    return rows.groupBy("team_id", "season").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in COUNTS])


def moved(old: DataFrame, minus: DataFrame, plus: DataFrame) -> DataFrame:
    """``old`` without the shares ``minus`` and with ``plus``; seasons without a game left are no rows."""
    return _moved(old, minus, plus).where("games_played <> 0")


def _moved(old: DataFrame, minus: DataFrame, plus: DataFrame) -> DataFrame:
    less = minus.select("team_id", "season", *[(-F.col(c)).alias(c) for c in COUNTS])
    wide = lambda df: df.select("team_id", "season", *[F.col(c).cast("decimal(38,0)").alias(c) for c in COUNTS])
    return state(wide(old).union(wide(less)).union(wide(plus)))


def season_table(sums: DataFrame) -> DataFrame:
    """The season table of ``teams.season_stats``, from its state."""
    mean = lambda c, n: places(F.col(c).cast("double") / F.col(n).cast("double"), 1, half_even=True)
    rated = [places(F.col(f"{m}_sum").cast("double") / F.nullif(F.col(f"{m}_n").cast("double"), F.lit(0.0)) / F.lit(1e9), 1, half_even=True).alias(m) for m in METRICS]
    counts = [F.col(c).cast("long").alias(c) for c in ("games_played", "wins", "losses")]
    per_game = [mean(c, "games_played").alias(f"{c}_per_game") for c in ("points", "rebounds", "assists")]
    return sums.select("team_id", "season", *counts, *per_game, *rated)


# --- stored tables ------------------------------------------------------------------------------------

#: How each table is dealt to buckets: all rows of a game lie in one, as all of a team's season do.
BY = {"games": ["date", "home_team_id", "away_team_id"], "boxscores": ["game_id"], "team_game_stats": ["game_id"], "season_state": ["team_id", "season"]}
#: The tables that season sums follow from.
SOURCES = ["games", "boxscores", "team_game_stats"]
SEASON_STATE = upsert.Rules("season_team_stats", overwrite=COUNTS)


def dated(games: DataFrame) -> DataFrame:
    return games.withColumn("game_date", S.parse_date(F.col("date")))


def create(folder: str, tables: dict[str, DataFrame], buckets: int = 256) -> None:
    """Store ``tables`` (teams, games and boxscores, with ids) in ``folder``, and the ratings and season sums that follow."""
    spark = tables["games"].sparkSession
    for name in ("games", "boxscores"):
        store.create(tables[name], f"{folder}/{name}", BY[name], buckets)
    store.create(tables["teams"], f"{folder}/teams", ["slug"], 1)
    games, boxes = dated(store.read(spark, f"{folder}/games")), store.read(spark, f"{folder}/boxscores")
    rated = teams.game_ratings(games, boxes).withColumn("id", F.lit(None).cast("long"))
    numbered = upsert.minted(rated.drop("id"), ["game_id", "team_id"], F.lit(1))
    store.create(numbered, f"{folder}/team_game_stats", BY["team_game_stats"], buckets)
    sums = state(shares(games, boxes, store.read(spark, f"{folder}/team_game_stats")))
    store.create(sums, f"{folder}/season_state", BY["season_state"], buckets, note={n: 1 for n in SOURCES})


def _of(spark: SparkSession, path: str, version: int, games: DataFrame) -> DataFrame:
    """A version's rows of the games in ``games(game_id)``, read from their buckets."""
    m = store.manifest(spark, path, version)
    wanted = [r[0] for r in games.select(store.bucket_of(["game_id"], m["buckets"])).distinct().collect()]  # one a bucket at most
    return store.read(spark, path, version, wanted).join(games, "game_id", "left_semi")


def follow(spark: SparkSession, folder: str) -> bool:
    """Move ratings and season sums to the newest games and box scores; whether anything had changed.

    The versions that the sums stand for are noted in their own manifest, committed with them, so a run that was cut
    short is taken up from there and nothing counts twice. Read are the buckets of games and box scores that differ
    from those versions, and the box scores and ratings of the changed games from their buckets; games of which only box
    scores changed are looked up by id in the games table. A game that loses its shots keeps its ratings, as upserts
    delete nothing. Versions that are noted must not have been cleaned away.
    """
    path = {n: f"{folder}/{n}" for n in BY}
    since = store.manifest(spark, path["season_state"])["note"]
    until = {n: store.manifest(spark, path[n])["version"] for n in SOURCES}
    written = Written(spark, "follow")
    rows = written.save(store.changes(spark, path["games"], since["games"], until["games"]))
    lines = store.changes(spark, path["boxscores"], since["boxscores"], until["boxscores"]).select("game_id")
    own = rows.select(F.col("id").alias("game_id")).distinct()
    touched = written.save(own.union(lines).distinct())
    if not touched.head(1):
        return False
    others = touched.join(own, "game_id", "left_anti").select(F.col("game_id").alias("id"))
    same = written.save(store.read(spark, path["games"], until["games"]).join(others, "id", "left_semi"))
    before, after = (dated(rows.where(F.col("sign") == sign).drop("sign").unionByName(same)) for sign in (-1, 1))
    old_boxes, new_boxes = (_of(spark, path["boxscores"], v["boxscores"], touched) for v in (since, until))
    old_stats = _of(spark, path["team_game_stats"], since["team_game_stats"], touched)
    rated = store.merge(spark, path["team_game_stats"], teams.game_ratings(after, new_boxes), upsert.rules("team_game_stats"))
    new_stats = _of(spark, path["team_game_stats"], rated, touched)
    minus, plus = written.save(shares(before, old_boxes, old_stats)), written.save(shares(after, new_boxes, new_stats))
    seasons = minus.select("team_id", "season").union(plus.select("team_id", "season")).distinct()
    buckets = store.manifest(spark, path["season_state"])["buckets"]
    wanted = [r[0] for r in seasons.select(store.bucket_of(BY["season_state"], buckets)).distinct().collect()]  # one a bucket at most
    sums = store.read(spark, path["season_state"], buckets=wanted).join(seasons, ["team_id", "season"], "left_semi")
    # a season that is left without a game stays as a row of zeros
    store.merge(spark, path["season_state"], _moved(sums, minus, plus), SEASON_STATE, note=until | {"team_game_stats": rated})
    return True


def season_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The stored season table."""
    return season_table(store.read(spark, f"{folder}/season_state").where("games_played <> 0"))


def deliver(folder: str, source_games: DataFrame, box_rows: DataFrame, team_id: int, order: str = "src_ord") -> bool:
    """One capture of a team into stored tables: fuse what the sources report, settle its opponents, upsert games and
    box-score rows into their buckets, and move ratings and season sums. ``order`` is the arrival of box-score rows.
    """
    spark = source_games.sparkSession
    fused = fusion.fuse(source_games)
    rows = fused if "season" in fused.columns else fused.withColumn("season", S.season_of(S.parse_date(F.col("date"))))
    settled, every = ingest.settled_rows(rows, store.read(spark, f"{folder}/teams"), team_id)
    store.replace(spark, f"{folder}/teams", every)
    store.merge(spark, f"{folder}/games", settled, upsert.rules("games"), order="src_ord", zero_is_missing=True)
    store.merge(spark, f"{folder}/boxscores", box_rows, upsert.rules("boxscores"), order=order)
    return follow(spark, folder)
