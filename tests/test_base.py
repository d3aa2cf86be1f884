"""Numbering, means and pages where one key has most of the rows."""

import random
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.operators import calendar
from courtside.operators.base import mean, ranked
from courtside.plans import pages


def test_ranked_by_key_equals_one_window(spark):
    rng = random.Random(5)
    data = [(None if (k := rng.randrange(4)) == 3 else 0 if k else k, rng.choice([None, 1, 2, 3]), i) for i in range(400)]
    df = spark.createDataFrame(data, "k int, day int, id int")
    for descending in (False, True):
        order = [F.desc_nulls_last("day"), F.desc("id")] if descending else [F.asc_nulls_first("day"), F.asc("id")]
        got = ranked(df, "place", order[1:], F.struct("day", F.floor(F.col("id") / 50)), ("k",), descending)
        want = df.withColumn("place", F.row_number().over(W.partitionBy("k").orderBy(*order)))
        assert sorted(got.select("k", "day", "id", "place").collect(), key=str) == sorted(want.collect(), key=str)
    assert ranked(df.limit(0), "place", [F.asc("id")], F.col("day"), ("k",)).count() == 0


def test_calendar_with_undated_games(spark):
    games = spark.createDataFrame([(i, None, None if i % 3 else f"2024-01-{1 + i % 9:02}", 2023, "acb", 1, 2, 80 if i % 2 else None, 70 if i % 2 else None, None) for i in range(2, 40)], "id long, date string, game_date string, season int, league string, home_team_id long, away_team_id long, home_score int, away_score int, boxscore_url string")
    games = games.withColumn("game_date", F.col("game_date").cast("date"))
    for rows, order in ((calendar.calendar(games), [F.asc_nulls_first("game_date"), F.asc("game_id")]), (calendar.past(games), [F.desc_nulls_last("game_date"), F.desc("game_id")])):
        want = rows.withColumn("r", F.row_number().over(W.partitionBy("team_id").orderBy(*order)))
        assert want.count() and want.where("r <> place").count() == 0


def test_mean_is_exact_whatever_the_order(spark):
    rng = random.Random(9)
    values = [rng.uniform(-150, 150) for _ in range(999)] + [None, 1e5, -1e5, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    units = [int(Decimal(v * 1e9).quantize(Decimal(1), rounding="ROUND_HALF_UP")) for v in values if v is not None]
    want = float(Fraction(sum(units))) / len(units) / 1e9
    for parts in (1, 7):
        assert df.repartition(parts).agg(mean("v").alias("m")).first()["m"] == want
    assert df.where("v is null").agg(mean("v").alias("m")).first()["m"] is None


def test_pages_stay_short(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 50 == 1, 7).otherwise(8)).alias("k"), F.lit("x").alias("page_note"))
    out = pages.listed(df, ["k"], "id", F.concat(F.lit("<"), "id", F.lit(">")), most=100).select("k", "page", F.regexp_extract_all("trs", F.lit("<(\\d+)>"), 1).cast("array<int>").alias("ids")).collect()
    assert sorted(i for r in out for i in r.ids) == list(range(3000))
    assert all(r.ids == sorted(r.ids) for r in out)
    # pages are dealt by hash: a hundred rows each in the mean, never a key's all
    assert max(len(r.ids) for r in out) < 160 and {r.k for r in out} == {None, 7, 8}
