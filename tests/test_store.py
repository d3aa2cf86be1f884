"""Stored tables: touched buckets, repeated keys, writers that race, versions that are kept."""

import datetime
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from courtside.operators import jobs, store, upsert

KIND = "id long, game_id long, team_id long, player_name string, minutes string, points int"
NEW = "game_id long, team_id long, player_name string, points int, ord int"


@pytest.fixture
def boxes(spark, tmp_path):
    path = f"file://{tmp_path}/boxscores"
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 50).alias("game_id"), (F.col("id") % 2 + 1).alias("team_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("player_name"), F.lit("10:00").alias("minutes"), F.lit(5).alias("points"))
    assert store.create(rows, path, ["game_id"], buckets=16) == 1
    return path


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path.removeprefix("file://")).rglob("*.parquet")}


def rows(df):
    return sorted(tuple(r) for r in df.select("game_id", "team_id", "player_name", "minutes", "points").collect())


def test_a_delivery_writes_its_own_buckets_only(spark, boxes):
    before, m = files(boxes), store.manifest(spark, boxes)
    new = spark.createDataFrame([(7, 2, "p7", 9, 1), (7, 1, "new", 3, 2)], NEW)
    assert store.merge(spark, boxes, new, upsert.rules("boxscores")) == 2
    after = store.manifest(spark, boxes)
    moved = [b for b in m["folders"] if m["folders"][b] != after["folders"][b]]
    assert len(moved) == 1 and set(m["folders"]) == set(after["folders"])
    assert {p: t for p, t in files(boxes).items() if p in before} == before  # nothing written over
    assert all(f"/{after['folders'][moved[0]]}/" in str(p) for p in set(files(boxes)) - set(before))
    got = rows(store.read(spark, boxes))
    assert len(got) == 201 and (7, 2, "p7", "10:00", 9) in got and (7, 1, "new", None, 3) in got
    assert rows(store.read(spark, boxes, 1)) == rows(spark.range(200).select((F.col("id") % 50).alias("game_id"), (F.col("id") % 2 + 1).alias("team_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("player_name"), F.lit("10:00").alias("minutes"), F.lit(5).alias("points")))
    diff = {(r.player_name, r.sign, r.points) for r in store.changes(spark, boxes, 1).collect()}
    assert diff == {("p7", -1, 5), ("p7", 1, 9), ("new", 1, 3)}


def test_ids_stay_and_new_ones_are_unique(spark, boxes):
    for k in range(2):
        new = spark.range(300).select((F.col("id") % 60).alias("game_id"), F.lit(3).cast("long").alias("team_id"), F.concat(F.lit(f"n{k}-"), F.col("id").cast("string")).alias("player_name"), F.lit(1).alias("points"))
        store.merge(spark, boxes, new, upsert.rules("boxscores"))
    ids = {r.player_name: r.id for r in store.read(spark, boxes).collect()}
    assert len(set(ids.values())) == 800 and all(ids[f"p{i}"] == i for i in range(200)) and min(i for n, i in ids.items() if n[0] == "n") > 199


def test_repeated_keys_in_one_delivery(spark, boxes):
    """Folded in their order, as one by one; without an order refused."""
    new = spark.createDataFrame([(7, 2, "p7", 9, 1), (7, 2, "p7", None, 2), (70, 1, "Ana", 1, 3), (70, 1, "Ana", 2, 4), (70, 1, "Bea", 3, 5), (70, 1, "Bea", None, 6)], NEW)
    store.merge(spark, boxes, new, upsert.rules("boxscores"), order="ord")
    got = {(r.game_id, r.player_name): r.points for r in store.read(spark, boxes).where("game_id in (7, 70)").collect()}
    assert (got[7, "p7"], got[70, "Ana"], got[70, "Bea"]) == (9, 2, 3) and store.read(spark, boxes).count() == 202
    with pytest.raises(Exception, match="need an order"):
        store.merge(spark, boxes, new, upsert.rules("boxscores"))
    assert store.versions(spark, boxes) == [1, 2]  # a delivery that fails leaves no version


@pytest.mark.parametrize("game", [7, 8])
def test_two_writers(spark, boxes, game):
    """Both start from version 1; the second finds version 2 taken, and nothing is lost, in one bucket or in two."""
    both, attempts = threading.Barrier(2), []

    def write(own, name):
        def wait(attempt):
            attempts.append((name, attempt))
            if attempt == 0:
                both.wait(60)

        store.merge(spark, boxes, spark.createDataFrame([(own, 9, name, 1, 1), (own, own % 2 + 1, f"p{own}", 50 + own, 2)], NEW), upsert.rules("boxscores"), before_commit=wait)

    threads = [threading.Thread(target=write, args=x) for x in ((7, "Ana"), (game, "Bea"))]
    [t.start() for t in threads]
    [t.join(300) for t in threads]
    assert store.versions(spark, boxes) == [1, 2, 3] and len(attempts) == 3
    got = store.read(spark, boxes).collect()
    assert len(got) == 202 and {"Ana", "Bea"} <= {r.player_name for r in got} and len({r.id for r in got}) == 202


def test_snapshots_and_cleaning(spark, boxes):
    new = lambda k: spark.createDataFrame([(k, 9, f"x{k}", 1, 1)], NEW)
    store.merge(spark, boxes, new(1), upsert.rules("boxscores"))
    before = files(boxes)
    assert store.snapshot(spark, boxes, "monday") == 2 and files(boxes) == before  # no data is copied
    with pytest.raises(store.Conflict):
        store.snapshot(spark, boxes, "monday")
    for k in (1, 2, 3):
        store.merge(spark, boxes, new(k), upsert.rules("boxscores"))
    assert store.clean(spark, boxes) > 0 and store.versions(spark, boxes) == [2, 4, 5]
    assert store.at(spark, boxes, "monday").count() == 201 and store.read(spark, boxes).count() == 203
    assert store.clean(spark, boxes) == 0
    assert store.snapshot(spark, f"{boxes}-none", "x") is None


def test_workers_claim_each_job_once(spark, tmp_path):
    path = f"file://{tmp_path}/jobs"
    at = lambda k: datetime.datetime(2026, 1, 1, 0, k)
    rows = [(k, k, 5, "queued" if k != 2 else "done", None, at(9 - k), None, None) for k in range(5)]
    store.create(spark.createDataFrame(rows, "id long, team_id long, last_n int, status string, error string, created_at timestamp, started_at timestamp, finished_at timestamp"), path, ["id"], buckets=1)
    got = []

    def work():
        while (job := jobs.claim_next(spark, path, at(30))) is not None:
            got.append(job["id"])

    threads = [threading.Thread(target=work) for _ in range(3)]
    [t.start() for t in threads]
    [t.join(300) for t in threads]
    assert sorted(got) == [0, 1, 3, 4]
    table = store.read(spark, path).collect()
    assert {r.id: r.status for r in table} == {0: "running", 1: "running", 2: "done", 3: "running", 4: "running"}
    assert store.versions(spark, path) == [1, 2, 3, 4, 5] and all((r.started_at is None) == (r.id == 2) for r in table)
