"""Keyed state of the job queue and of the trailing load, over restarts and out-of-order input."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from courtside.operators import players, store
from courtside.streaming import capture, state

T0 = datetime.datetime(2026, 1, 1)


@pytest.fixture
def landed(spark, tmp_path):
    """A folder of landed files, and a run over what is there that starts from where the last one ended."""
    state.with_states(spark)

    class Landed:
        src, out, mark = (f"file://{tmp_path}/{x}" for x in ("src", "out", "mark"))

        def add(self, rows, schema):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self.src)

        def run(self, schema, shape):
            stream = shape(capture.landed(spark, self.src, schema))
            stream.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
            return spark.read.parquet(self.out)

    yield Landed()


def one_by_one(events, stuck):
    """Jobs in the order of time, with a stuck job failed before anything later."""
    held, out = {}, []
    for team, at, kind, id_, last_n, error in sorted(events, key=lambda e: (e[1], e[2], e[3])):
        if team in held and held[team][2] <= at:
            out.append((team, held[team][0], "failed", "stuck"))
            del held[team]
        if kind == "request" and team not in held and last_n and 1 <= last_n <= 15:
            held[team] = (id_, last_n, at + stuck)
            out.append((team, id_, "queued", None))
        elif kind == "result" and team in held and held[team][0] == id_:
            out.append((team, id_, "failed" if error else "done", error))
            del held[team]
    return sorted(out, key=str), held


def test_jobs_over_restarts(spark, landed):
    """Each file is a run of its own from the checkpoint, equal to one pass over all events."""
    rng = random.Random(6)
    events, n = [], 0
    for batch in range(4):
        now = []
        for _ in range(40):
            n += 1
            at = T0 + datetime.timedelta(minutes=10 * n)
            team = rng.randrange(5)
            if rng.random() < 0.6:
                now.append((team, at, "request", n, rng.choice([0, 1, 5, 15, 16, None]), None))
            else:
                held = one_by_one(events + now, datetime.timedelta(days=400))[1]
                now.append((team, at, "result", held[team][0] if team in held and rng.random() < 0.8 else 0, None, rng.choice([None, "boom"])))
        events += now
        rng.shuffle(now)
        landed.add(now, state.EVENT)
        got = landed.run(state.EVENT, lambda s: state.job_moves(s, stuck="400 days"))
    want, _ = one_by_one(events, datetime.timedelta(days=400))
    assert sorted(((r.team_id, r.id, r.status, r.error) for r in got.collect()), key=str) == want and len(want) > 20


def test_stuck_jobs_fail_by_a_timer(spark, landed):
    h = lambda k: T0 + datetime.timedelta(hours=k)
    shape = lambda s: state.job_moves(s, stuck="6 hours", late="1 hour")
    landed.add([(1, h(0), "request", 1, 5, None), (2, h(0), "request", 2, 5, None), (2, h(1), "result", 2, None, None)], state.EVENT)
    landed.run(state.EVENT, shape)
    landed.add([(3, h(8), "request", 3, 5, None)], state.EVENT)  # the stream's time passes 6 hours
    landed.run(state.EVENT, shape)
    landed.add([(1, h(9), "request", 4, 5, None), (1, h(9), "result", 1, None, None)], state.EVENT)
    got = landed.run(state.EVENT, shape)
    assert {(r.id, r.status, r.error) for r in got.collect() if r.team_id < 3} == {(1, "queued", None), (1, "failed", "stuck"), (2, "queued", None), (2, "done", None), (4, "queued", None)}


def test_capture_of_many_batches(spark, tmp_path):
    """Files stay bounded by buckets and runs, whatever the number of batches; batches come again without effect."""
    table = f"file://{tmp_path}/table"
    add = capture.append_new(table, ["k"], "ord", buckets=2, runs=4)
    rng = random.Random(1)
    rows, most = {}, 0
    for batch in range(30):
        new = [(rng.choice([rng.randrange(90), None]), batch * 100 + i) for i in range(8)]
        for k, o in new:
            rows.setdefault(k, o)
        df = spark.createDataFrame(new, "k long, ord long").coalesce(1)
        for _ in range(1 + batch % 2):
            add(df, batch)
        most = max(most, sum(1 for _ in (tmp_path / "table").glob("run=*/bucket=*/*.parquet")))
    got = capture.captured(spark, table)
    assert {r.k: r.ord for r in got.collect()} == rows and got.count() == len(rows)
    m = store.manifest(spark, table)
    assert all(len(f) <= 4 for f in m["runs"].values()) and most <= 2 * (4 + 4 + 1) and m["batch"] == 29
    assert len(store.versions(spark, table)) == 2
    add(spark.createDataFrame([], "k long, ord long"), 30)
    assert capture.captured(spark, table).count() == len(rows)


def test_trailing_load_of_rows_out_of_order(spark, landed):
    rng = random.Random(3)
    schema = "ts timestamp, team_id long, player_name string, minutes string"
    rows = [(T0 + datetime.timedelta(days=rng.randrange(60), hours=rng.randrange(24)), rng.randrange(2), rng.choice("ab"), rng.choice(["10:30", "20:00", "", "7:20", None])) for _ in range(150)]
    shape = lambda s: state.trailing_load(s, 14, "90 days")
    for k in range(3):
        landed.add(rows[k::3], schema)
        assert landed.run(schema, shape).count() == 0 or k
    landed.add([(T0 + datetime.timedelta(days=400), 9, "late", "1:00")], schema)  # all days before are over
    got = landed.run(schema, shape)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "game_id long, " + schema)
    want = players.sliding_load(df.select(F.col("game_id").alias("id"), F.col("ts").cast("date").alias("game_date")), df, 14)
    key = lambda r: (r.team_id, r.player_name, r.game_date)
    assert {key(r): (round(r.load_minutes, 5), r.load_games) for r in got.collect()} == {key(r): (round(r.load_minutes, 5), r.load_games) for r in want.collect()}


def test_trailing_load_reads_and_writes_a_player_once_a_trigger():
    calls = []

    class Held:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.held = Held()

        def getValueState(self, *_):
            return self.held

        def registerTimer(self, ms):
            calls.append(ms)

    class Time:
        def getCurrentWatermarkInMs(self):
            return 0

    handle, load = Handle(), state._Load(14)
    load.init(handle)
    days = [9, 3, 3, 50]
    list(load.handleInputRows((1, "a"), iter([Row(day=d, billionths=d) for d in days]), Time()))
    assert calls == ["get", "update", 4 * state.DAY_MS]
    list(load.handleInputRows((1, "a"), iter([Row(day=9, billionths=1)]), Time()))
    assert calls[3:] == ["get", "update"]
    assert dict(zip(handle.held.value[0], handle.held.value[1])) == {9: 10, 3: 6, 50: 50}


def test_trailing_load_by_buckets_is_that_by_players(spark, landed):
    """Three runs from the checkpoint, days told in between, rows that come too late, and more players than buckets; a
    bucket's state is written once a trigger."""
    rng = random.Random(4)
    schema = "ts timestamp, team_id long, player_name string, minutes string"
    rows = [(T0 + datetime.timedelta(days=rng.randrange(40) + 20 * (n // 200), hours=rng.randrange(24)), rng.choice([0, 1, None]), rng.choice(["a", "b", "é", None]), rng.choice(["10:30", "20:00", "", "7:20", None])) for n in range(600)]
    runs = {}
    for kind, buckets in (("players", None), ("buckets", 3)):
        landed.out, landed.mark, landed.src = (f"{landed.src.rsplit('/', 1)[0]}/{kind}-{x}" for x in ("out", "mark", "src"))
        counts = []
        for k in range(3):
            landed.add(rows[200 * k : 200 * (k + 1)], schema)
            counts.append(landed.run(schema, lambda s, b=buckets: state.trailing_load(s, 14, "5 days", b)).count())
        landed.add([(T0 + datetime.timedelta(days=400), 9, "late", "1:00")], schema)
        got = landed.run(schema, lambda s, b=buckets: state.trailing_load(s, 14, "5 days", b))
        assert 0 < counts[0] < counts[1] < counts[2] < got.count()
        runs[kind] = (counts, got.dtypes, sorted(map(str, got.collect())))
    assert runs["players"] == runs["buckets"]


def test_trailing_load_by_buckets_makes_few_calls():
    """Two hundred players of a bucket are one read, one write and one timer."""
    calls = []

    class Held:
        def get(self):
            calls.append("get")

        def update(self, value):
            calls.append("update")

    class Handle:
        def getValueState(self, *_):
            return Held()

        def registerTimer(self, ms):
            calls.append(ms)

    class Time:
        def getCurrentWatermarkInMs(self):
            return 0

    loads = state._Loads(14)
    loads.init(Handle())
    df = pd.DataFrame({"bucket": 0, "team_id": range(200), "player_name": "a", "day": range(7, 207), "billionths": 1})
    assert list(loads.handleInputRows((0,), iter([df, df]), Time())) == []
    assert calls == ["get", "update", 8 * state.DAY_MS]
