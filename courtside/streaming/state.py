"""The job queue and the trailing load as keyed state: what is held is one job a team, and some days a player."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from courtside.functions import scalars as S

EVENT = "team_id long, at timestamp, kind string, id long, last_n int, error string"
MOVE = "team_id long, id long, last_n int, status string, error string, at timestamp"
LOAD = "team_id long, player_name string, game_date date, load_minutes double, load_games long"
#: A job that has no result after this long has failed.
STUCK = "6 hours"
DAY_MS = 86_400_000


def with_states(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


# --- jobs ---------------------------------------------------------------------------------------------


def events(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests ``(id, team_id, last_n, created_at)`` and results ``(id, team_id, error, finished_at)`` as one stream."""
    asked = requests.select("team_id", F.col("created_at").alias("at"), F.lit("request").alias("kind"), "id", "last_n", F.lit(None).cast("string").alias("error"))
    ended = results.select("team_id", F.col("finished_at").alias("at"), F.lit("result").alias("kind"), "id", F.lit(None).cast("int").alias("last_n"), "error")
    return asked.union(ended)


class _Jobs(StatefulProcessor):
    """One unfinished job of a team; a timer fails it if no result comes."""

    def __init__(self, stuck_ms: int):
        self.stuck_ms = stuck_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "id long, last_n int, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "kind", "id"], kind="stable")  # what one trigger brings of a team
        held = self.job.get() if self.job.exists() else None
        before, moves = held, []
        for r in batch.itertuples():
            if r.kind == "request":
                if held is None and r.last_n == r.last_n and r.last_n is not None and 1 <= r.last_n <= 15:
                    held = (int(r.id), int(r.last_n), int(r.at.value // 1_000_000) + self.stuck_ms)
                    moves.append((held[0], held[1], "queued", None, r.at))
            elif held is not None and r.id == held[0]:
                error = r.error if isinstance(r.error, str) else None
                moves.append((held[0], held[1], "failed" if error is not None else "done", error, r.at))
                held = None
        if before is not None and before != held:
            self.handle.deleteTimer(before[2])
        if held is None:
            self.job.clear()
        elif held != before:
            self.job.update(held)
            self.handle.registerTimer(held[2])
        yield self._moves(key, moves)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        moves = []
        if self.job.exists() and self.job.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            id_, last_n, due = self.job.get()
            moves.append((id_, last_n, "failed", "stuck", pd.Timestamp(due, unit="ms")))
            self.job.clear()
        yield self._moves(key, moves)

    @staticmethod
    def _moves(key, moves: list) -> pd.DataFrame:
        out = pd.DataFrame(moves, columns=["id", "last_n", "status", "error", "at"])
        out.insert(0, "team_id", key[0])
        return out.astype({"team_id": "int64", "id": "int64", "last_n": "int32", "at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def job_moves(stream: DataFrame, stuck: str = STUCK, late: str = "1 hour") -> DataFrame:
    """Every job's way: ``team_id, id, last_n, status, error, at``, from a stream of ``events``.

    A request becomes a job (queued) if its team has none unfinished and ``last_n`` is from 1 to 15, and is passed over
    otherwise; the job's result ends it (done, or failed where there is an error). A job without a result is failed as
    stuck once the stream's time is ``stuck`` past its request. Events count in the order of their times within a
    trigger; those later than the watermark still count, timers don't wait for them. What is held is the unfinished
    job of each team: no history is read.
    """
    ms = int(pd.Timedelta(stuck).total_seconds() * 1000)
    return stream.withWatermark("at", late).groupBy("team_id").transformWithStateInPandas(_Jobs(ms), MOVE, "append", "EventTime")


# --- trailing load ------------------------------------------------------------------------------------


class _Load(StatefulProcessor):
    """Minutes of a player by day; a day is told once no game of it, or before it, can come.

    A player's days are one value, read and written once for all rows of a trigger.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("days", "day array<int>, billionths array<long>, games array<long>, told array<boolean>")

    def _get(self) -> dict[int, tuple[int, int, bool]]:
        held = self.held.get()
        return {d: v for d, *v in zip(*held)} if held is not None else {}

    def _put(self, held: dict[int, tuple[int, int, bool]]) -> None:
        self.held.update((list(held), *map(list, zip(*held.values()))))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS  # days before this one are over
        new: dict[int, tuple[int, int]] = {}
        for r in rows:
            if r.day >= closed:  # else its day was told
                minutes, games = new.get(r.day, (0, 0))
                new[r.day] = minutes + r.billionths, games + 1
        if new:
            held = self._get()
            waiting = min((d for d in held if d >= closed), default=None)
            for d, (minutes, games) in new.items():
                old = held.get(d, (0, 0, False))
                held[d] = (old[0] + minutes, old[1] + games, False)
            self._put(held)
            if waiting is None or min(new) < waiting:  # else the timer is there
                self.handle.registerTimer((min(new) + 1) * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Tell all days that are over, forget those on which no later day looks back, and wait for the next one."""
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        held = self._get()
        out = []
        for day in sorted(d for d, v in held.items() if d < closed and not v[2]):
            span = [held[d] for d in range(day - self.days + 1, day + 1) if d in held]
            out.append(Row(team_id=key[0], player_name=key[1], game_date=datetime.date(1970, 1, 1) + datetime.timedelta(days=day), load_minutes=sum(v[0] for v in span) / 1e9, load_games=sum(v[1] for v in span)))
        kept = {d: (v[0], v[1], d < closed) for d, v in held.items() if d > closed - self.days}
        if kept:
            self._put(kept)
        else:
            self.held.clear()
        waiting = [d for d in kept if d >= closed]
        if waiting:
            self.handle.registerTimer((min(waiting) + 1) * DAY_MS)
        return iter(out)

    def close(self) -> None:
        pass


#: Days of a bucket's players, and what is told of one.
_DAYS = pa.schema([("team_id", pa.int64()), ("player_name", pa.string()), ("day", pa.int32()), ("billionths", pa.int64()), ("games", pa.int64()), ("told", pa.bool_())])
TOLD = "team_id long, player_name string, day int, billionths long, games long"


class _Loads(StatefulProcessor):
    """As ``_Load``, for the players of a bucket at once: their days are one value, and a timer waits for the next of them."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("days", "rows binary")

    def _get(self) -> pa.Table:
        held = self.held.get()
        return pa.ipc.open_stream(bytes(held[0])).read_all() if held is not None else _DAYS.empty_table()

    def _put(self, held: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _DAYS) as out:
            out.write_table(held)
        self.held.update((sink.getvalue().to_pybytes(),))

    @staticmethod
    def _summed(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by(_DAYS.names[:3]).aggregate([("billionths", "sum"), ("games", "sum"), ("told", "any")])
        return sums.rename_columns([c.removesuffix("_sum").removesuffix("_any") for c in sums.column_names]).select(_DAYS.names).cast(_DAYS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        parts = [_DAYS.empty_table()]
        for df in rows:
            df = df[df["day"] >= closed]  # else its day was told
            parts.append(self._summed([pa.Table.from_pandas(df.assign(games=1, told=False)[_DAYS.names], _DAYS, preserve_index=False)]))
        new = self._summed(parts)
        if new.num_rows:
            held = self._get()
            waiting, first = pc.min(held["day"].filter(pc.greater_equal(held["day"], closed))).as_py(), pc.min(new["day"]).as_py()
            self._put(self._summed([held, new]))
            if waiting is None or first < waiting:  # else the timer is there
                self.handle.registerTimer((first + 1) * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Days of a player lie one after another in a row of all players' days, so what a day looks back on is a stretch of it."""
        closed = timerValues.getCurrentWatermarkInMs() // DAY_MS
        held = self._get()
        day = held["day"].to_numpy().astype("int64")
        place = (held.select(_DAYS.names[:2]).to_pandas().groupby(_DAYS.names[:2], dropna=False, sort=False).ngroup().to_numpy().astype("int64") << 32) + day
        order = np.argsort(place)
        held, day, place = held.take(order), day[order], place[order]
        since = np.searchsorted(place, place - self.days + 1)
        sums = {c: np.concatenate([[0], np.cumsum(held[c].to_numpy())]) for c in ("billionths", "games")}
        tell = (day < closed) & ~held["told"].to_numpy()
        found = {c: (s[1:] - s[since])[tell] for c, s in sums.items()}
        kept = held.set_column(5, "told", pa.array(day < closed)).filter(pa.array(day > closed - self.days))
        if kept.num_rows:
            self._put(kept)
        else:
            self.held.clear()
        waiting = day[day >= closed]
        if len(waiting):
            self.handle.registerTimer((int(waiting.min()) + 1) * DAY_MS)
        if tell.any():
            yield held.select(_DAYS.names[:3]).filter(pa.array(tell)).to_pandas().assign(**found)

    def close(self) -> None:
        pass


def trailing_load(stream: DataFrame, days: int = 14, late: str = "30 days", buckets: int | None = None) -> DataFrame:
    """``players.sliding_load`` of a stream of rows ``(ts, team_id, player_name, minutes)``, in any order within ``late``.

    A row a player and day on which they played, once the watermark has passed the day, so it is final. Held are the days that
    a later one can still look back on; each row is held once, not once for each window that it falls in. Rows without
    minutes and rows of closed days are left out.

    With ``buckets`` what is held is dealt out by the hash of the player, and a bucket's players are one key: a history of
    many players then costs a few calls for each bucket, not for each player. A bucket's days should fit in a task; the number
    of buckets stays with the checkpoint.
    """
    rows = stream.withColumn("mins", S.parse_minutes(F.col("minutes"))).where("mins > 0 and ts is not null").withWatermark("ts", late)
    of_day = rows.select("team_id", "player_name", "ts", F.unix_date(F.to_date("ts")).alias("day"), F.rint(F.col("mins") * F.lit(1e9)).cast("long").alias("billionths"))
    if buckets is None:
        return of_day.groupBy("team_id", "player_name").transformWithState(_Load(days), LOAD, "append", "EventTime")
    dealt = of_day.withColumn("bucket", F.pmod(F.xxhash64("team_id", "player_name"), F.lit(buckets)))
    told = dealt.groupBy("bucket").transformWithStateInPandas(_Loads(days), TOLD, "append", "EventTime")
    return told.select("team_id", "player_name", F.date_from_unix_date("day").alias("game_date"), (F.col("billionths") / F.lit(1e9)).alias("load_minutes"), F.col("games").alias("load_games"))
