"""Keyed upserts by rule tables.

Plain Parquet has no MERGE, so in an upsert stored and new rows meet by the natural key, with a rule for each
column, and a stored table is a folder of versions. New rows of one key are folded in their order of arrival first, as one-by-one application would.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside import schemas
from courtside.functions import scalars as S


#: The column by which an upsert's result is dealt, where its caller names one.
DEALT = "__dealt"


@dataclass(frozen=True)
class Rules:
    """What becomes of each column: ``overwrite`` takes the new value, ``keep`` the new one unless it is
    missing, ``computed`` follows from the merged row. Any other column of the stored table stays as it is,
    and an inserted row takes it from the new one. ``id`` is minted for inserted rows."""

    table: str
    overwrite: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    computed: dict[str, tuple[list[str], Column]] | None = None

    @property
    def key(self) -> list[str]:
        return schemas.KEYS[self.table]


_STATS = "points rebounds assists steals blocks turnovers fg_made fg_attempted fg3_made fg3_attempted ft_made ft_attempted plus_minus".split()


def _shooting() -> dict[str, tuple[list[str], Column]]:
    efg, ts = ["fg_made", "fg_attempted", "fg3_made"], ["points", "fg_attempted", "ft_attempted"]
    return {"efg_pct": (efg, S.effective_fg(*map(F.col, efg))), "ts_pct": (ts, S.true_shooting(*map(F.col, ts)))}


def rules(table: str) -> Rules:
    """The rule table of one of the domain's tables; its natural key is the schema's."""
    return {
        "teams": lambda: Rules(table, overwrite=["name", "league"]),
        "players": lambda: Rules(table, keep=["position", "number", "photo_url"]),
        "games": lambda: Rules(table, keep=["league", "season", "home_score", "away_score", "boxscore_url", "notes"]),
        "boxscores": lambda: Rules(table, keep=["minutes", "offensive_rebounds", "defensive_rebounds", "personal_fouls", "games_started", *_STATS], computed=_shooting()),
        "team_game_stats": lambda: Rules(
            table,
            overwrite=["possessions", "pace", "off_rating", "def_rating", "net_rating", "team_points", "team_rebounds", "team_assists", "team_turnovers", "team_fg_attempted", "team_ft_attempted"],
        ),
        "player_game_logs": lambda: Rules(table, keep=["season", "minutes", *_STATS], computed=_shooting()),
        "season_team_stats": lambda: Rules(table, overwrite=["games_played", "wins", "losses", "points_per_game", "rebounds_per_game", "assists_per_game", "pace", "off_rating", "def_rating", "net_rating"]),
    }[table]()


def _given(df: DataFrame, column: str, zero_is_missing: bool) -> Column:
    kind = dict(df.dtypes)[column]
    if kind == "string":
        return F.nullif(F.col(column), F.lit(""))
    return F.nullif(F.col(column), F.lit(0).cast(kind)) if zero_is_missing else F.col(column)


def minted(rows: DataFrame, key: list[str], start: Column, buckets: int = 4096) -> DataFrame:
    """``rows`` with a unique ``id`` from ``start`` on that only their keys decide.

    Rows are numbered within buckets of their keys' hash, and buckets take turns: no task sees all rows, and the
    gaps are as small as the buckets are even.
    """
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    within = F.row_number().over(W.partitionBy("__bucket").orderBy(*key)) - 1
    return dealt.withColumn("id", start + within * buckets + F.col("__bucket")).drop("__bucket")


def upsert(old: DataFrame, new: DataFrame, how: Rules, *, order: str | None = None, zero_is_missing: bool = False, mint: Callable[[DataFrame], DataFrame] | None = None, deal: Column | None = None) -> DataFrame:
    """``old`` after applying the rows of ``new``: all columns of ``old``, those that only ``new`` has, and ``change``.

    ``order`` names the column of arrival in ``new``, by which rows of one key are folded into one; without it a key
    that stands twice in ``new`` raises an error. Keys with nulls are keys like others. ``mint`` gives inserted rows
    their ids, by default on from the greatest of ``old``. With ``zero_is_missing`` a zero is treated like null in kept columns, as the reference's
    storage does. Where ``old`` has an ``id``, stored rows keep theirs and inserted ones go on from the greatest;
    an ``id`` in ``new`` is not read. Computed columns are null where no side has what they follow from.
    ``deal``, a function of the key, becomes the column ``DEALT``; without ids to mint, rows are dealt by it to the tasks.
    """
    key, kinds = how.key, dict(new.dtypes) | dict(old.dtypes)
    extra = [c for c in new.columns if c not in old.columns and c != order and c != "id"]
    named = [c for c in [*old.columns, *extra] if c not in key and c != "id"]
    kept = [c for c in named if c in how.keep]

    fresh = new.select(*[F.col(c).cast(kinds[c]).alias(c) for c in key], *[(F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in named], *([order] if order else []))
    given = {c: _given(fresh, c, zero_is_missing) for c in kept}
    if order:
        last = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        folded = {c: F.last(given[c], ignorenulls=True) if c in given else F.last(c) if c in how.overwrite else F.first(c) for c in named}
        rank = F.row_number().over(W.partitionBy(*key).orderBy(order))
        fresh = fresh.select(*key, *[v.over(last).alias(c) for c, v in folded.items()], rank.alias("__r")).where("__r = 1").drop("__r")
    else:
        once = fresh.withColumns(given).groupBy(*key).agg(F.any_value(F.struct(*named)).alias("r"), F.count("*").alias("n"))
        twice = F.raise_error(F.concat(F.lit(f"rows of one key in a delivery of {how.table} need an order: "), F.to_json(F.struct(*key))))
        fresh = once.withColumn("r", F.when(F.col("n") > 1, twice.cast(once.schema["r"].dataType)).otherwise(F.col("r"))).select(*key, *[F.col("r").getField(c).alias(c) for c in named])

    # stored and arriving rows of a key meet in one shuffle, which ``deal`` may name so that the result is dealt by it
    with_id = ["id"] if "id" in old.columns else []
    lacking = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c)
    stored, arriving = (df.select(*key, *[lacking(df, c) for c in [*with_id, *named]], F.lit(there).alias("__stored")) for df, there in ((old, True), (fresh, False)))
    rows = stored.unionByName(arriving)
    if deal is not None:
        rows = rows.withColumn(DEALT, deal).repartition(DEALT)
    dealt = [DEALT] if deal is not None else []
    of = W.partitionBy(*dealt, *key)
    taken = [c for c in named if c in kept or c in how.overwrite]
    now = F.first(F.when(~F.col("__stored"), F.struct(F.lit(True).alias("__there"), *taken)), ignorenulls=True).over(of)
    both = rows.withColumns({"__now": now, "__known": F.max("__stored").over(of)}).where("__stored or not __known")
    known, arrived = F.col("__stored"), F.col("__now").isNotNull()

    def value(c: str) -> Column:
        if c not in taken:
            return F.col(c)
        new_value = F.col("__now").getField(c)
        return F.when(arrived, new_value).otherwise(F.col(c)) if c in how.overwrite else F.coalesce(new_value, c)

    change = F.when(~known, "inserted").when(arrived, "updated").otherwise("kept")
    out = both.select(*dealt, *with_id, *key, *[value(c).alias(c) for c in named], change.alias("change"))
    for c, (inputs, v) in (how.computed or {}).items():
        out = out.withColumn(c, v if set(inputs) <= set(out.columns) else F.lit(None).cast("double"))
    if with_id:
        most = old.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
        inserted = out.where("change = 'inserted'").drop("id")
        new_rows = mint(inserted) if mint else minted(inserted, key, most + 1)
        out = out.where("change <> 'inserted'").unionByName(new_rows.withColumn("id", F.col("id").cast(kinds["id"])).select(*out.columns))
    computed = [c for c in how.computed or {} if c not in old.columns and c not in extra]
    return out.select(*old.columns, *extra, *computed, "change", *dealt)


def _fs(spark, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark, path: str) -> list[int]:
    """Complete versions of a stored table: folders ``v=<n>`` whose write has ended."""
    folder, fs = _fs(spark, path)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[0]))


def current(spark, path: str) -> DataFrame:
    """The newest complete version of a stored table."""
    return spark.read.parquet(f"{path}/v={versions(spark, path)[-1]}")


def replace_table(df: DataFrame, path: str, keep: int = 2) -> int:
    """Write ``df`` as the table's next version, though it may read the present one, and return its number.

    A version counts once its write has ended, so readers find the old table or the new one at any time and never
    none; versions before the last ``keep`` go. One writer at a time.
    """
    spark = df.sparkSession
    number = max(versions(spark, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={number}")
    for old in versions(spark, path)[:-keep]:
        folder, fs = _fs(spark, f"{path}/v={old}")
        fs.delete(folder, True)
    return number


def snapshot(path: str, stamp: str, spark) -> str | None:
    """Copy a table's newest version beside it under a time stamp; None if there is no table."""
    if not versions(spark, path):
        return None
    copy = f"{path}.{stamp}"
    current(spark, path).write.mode("errorifexists").parquet(copy)
    return copy
