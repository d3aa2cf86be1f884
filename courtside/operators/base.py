"""Views that most operators start from."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions import scalars as S


def scoped(df: DataFrame, *, team_id: int | None = None, season: int | None = None, league: str | None = None) -> DataFrame:
    """Optional filters, combined; one left out doesn't filter. They stand next to the scan, so they are pushed down."""
    for column, value in (("team_id", team_id), ("season", season), ("league", league)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def team_games(games: DataFrame) -> DataFrame:
    """Two rows a game, one from each side: ``team_id, opponent_id, is_home, own_score, opp_score``."""

    def side(own: str, other: str, home: bool) -> Column:
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            F.lit(home).alias("is_home"),
            F.col(f"{own}_score").alias("own_score"),
            F.col(f"{other}_score").alias("opp_score"),
        )

    keep = [F.col("id").alias("game_id"), "date", "game_date", "season", "league", "boxscore_url"]
    return games.select(*keep, F.inline(F.array(side("home", "away", True), side("away", "home", False))))


def bounded(name: str, value: int, most: int) -> int:
    """A parameter that counts games or days: 1 to ``most``."""
    if not 1 <= value <= most:
        raise ValueError(f"{name} must be from 1 to {most}, not {value}")
    return value


def placed(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in the list of their key. Who shows them sorts by key and place."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def season_boxes(games: DataFrame, boxscores: DataFrame, *, team_id: int | None = None, season: int | None = None, league: str | None = None) -> DataFrame:
    """Box-score rows with their game's season, league and (where it has one) day, and ``mins`` as a number."""
    day = [c for c in ("game_date",) if c in games.columns]
    of = scoped(games.select(F.col("id").alias("game_id"), "season", "league", *day), season=season, league=league)
    return scoped(boxscores, team_id=team_id).join(of, "game_id").withColumn("mins", S.parse_minutes(F.col("minutes")))


def zero_as_missing(boxscores: DataFrame, columns: list[str]) -> DataFrame:
    """The reference's storage keeps no zero: a parsed 0 is null there. This gives the same rows on demand."""
    return boxscores.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in columns})


def places(column: Column | str, n: int, half_even: bool = False) -> Column:
    """A double to ``n`` decimal places, rounded on its binary value: half away from zero, or half to even."""
    scaled = (F.col(column) if isinstance(column, str) else column) * F.lit(10.0**n)
    return (F.rint(scaled) if half_even else F.round(scaled)) / F.lit(10.0**n)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles to fixed places, as outputs are compared and shown."""
    return df.select(*[places(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def mean(column: Column | str) -> Column:
    """Mean of a number, summed in whole billionths: the same whatever the order of the rows; null of none.

    High and low bits are summed as longs of their own and put together once a group as a decimal: 5 * 10^11 rows of
    a group fit, of values up to 10^5 in size; beyond, the sum is an error.
    """
    c = F.col(column) if isinstance(column, str) else column
    units = F.round(c * F.lit(1e9)).cast("long")
    high, low = F.sum(F.shiftright(units, 24)), F.sum(units.bitwiseAND(F.lit((1 << 24) - 1)))
    total = high.cast("decimal(20,0)") * F.lit(1 << 24).cast("decimal(8,0)") + low.cast("decimal(20,0)")
    return total.cast("double") / F.nullif(F.count(c), F.lit(0)) / F.lit(1e9)


def ranked(rows: DataFrame, name: str, order: list[Column], bucket: Column, keys: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """``rows`` with ``name``, their place from 1 in the order (bucket, *order) of their key, without a task that sees
    all rows of a key: rows are numbered within each bucket, and the sizes of the buckets are summed.
    Of buckets a null is the least; nulls in a key are one key."""
    dealt = rows.withColumn("__bucket", bucket)
    parts = [*keys, "__bucket"]
    sizes = dealt.groupBy(*parts).agg(F.count("*").alias("__n"))
    so_far = W.partitionBy(*keys).orderBy(F.desc("__bucket") if descending else F.asc("__bucket")).rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = sizes.select(*[F.col(k).alias(f"__of_{k}") for k in parts], (F.sum("__n").over(so_far) - F.col("__n")).alias("__before"))
    within = F.row_number().over(W.partitionBy(*parts).orderBy(*order))
    joined = dealt.withColumn("__within", within).join(offsets, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in parts]))
    return joined.withColumn(name, (F.col("__before") + F.col("__within")).cast("int")).drop("__bucket", "__before", "__within", *[f"__of_{k}" for k in parts])
