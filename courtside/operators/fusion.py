"""Fusion of the games that several sources report: one winner a key, its gaps filled by the losers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions import names
from courtside.functions import scalars as S

#: Order of trust; a source that is not listed comes after all (fixed values).
PRIORITY = {"realgm": 0, "bbr": 1, "cms": 2, "acb": 3}
UNKNOWN = 99
#: Fields that a loser may fill. The key's own fields are equal or belong to the winner.
FILLABLE = ["opponent_slug", "boxscore_url", "points", "opp_points", "notes", "league"]


def priority(source: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), source), F.lit(UNKNOWN))


def keyed(source_games: DataFrame) -> DataFrame:
    """Reported games with ``rival``, the normal form of the opponent, and the score of their data."""
    rows = source_games if "priority" in source_games.columns else source_games.withColumn("priority", priority(F.col("source")))
    return rows.withColumn("rival", names.source_key(F.col("opponent"))).withColumn("score", S.data_score(F.col("points"), F.col("opp_points"), F.col("boxscore_url")))


def fuse(source_games: DataFrame, fill: bool = True) -> DataFrame:
    """One row for each (date, rival, is_home): lowest priority, then most data, then first seen.

    With ``fill`` each empty field takes the first value of the losers in order of trust; False and 0 are
    values. One shuffle, by key, for both.
    """
    key = ["date", "rival", "is_home"]
    trust = W.partitionBy(*key).orderBy("priority", F.desc("score"), "src_ord")
    everything = trust.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_priority = W.partitionBy(*key).orderBy("priority", "src_ord").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = keyed(source_games).withColumn("r", F.row_number().over(trust)).withColumn("reports", F.count("*").over(everything))
    if fill:
        known = {c: F.nullif(F.col(c), F.lit("")) if dict(rows.dtypes)[c] == "string" else F.col(c) for c in FILLABLE}
        first = {c: F.first(v, ignorenulls=True).over(by_priority) for c, v in known.items()}
        rows = rows.withColumns({f"__{c}": v for c, v in first.items()})
        rows = rows.withColumns({c: F.coalesce(known[c], F.col(f"__{c}")) for c in FILLABLE}).drop(*[f"__{c}" for c in FILLABLE])
    return rows.where("r = 1").drop("r")
