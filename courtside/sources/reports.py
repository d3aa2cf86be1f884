"""Report sinks: canonical JSON lines and fixed-width text, built by Spark and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.operators.base import places


def canonical(df: DataFrame, n: int = 4) -> DataFrame:
    """``json``: each row with sorted keys, doubles to ``n`` places, NaN as null, and nulls written out."""
    cells: list[Column] = []
    for c, t in sorted(df.dtypes):
        v = F.col(c)
        cells.append((places(F.nanvl(v, F.lit(None).cast("double")), n) if t == "double" else v).alias(c))
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))


def _padded(name: str, width: int) -> Column:
    """A name filled up to a width, and whole if it is longer."""
    return F.rpad(name, F.greatest(F.lit(width), F.length(name)), F.lit(" "))


def form_lines(form: DataFrame) -> DataFrame:
    """``team_id, place, line``: the recent-form table of a text report, best scorers first."""
    c = F.col
    line = F.concat(_padded("player_name", 24), F.lpad(c("games").cast("string"), 4, " "), *[F.lpad(S.fixed(c(x)), 8, " ") for x in ("avg_minutes", "avg_pts", "avg_pts_per36")], F.lpad(S.percent(c("avg_efg_pct")), 8, " "), F.lpad(S.percent(c("avg_ts_pct")), 8, " "))
    best = W.partitionBy("team_id").orderBy(F.desc("avg_pts"), "player_name")
    return form.select("team_id", F.row_number().over(best).alias("place"), line.alias("line"))


def summary_lines(summary: DataFrame, teams: DataFrame) -> DataFrame:
    """``team_id, line``: one line a team for the head of a report."""
    c = F.col
    line = F.concat_ws("  ", _padded("name", 20), *[F.concat(F.lit(f"{label} "), S.fixed(c(x))) for label, x in (("Pace", "avg_pace"), ("ORtg", "avg_off_rating"), ("DRtg", "avg_def_rating"), ("Net", "avg_net_rating"))], F.concat(F.lit("eFG% "), S.percent(c("avg_efg_pct"))), F.concat(F.lit("TS% "), S.percent(c("avg_ts_pct"))))
    return summary.join(teams.select(c("id").alias("team_id"), "name"), "team_id").select("team_id", line.alias("line"))


def write_text(lines: DataFrame, path: str) -> None:
    """Lines to a folder of text files, one sub-folder and file a team, in the order of ``place`` where there is one."""
    order = [c for c in ("team_id", "place") if c in lines.columns]
    lines.repartition("team_id").sortWithinPartitions(*order).select("team_id", "line").write.mode("overwrite").partitionBy("team_id").text(path)


def version_tag(df: DataFrame) -> DataFrame:
    """A validator for caches: it changes if any row does. One row; the order of rows doesn't matter."""
    return df.agg(F.concat_ws("-", F.count("*").cast("string"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).cast("string")).alias("etag"))
