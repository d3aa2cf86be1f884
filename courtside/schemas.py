"""The domain's tables: declared schemas, natural keys, foreign keys, additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType()}
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


_SHOTS = "fg_made int,fg_attempted int,fg3_made int,fg3_attempted int,ft_made int,ft_attempted int"
SCHEMAS = {
    "teams": _struct("id long!,slug string!,name string!,league string!"),
    "players": _struct("id long!,name string!,team_id long,position string,number string,photo_url string"),
    "games": _struct("id long!,date string!,league string!,season int,home_team_id long,away_team_id long,home_score int,away_score int,boxscore_url string,notes string"),
    "boxscores": _struct(
        "id long!,game_id long!,team_id long!,player_name string!,minutes string,points int,rebounds int,offensive_rebounds int,defensive_rebounds int,assists int,steals int,blocks int,turnovers int,"
        + _SHOTS
        + ",plus_minus double,efg_pct double,ts_pct double,personal_fouls int,games_started int"
    ),
    "team_game_stats": _struct(
        "id long!,game_id long!,team_id long!,possessions double,pace double,off_rating double,def_rating double,net_rating double,"
        "team_points int,team_rebounds int,team_assists int,team_turnovers int,team_fg_attempted int,team_ft_attempted int"
    ),
    "player_game_logs": _struct(
        "id long!,player_id long!,game_id long!,season int,minutes string,points int,rebounds int,assists int,steals int,blocks int,turnovers int," + _SHOTS + ",plus_minus double,efg_pct double,ts_pct double"
    ),
    "season_team_stats": _struct(
        "id long!,team_id long!,season int!,games_played int,wins int,losses int,points_per_game double,rebounds_per_game double,assists_per_game double,pace double,off_rating double,def_rating double,net_rating double"
    ),
    "ingest_jobs": _struct("id long!,team_id long!,last_n int!,status string!,error string,created_at timestamp!,started_at timestamp,finished_at timestamp"),
}

#: Natural keys. A box score's key has the team: same-named opponents in one game are two rows.
KEYS = {
    "teams": ["slug"],
    "players": ["name", "team_id"],
    "games": ["date", "home_team_id", "away_team_id"],
    "boxscores": ["game_id", "team_id", "player_name"],
    "team_game_stats": ["game_id", "team_id"],
    "player_game_logs": ["player_id", "game_id"],
    "season_team_stats": ["team_id", "season"],
    "ingest_jobs": ["id"],
}

#: (table, column) -> table whose id it names.
FOREIGN = {
    ("players", "team_id"): "teams",
    ("games", "home_team_id"): "teams",
    ("games", "away_team_id"): "teams",
    ("boxscores", "game_id"): "games",
    ("boxscores", "team_id"): "teams",
    ("team_game_stats", "game_id"): "games",
    ("team_game_stats", "team_id"): "teams",
    ("player_game_logs", "player_id"): "players",
    ("player_game_logs", "game_id"): "games",
    ("season_team_stats", "team_id"): "teams",
    ("ingest_jobs", "team_id"): "teams",
}


def migrate(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the declared schema: missing columns come in as typed nulls, known ones are cast, others stay behind them."""
    declared = SCHEMAS[table]
    own = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared]
    return df.select(*own, *[c for c in df.columns if c not in declared.fieldNames()])


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Natural keys that stand on several rows, with their number."""
    return df.groupBy(*KEYS[table]).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows whose non-null reference names no row of ``parent``."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col("id").alias(column)), column, "left_anti")
