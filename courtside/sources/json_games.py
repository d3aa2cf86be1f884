"""Games and rosters from landed JSON: a club's content system and a league's service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.functions import scalars as S

_NAMED = "struct<data:struct<attributes:struct<name:string>>>"
CMS_GAMES = f"struct<data:array<struct<attributes:struct<gameDate:string,homeScore:int,awayScore:int,homeTeam:{_NAMED},awayTeam:{_NAMED},competition:{_NAMED}>>>>"
_PHOTO = "struct<data:struct<attributes:struct<url:string,formats:struct<small:struct<url:string>>>>>"
CMS_ROSTER = f"struct<data:array<struct<attributes:struct<name:string,lastName:string,dorsal:string,team_member_position:struct<data:struct<attributes:struct<label:string>>>,photo:{_PHOTO}>>>>"
#: Competitions of the league's service (fixed values); others are its own league.
SERVICE_LEAGUES = {"liga endesa": "acb", "copa del rey": "copa-del-rey"}


def cms_games(landed: DataFrame, team: str | Column, first: str | None = None, last: str | None = None) -> DataFrame:
    """Games of ``landed(body)`` documents as the flat contract; incomplete rows fall away. Day bounds are inclusive.

    ``team`` is the name whose games these are, or a column of ``landed`` with it; other columns are carried along.
    """
    keep = [c for c in landed.columns if c != "body"]
    items = landed.select(*keep, (team if isinstance(team, Column) else F.lit(team)).alias("__team"), F.explode(F.from_json("body", CMS_GAMES)["data"]).alias("item")).select(*keep, "__team", "item.attributes.*")
    home, away = F.col("homeTeam.data.attributes.name"), F.col("awayTeam.data.attributes.name")
    day = F.try_to_date(F.substring("gameDate", 1, 10), "yyyy-MM-dd")
    rows = items.where(home.isNotNull() & away.isNotNull()).withColumn("day", day)
    if first:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    is_home = home == F.col("__team")
    return rows.select(
        *keep,
        S.date_text(F.col("day")).alias("date"),
        F.when(is_home, away).otherwise(home).alias("opponent"),
        is_home.alias("is_home"),
        F.when(is_home, F.col("homeScore")).otherwise(F.col("awayScore")).alias("points"),
        F.when(is_home, F.col("awayScore")).otherwise(F.col("homeScore")).alias("opp_points"),
        S.cms_league(F.col("competition.data.attributes.name")).alias("league"),
    )


def cms_roster(landed: DataFrame, media: str) -> DataFrame:
    """Players of roster documents: full name, position label, number as text, url of the small photo or else the full one."""
    keep = [c for c in landed.columns if c != "body"]
    items = landed.select(*keep, F.explode(F.from_json("body", CMS_ROSTER)["data"]).alias("item")).select(*keep, "item.attributes.*")
    name = F.trim(F.concat_ws(" ", F.trim("name"), F.trim("lastName")))
    photo = S.first_value(F.col("photo.data.attributes.formats.small.url"), F.col("photo.data.attributes.url"))
    rows = items.select(*keep, name.alias("name"), F.col("team_member_position.data.attributes.label").alias("position"), F.col("dorsal").alias("number"), F.concat(F.lit(media), photo).alias("photo_url"))
    return rows.where("name <> ''")


# The keys under which services have a field, in order of precedence.
HOME_KEYS, AWAY_KEYS = ("home", "homeTeam", "home_team", "local"), ("away", "awayTeam", "away_team", "visitante")
DATE_KEYS, LEAGUE_KEYS = ("date", "fecha", "gameDate", "game_date"), ("competition", "competitionName", "competicion")
HOME_SCORE_KEYS, AWAY_SCORE_KEYS = ("homeScore", "home_score", "localScore"), ("awayScore", "away_score", "visitanteScore")
NAME_KEYS = ("name", "nombre", "teamName", "team_name")


def _texts(json: Column, *keys: str) -> Column:
    """The values of ``keys`` as texts, read in one pass; nulls where the text is no object."""
    return F.from_json(json, T.StructType([T.StructField(k, T.StringType()) for k in keys]))


def _any(item: Column, *keys: str) -> Column:
    return S.first_value(*[item[k] for k in keys])


def _team(raw: Column) -> Column:
    """A team's name, given as text or as an object with one of four keys."""
    return F.when(raw.startswith("{"), _any(_texts(raw, *NAME_KEYS), *NAME_KEYS)).otherwise(raw)


def service_games(landed: DataFrame, team: str | Column) -> DataFrame:
    """Games of a league service's ``landed(body)``: a list, or an object with ``data``. Keys go by several names;
    items without date or teams fall away, an unknown competition is the league itself. ``team`` is the name whose
    games these are, or a column of ``landed`` with it; other columns are carried along."""
    keep = [c for c in landed.columns if c != "body"]
    listed = F.coalesce(F.get_json_object("body", "$.data"), F.col("body"))
    keys = [*HOME_KEYS, *AWAY_KEYS, *DATE_KEYS, *LEAGUE_KEYS, *HOME_SCORE_KEYS, *AWAY_SCORE_KEYS]
    # read before the list is spread out, so that an item is read once and not for each of its columns
    read = F.transform(F.from_json(listed, "array<string>"), lambda item: _texts(item, *keys))
    items = landed.select(*keep, (team if isinstance(team, Column) else F.lit(team)).alias("__team"), F.explode(read).alias("item"))
    item = F.col("item")
    home, away = _team(_any(item, *HOME_KEYS)), _team(_any(item, *AWAY_KEYS))
    date = _any(item, *DATE_KEYS)
    own, other = S.to_int(_any(item, *HOME_SCORE_KEYS)), S.to_int(_any(item, *AWAY_SCORE_KEYS))
    rows = items.select(*keep, "__team", date.alias("date"), home.alias("home"), away.alias("away"), own.alias("hs"), other.alias("as_"), F.lower(F.trim(_any(item, *LEAGUE_KEYS))).alias("competition"))
    rows = rows.where("date is not null and home is not null and away is not null")
    is_home = F.lower(F.trim("home")) == F.lower(F.trim("__team"))
    league = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SERVICE_LEAGUES.items() for x in kv]), F.col("competition")), F.lit("acb"))
    return rows.select(
        *keep,
        "date",
        F.when(is_home, F.col("away")).otherwise(F.col("home")).alias("opponent"),
        is_home.alias("is_home"),
        F.when(is_home, F.col("hs")).otherwise(F.col("as_")).alias("points"),
        F.when(is_home, F.col("as_")).otherwise(F.col("hs")).alias("opp_points"),
        league.alias("league"),
    )
