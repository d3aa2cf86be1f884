"""The domain's scalar functions. All are built-in Column expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, thresholds and formats of the domain.
LEAGUE_LABELS = {"acb": "ACB", "euroleague": "Euroliga", "supercopa": "Supercopa"}
TABLE_COMPETITIONS = {"SPA": "acb", "ELG": "euroleague"}
CMS_LEAGUES = {"liga endesa": "acb", "euroleague": "euroleague", "copa del rey": "copa-del-rey", "supercopa": "supercopa"}
WEEKDAYS_ES = ["domingo", "lunes", "martes", "miércoles", "jueves", "viernes", "sábado"]
MONTHS_ES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
HOT, COLD = 1.0, -1.0
SEASON_FIRST_MONTH = 7
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^\s*[+-]?[0-9]+\s*$"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_date(text: Column) -> Column:
    """``Sun, Nov 23, 2025`` -> date. The weekday must be there but is not compared with the date; null on failure."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"^[A-Za-z]{3}, (.*)$", 1), F.lit("")), "MMM d, yyyy")


def date_text(d: Column) -> Column:
    """date -> ``Sun, Nov 23, 2025``."""
    return F.date_format(d, "EEE, MMM dd, yyyy")


def iso_date(text: Column) -> Column:
    """Date text as ISO, or the text itself where it is no date."""
    return F.coalesce(parse_date(text).cast("string"), text)


def long_date_es(text: Column) -> Column:
    """``domingo, 23 de noviembre de 2025``, or the text itself where it is no date."""
    d = parse_date(text)
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS_ES)), F.dayofweek(d))
    month = F.element_at(F.array(*map(F.lit, MONTHS_ES)), F.month(d))
    return F.coalesce(F.concat(day, F.lit(", "), F.day(d).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(d).cast("string")), text)


def season_of(d: Column) -> Column:
    """First year of the season that a date falls in: it turns in July."""
    return F.when(F.month(d) >= SEASON_FIRST_MONTH, F.year(d)).otherwise(F.year(d) - 1)


def season_label(season: Column) -> Column:
    """2025 -> ``2025-26``; null -> ``-``."""
    return F.coalesce(F.concat(season.cast("string"), F.lit("-"), F.lpad(F.pmod(season + 1, F.lit(100)).cast("string"), 2, "0")), F.lit("-"))


def season_range(season: Column) -> tuple[Column, Column]:
    """First and last day on which games of a season are looked for."""
    return F.make_date(season, F.lit(10), F.lit(1)), F.make_date(season + 1, F.lit(6), F.lit(30))


def league_label(code: Column) -> Column:
    """Known codes by name, null as all, others with a capital first letter and the rest in lower case."""
    other = F.concat(F.upper(F.substring(code, 1, 1)), F.lower(F.substring(code, 2, 1 << 30)))
    return F.when(code.isNull() | (code == ""), "Todas").otherwise(F.coalesce(F.element_at(_map(LEAGUE_LABELS), code), other))


def display_name(slug: Column, name: Column, known: dict[str, str] | None = None) -> Column:
    """The name to show: that of ``known`` for the slug, else the stored one."""
    return F.coalesce(F.element_at(_map(known), slug), name) if known else name


def to_float(text: Column) -> Column:
    """Number text to double; null where it is none."""
    return F.when(F.trim(text).rlike(NUMBER), F.trim(text).try_cast("double"))


def to_int(text: Column) -> Column:
    """Number text to int, cut towards zero; null where it is none or too large."""
    return to_float(text).try_cast("int")


def parse_minutes(text: Column) -> Column:
    """``28:30`` -> 28.5, ``25.5`` -> 25.5; null for no text and for anything else.

    Nearly all texts are digits around one colon, which trimming tells without a pattern; patterns judge the rest."""
    plain = F.substring_index(text, ":", 1).try_cast("int") + F.substring_index(text, ":", -1).try_cast("int") / F.lit(60.0)
    minute, second = F.split_part(text, F.lit(":"), F.lit(1)), F.split_part(text, F.lit(":"), F.lit(2))
    clock = F.when(minute.rlike(INTEGER) & second.rlike(INTEGER), F.trim(minute).try_cast("int") + F.trim(second).try_cast("int") / F.lit(60.0))
    other = F.when(F.size(F.split(text, ":")) == 2, clock).otherwise(to_float(text))
    return F.when(text == "", F.lit(None).cast("double")).when(F.btrim(text, F.lit("0123456789")) == ":", plain).otherwise(other)


def per_36(value: Column, minutes: Column) -> Column:
    """Null if either is null or there are no minutes."""
    return F.try_divide(value * F.lit(36.0), minutes)


def effective_fg(made: Column, attempted: Column, threes: Column) -> Column:
    return F.try_divide(F.coalesce(made, F.lit(0)) + F.lit(0.5) * F.coalesce(threes, F.lit(0)), attempted)


def true_shooting(points: Column, attempted: Column, free: Column) -> Column:
    zero = F.lit(0)
    return F.try_divide(F.coalesce(points, zero), F.lit(2.0) * (F.coalesce(attempted, zero) + F.lit(0.44) * F.coalesce(free, zero)))


def possessions(attempted: Column, offensive_rebounds: Column, turnovers: Column, free: Column) -> Column:
    """FGA - ORB + TOV + 0.4 FTA; null only without FGA."""
    zero = F.lit(0)
    return attempted - F.coalesce(offensive_rebounds, zero) + F.coalesce(turnovers, zero) + F.lit(0.4) * F.coalesce(free, zero)


def rating(points: Column, poss: Column) -> Column:
    """Points per hundred possessions; null without points or possessions."""
    return F.try_divide(points * F.lit(100.0), poss)


def streak_label(z: Column) -> Column:
    return F.when(z >= HOT, "hot").when(z <= COLD, "cold").otherwise("neutral")


def score_label(own: Column, other: Column) -> Column:
    return F.when(own.isNull(), "pendiente").otherwise(F.concat(own.cast("string"), F.lit("-"), F.coalesce(other.cast("string"), F.lit("None"))))


def result_label(own: Column, other: Column) -> Column:
    """W or L, a tie is L; null for a game without both scores."""
    return F.when(own.isNotNull() & other.isNotNull(), F.when(own > other, "W").otherwise("L"))


def table_competition(table_id: Column) -> Column:
    """``blue-ELG-regular-season`` -> euroleague; null where the id has another form."""
    code = F.nullif(F.regexp_extract(table_id, r"-([A-Z]+)-(?:regular-season|playoffs)$", 1), F.lit(""))
    return F.coalesce(F.element_at(_map(TABLE_COMPETITIONS), code), F.lower(code))


def cms_league(name: Column, default: str = "club") -> Column:
    """Known competitions by code, others in lower case with hyphens, ``default`` for none."""
    low = F.lower(F.trim(name))
    return F.when(name.isNull() | (name == ""), default).otherwise(F.coalesce(F.element_at(_map(CMS_LEAGUES), low), F.replace(low, F.lit(" "), F.lit("-"))))


def first_value(*columns: Column) -> Column:
    """The first that is neither null nor empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def data_score(points: Column, opp_points: Column, url: Column) -> Column:
    """One for any score, one for a box-score link."""
    return F.when(points.isNotNull() | opp_points.isNotNull(), 1).otherwise(0) + F.when(F.coalesce(url, F.lit("")) != "", 1).otherwise(0)


def is_host(url: Column, host: str) -> Column:
    """Whether the url's host is ``host`` or ends with it; false for no url."""
    return F.coalesce(F.endswith(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(host)), F.lit(False))


def fixed(value: Column, places: int = 1) -> Column:
    """A number with fixed places, rounded half-even on its decimal form; ``-`` for null."""
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%.{places}f", F.bround(value, places)))


def percent(value: Column, places: int = 1) -> Column:
    return fixed(value * 100, places)


def close(a: Column, b: Column, absolute: float = 0.11, relative: float = 0.005) -> Column:
    """Whether two outputs agree: both null, or within either tolerance."""
    d = F.abs(a - b)
    return F.coalesce((d <= absolute) | (d <= relative * F.greatest(F.abs(a), F.abs(b))), a.isNull() & b.isNull())
