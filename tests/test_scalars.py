import datetime
import time
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from courtside.functions import names
from courtside.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def text(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    ("value", "season"),
    [("Sun, Nov 23, 2025", 2025), ("Sun, Feb 8, 2026", 2025), ("Mon, May 4, 2026", 2025), ("Wed, Aug 12, 2026", 2026), ("Fri, Nov 23, 2025", 2025), ("not-a-date", None), ("", None), (None, None)],
)
def test_season(spark, value, season):
    assert one(spark, S.season_of(S.parse_date(text(value)))) == season


@pytest.mark.parametrize(("season", "label"), [(2025, "2025-26"), (1999, "1999-00"), (None, "-")])
def test_season_label(spark, season, label):
    assert one(spark, S.season_label(F.lit(season).cast("int"))) == label


@pytest.mark.parametrize(
    ("value", "minutes"), [("30:00", 30.0), ("28:30", 28.5), ("12:15", 12.25), ("0:00", 0.0), ("25.5", 25.5), ("", None), (None, None), ("abc", None), ("1:2:3", None), ("a:10", None)]
)
def test_minutes(spark, value, minutes):
    assert one(spark, S.parse_minutes(text(value))) == minutes


@pytest.mark.parametrize(("value", "minutes", "result"), [(18, 36.0, 18.0), (9, 18.0, 18.0), (None, 30.0, None), (10, None, None), (10, 0.0, None)])
def test_per_36(spark, value, minutes, result):
    assert one(spark, S.per_36(F.lit(value).cast("int"), F.lit(minutes).cast("double"))) == result


@pytest.mark.parametrize(("code", "label"), [("acb", "ACB"), ("euroleague", "Euroliga"), ("supercopa", "Supercopa"), (None, "Todas"), ("copa", "Copa"), ("gira DE verano", "Gira de verano")])
def test_league_label(spark, code, label):
    assert one(spark, S.league_label(text(code))) == label


def test_shooting(spark):
    i = lambda v: F.lit(v).cast("int")
    assert one(spark, S.effective_fg(i(8), i(15), i(4))) == pytest.approx(10 / 15)
    assert one(spark, S.effective_fg(i(0), i(0), i(0))) is None
    assert one(spark, S.effective_fg(i(None), i(None), i(None))) is None
    assert one(spark, S.effective_fg(i(5), i(10), i(None))) == 0.5
    assert one(spark, S.true_shooting(i(22), i(15), i(2))) == pytest.approx(22 / (2 * (15 + 0.44 * 2)))
    assert one(spark, S.true_shooting(i(0), i(0), i(0))) is None
    assert one(spark, S.possessions(i(80), i(10), i(12), i(20))) == 90.0
    assert one(spark, S.possessions(i(None), i(10), i(12), i(20))) is None


@pytest.mark.parametrize(("value", "number"), [("12.7", 12), ("-3.9", -3), ("", None), ("nan", None), ("7d", None), (" 7 ", 7), ("1e400", None), ("99999999999", None), (None, None)])
def test_to_int(spark, value, number):
    assert one(spark, S.to_int(text(value))) == number


@pytest.mark.parametrize(
    ("table", "league"), [("blue-ELG-regular-season", "euroleague"), ("blue-SPA-playoffs", "acb"), ("blue-ITA-regular-season", "ita"), ("games", None), ("blue-elg-regular-season", None), (None, None)]
)
def test_competition(spark, table, league):
    assert one(spark, S.table_competition(text(table))) == league


def test_labels(spark):
    i = lambda v: F.lit(v).cast("int")
    assert one(spark, S.score_label(i(88), i(80))) == "88-80"
    assert one(spark, S.score_label(i(None), i(80))) == "pendiente"
    assert [one(spark, S.result_label(i(a), i(b))) for a, b in ((3, 2), (2, 3), (2, 2), (None, 2))] == ["W", "L", "L", None]
    assert [one(spark, S.streak_label(F.lit(z).cast("double"))) for z in (1.0, 0.99, -1.0, None)] == ["hot", "neutral", "cold", "neutral"]
    assert one(spark, S.long_date_es(text("Sun, Nov 23, 2025"))) == "domingo, 23 de noviembre de 2025"
    assert one(spark, S.long_date_es(text("soon"))) == "soon"
    assert one(spark, S.iso_date(text("Sun, Nov 23, 2025"))) == "2025-11-23"
    assert one(spark, S.date_text(F.lit(datetime.date(2025, 11, 3)))) == "Mon, Nov 03, 2025"
    assert one(spark, S.fixed(F.lit(None).cast("double"))) == "-"
    assert one(spark, S.percent(F.lit(0.5223))) == "52.2"


def test_names(spark):
    assert one(spark, names.team_key(text("Río-Plata  Básket"))) == "rioplatabasket"
    assert one(spark, names.source_key(text("Club Río Plata SAD"))) == "rio plata"
    assert one(spark, names.latin1(text("Čačak ☂"))) == "Cacak ?"
    assert one(spark, names.team_key(text(None))) is None


def test_hosts(spark):
    assert one(spark, S.is_host(text("https://www.example.com/x"), "example.com")) is True
    assert one(spark, S.is_host(text("https://example.org/?u=example.com"), "example.com")) is False
    assert one(spark, S.is_host(text(None), "example.com")) is False
    assert one(spark, S.cms_league(text("Copa del Rey"))) == "copa-del-rey"
    assert one(spark, S.cms_league(text(""))) == "club"


def test_names_leave_python_in_portions(spark):
    parts = list(names._strip(iter([pa.array(["é" * 300_000, None, "́", "a"] * 10)])))
    assert len(parts) > 2 and [x for p in parts for x in p.to_pylist()] == ["e" * 300_000, None, "", "a"] * 10
    texts = ["", "abc", "Àé ﬁ", "́", "x" * 9, None, "ΆЙ", "한"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", names.without_accents(F.col("t")).alias("x")).collect()
    assert [r.x for r in sorted(got)] == [t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]


def minutes_by_patterns(text):
    """``parse_minutes`` with every text split and matched."""
    minute, second = F.split_part(text, F.lit(":"), F.lit(1)), F.split_part(text, F.lit(":"), F.lit(2))
    clock = F.when(minute.rlike(S.INTEGER) & second.rlike(S.INTEGER), F.trim(minute).try_cast("int") + F.trim(second).try_cast("int") / F.lit(60.0))
    return F.when(F.size(F.split(text, ":")) == 2, clock).otherwise(S.to_float(text))


def test_minutes_of_odd_texts(spark):
    texts = ["28:30", "0:00", "00:5", "130:99", ":30", "5:", ":", "::", "1:2:3", "12", "25.5", " 7:05 ", "7 :05", "+7:05", "-7:-05", "7:5.5", "a:b", "1a:20", "", " ", None, "99999999999:00", "1:99999999999", "٣:٠٥", "7:05\n", "7:05 ", "1e2", ".5", "5.", "\t8:10"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, got, want in df.select("t", S.parse_minutes(F.col("t")), minutes_by_patterns(F.col("t"))).collect():
        assert got == want, text


def test_minutes_of_plain_clocks_need_no_pattern(spark):
    clocks = spark.range(3_000_000).select(F.concat((F.col("id") % 41).cast("string"), F.lit(":"), F.lpad((F.col("id") % 60).cast("string"), 2, "0")).alias("t"))

    def seconds(parse):
        began = time.perf_counter()
        clocks.select(parse(F.col("t"))).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    plain, patterns = (min(seconds(p) for _ in range(3)) for p in (S.parse_minutes, minutes_by_patterns))
    assert plain < 0.7 * patterns, (plain, patterns)
