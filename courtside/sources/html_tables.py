"""Tables in landed HTML, also those hidden in comments, as rows of a DataFrame.

Pages are landed by a fetcher outside Spark; a page is one string. Parsing is a small vectorised helper,
all that follows from the cells is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions import scalars as S

CELL = "struct<text:string,stat:string,href:string,header:boolean>"
ROW = f"struct<css:string,head:boolean,cells:array<{CELL}>>"
TABLE = f"array<struct<ordinal:int,table_id:string,caption:string,headers:array<string>,rows:array<{ROW}>>>"
LINKS = "array<struct<text:string,href:string>>"

#: Cells, rows, links and pages, about, of which Python holds the results before it gives them back.
PORTION = 20_000

#: Header names of one source as the others have them (fixed values).
HEADER_ALIASES = {"MIN": "MP", "TO": "TOV", "FGM": "FG", "3PM": "3P", "FTM": "FT", "REB": "TRB", "OREB": "ORB", "DREB": "DRB"}


# Markup without anything unusual: known tags with quoted attributes, comments without a "--" inside.
_NAMES = "table|thead|tbody|tfoot|caption|tr|td|th|a|html|body|div|p|span|b|i|u|em|strong|small|sup|sub|h[1-6]|ul|ol|li|br"
_QUOTED = r"""(?:\s++[a-zA-Z][a-zA-Z-]*+="[^"<>&]*+")*+"""
_MARKUP = rf"""<(?:(?P<end>/)(?P<ended>{_NAMES})\s*+|(?P<begun>{_NAMES})(?P<attrs>{_QUOTED})\s*+|!--(?!-?>)(?P<comment>[^-]*+(?:-(?!-)[^-]*+)*+)--)>"""
# A row of cells that hold nothing but text and have no attributes is one token, and so is such a cell that has some.
# Where a match may fail behind a group there are no possessive quantifiers in it: Python's re loses the group's span.
_BARE = "|".join(rf"<tr>(?P<{t}s><{t}>[^<]*(?:</{t}><{t}>[^<]*)*)</{t}></tr>" for t in ("td", "th"))
_PLAIN = re.compile(r"[^<]*+(?:(?:" + re.sub(r"\?P<\w+>", "?:", rf"(?-i:{_BARE})|{_MARKUP}") + r")[^<]*+)*+", re.IGNORECASE)
_TOKENS = re.compile(rf"(?:(?-i:{_BARE})|<(t[dh])({_QUOTED.replace("++", "+").replace("*+", "*")})\s*>([^<]*)</t[dh]\s*+>|{_MARKUP})([^<]*+)", re.IGNORECASE)
_ATTRS = re.compile(r'([a-zA-Z-]+)="([^"]*)"')


class _Reader(HTMLParser):
    """A parser that also reads plain markup, cut into tags by a pattern, several times as fast; any other page goes
    through the parser's own reading. Both call the same handlers in the same order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def read(self, html: str) -> _Reader:
        if not _PLAIN.fullmatch(html):
            self.feed(html)
            self.close()
            return self
        attributes = lambda attrs: [(k.lower(), v) for k, v in _ATTRS.findall(attrs)] if attrs else []
        first = html.find("<")
        if first:
            self.handle_data(unescape(html if first < 0 else html[:first]))
        for tds, ths, cell, its, inside, end, ended, begun, attrs, comment, text in _TOKENS.findall(html):
            if tds or ths:
                tag, texts = ("td", tds[4:]) if tds else ("th", ths[4:])
                cells = texts.split(f"</{tag}><{tag}>")
                self.handle_row(tag, [unescape(x) for x in cells] if "&" in texts else cells)
            elif cell:
                self.handle_cell(cell.lower(), attributes(its), unescape(inside) if "&" in inside else inside)
            elif begun:
                self.handle_starttag(begun.lower(), attributes(attrs))
            elif end:
                self.handle_endtag(ended.lower())
            else:
                self.handle_comment(comment)
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
        return self

    def handle_row(self, tag: str, texts: list[str]) -> None:
        self.handle_starttag("tr", [])
        for text in texts:
            self.handle_cell(tag, [], text)
        self.handle_endtag("tr")

    def handle_cell(self, tag: str, attrs: list, text: str) -> None:
        self.handle_starttag(tag, attrs)
        if text:
            self.handle_data(text)
        self.handle_endtag(tag)


#: What tables and cells hold, in this order. A row is its class, whether it is in the head, and its cells column by column.
_TABLE, _CELL = ("table_id", "caption", "headers", "rows"), ("text", "stat", "href", "header")


class _Tables(_Reader):
    """Collects tables as nested lists; a comment that holds a table is parsed like the page."""

    def __init__(self):
        super().__init__()
        self.tables: list[list] = []
        self.hidden: list[list] = []
        self.open: list[list] = []
        self.head = self.caption = False
        self.cell: tuple | None = None  # the row whose last cell is open

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "table":
            self.open.append([a.get("id", ""), "", [], []])
            self.tables.append(self.open[-1])
        if not self.open:
            return
        rows = self.open[-1][3]
        if tag in ("thead", "tbody", "tfoot"):
            self.head = tag == "thead"
        elif tag == "caption":
            self.caption = True
        elif tag == "tr":
            rows.append((a.get("class", ""), self.head, [], [], [], []))
        elif tag in ("td", "th") and rows:
            self.cell = rows[-1]
            self._add("", a.get("data-stat", ""), None, tag == "th")
        elif tag == "a" and self.cell is not None and self.cell[4][-1] is None:
            self.cell[4][-1] = a.get("href")

    def _add(self, *cell) -> None:
        for column, value in zip(self.open[-1][3][-1][2:], cell):
            column.append(value)

    def handle_row(self, tag, texts):
        if not self.open:
            super().handle_row(tag, texts)
            return
        n = len(texts)
        self.open[-1][3].append(("", self.head, texts, [""] * n, [None] * n, [tag == "th"] * n))
        self.cell = None

    def handle_cell(self, tag, attrs, text):
        if not self.open or not self.open[-1][3]:
            super().handle_cell(tag, attrs, text)
            return
        self._add(text, dict(attrs).get("data-stat", "") if attrs else "", None, tag == "th")
        self.cell = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = None
        elif tag == "thead":
            self.head = False
        elif tag == "caption":
            self.caption = False
        elif tag == "table" and self.open:
            table = self.open.pop()
            first = next((r for r in table[3] if r[1]), None)
            table[2] = [text.strip() for text, header in zip(first[2], first[5]) if header] if first else []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[2][-1] += data
        elif self.caption and self.open:
            self.open[-1][1] += data

    def handle_comment(self, data):
        if "<table" in data:
            self.hidden += _Tables().read(data).found()

    def found(self) -> list[list]:
        """All tables in order, those in comments after the visible ones."""
        return self.tables + self.hidden


def _parsed(html: str | None) -> list[list]:
    return _Tables().read(html or "").found()


def _shown(text: str) -> str:
    return " ".join(text.split())


def parse(html: str | None) -> list[dict]:
    """All tables of a page in order, those in comments after the visible ones."""
    row = lambda r: {"css": r[0], "head": r[1], "cells": [dict(zip(_CELL, c)) for c in zip(map(_shown, r[2]), *r[3:])]}
    return [dict(zip(_TABLE, (*t[:3], [row(r) for r in t[3]]))) | {"ordinal": k} for k, t in enumerate(_parsed(html))]


def _arrow(pages: list[list[list]]) -> pa.Array:
    """The tables of several pages as one array, put together column by column."""
    tables = [t for page in pages for t in page]
    rows = [r for t in tables for r in t[3]]
    column = lambda parts, n: list(zip(*parts)) or [()] * n
    strings = lambda values: pa.array(values, pa.string())

    def lists(parts, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, parts))], pa.int32()), values)

    css, head, text, *more = column(rows, 6)
    stat, href, header = (list(chain.from_iterable(c)) for c in more)
    cell = pa.StructArray.from_arrays([strings([*map(_shown, chain.from_iterable(text))]), strings(stat), strings(href), pa.array(header, pa.bool_())], list(_CELL))
    row = pa.StructArray.from_arrays([strings(css), pa.array(head, pa.bool_()), lists(text, cell)], ["css", "head", "cells"])
    table_id, caption, headers, of_table = column(tables, 4)
    ordinal = pa.array([k for page in pages for k in range(len(page))], pa.int32())
    table = pa.StructArray.from_arrays([ordinal, strings(table_id), strings(caption), lists(headers, strings([h for t in headers for h in t])), lists(of_table, row)], ["ordinal", *_TABLE])
    return lists(pages, table)


def _portions(batches: Iterator[pa.Array], read: Callable[[str | None], list], weight: Callable[[list], int], built: Callable[[list], pa.Array]) -> Iterator[pa.Array]:
    """What ``read`` makes of each page, given back in portions of bounded size however many and long a batch's pages are."""
    for batch in batches:
        held, size = [], 0
        for page in batch:
            held.append(read(page.as_py()))
            size += 1 + weight(held[-1])
            if size >= PORTION:
                yield built(held)
                held, size = [], 0
        if held or not len(batch):
            yield built(held)


def _tables(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _portions(pages, _parsed, lambda found: sum(len(r[2]) + 1 for t in found for r in t[3]), _arrow)


def html_tables(html: Column | str) -> Column:
    """The tables of a page as an array of structs."""
    return F.arrow_udf(_tables, TABLE)(html)


def tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with one row for each of their tables (``table_id, caption, headers, rows, ordinal``)."""
    return pages.select(*[c for c in pages.columns if c != html], F.inline(html_tables(html)))


def body_rows(found: DataFrame) -> DataFrame:
    """One row for each body row: ``row`` its place and ``cells``; separator and header rows are left out."""
    rows = found.select(*[c for c in found.columns if c != "rows"], F.posexplode("rows").alias("row", "r"))
    return rows.where(~F.col("r.head") & ~F.col("r.css").contains("thead") & (F.size("r.cells") > 0)).withColumn("cells", F.col("r.cells")).drop("r")


def by_header(found: DataFrame) -> DataFrame:
    """Body rows with ``values``, a map from header to text; cells beyond the headers are ``col_i``, without headers all are ``i``."""
    key = lambda i: F.when(F.size("headers") == 0, i.cast("string")).when(i < F.size("headers"), F.get("headers", i)).otherwise(F.concat(F.lit("col_"), i.cast("string")))
    pairs = F.transform("cells", lambda c, i: F.struct(key(i).alias("k"), c["text"].alias("v")))
    # of a header that stands twice the last counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.lit(0), F.size(pairs) - i - 1)), lambda q: q["k"] == p["k"]))
    # a table's headers are looked through once, not for each of its rows
    once = (F.size("headers") > 0) & (F.size(F.array_distinct("headers")) == F.size("headers"))
    rows = body_rows(found.withColumn("__once", once))
    plain = F.map_from_arrays(F.slice("headers", F.lit(1), F.size("cells")), F.col("cells.text"))
    values = F.when(F.col("__once") & (F.size("cells") == F.size("headers")), F.map_from_arrays("headers", F.col("cells.text"))).when(F.col("__once") & (F.size("cells") < F.size("headers")), plain).otherwise(F.map_from_entries(last))
    return rows.withColumn("values", values).drop("cells", "__once")


def by_stat(found: DataFrame) -> DataFrame:
    """Body rows with ``values``, a map from ``data-stat`` (without what follows ``|``) to text, of several the first, and ``links``."""
    name = lambda c: F.substring_index(c["stat"], "|", 1)
    named = F.filter("cells", lambda c: c["stat"] != "")
    first = F.filter(named, lambda c, i: ~F.exists(F.slice(named, 1, i), lambda d: name(d) == name(c)))
    rows = body_rows(found)
    texts = F.map_from_entries(F.transform(first, lambda c: F.struct(name(c), c["text"])))
    hrefs = F.map_from_entries(F.transform(F.filter(first, lambda c: c["href"].isNotNull()), lambda c: F.struct(name(c), c["href"])))
    return rows.withColumn("values", texts).withColumn("links", hrefs).drop("cells")


def standings(pages: DataFrame, key: str) -> DataFrame:
    """Rows of each page's standings: the first table whose id ends in ``standings``, else the first."""
    found = tables(pages)
    place = F.when(F.endswith("table_id", F.lit("standings")), F.col("ordinal")).otherwise(F.col("ordinal") + 1_000_000)
    first = found.groupBy(key).agg(F.min(place).alias("p")).withColumn("ordinal", F.col("p") % 1_000_000).drop("p")
    return by_stat(found.join(first, [key, "ordinal"]))


def team_roster(pages: DataFrame) -> DataFrame:
    """Per-game tables of team pages: by id, or by a caption with those words."""
    return by_header(tables(pages).where((F.col("table_id") == "per_game") | F.lower("caption").contains("per game")))


def schedule(pages: DataFrame) -> DataFrame:
    """Games of team schedule pages as the flat source contract. Rows without a date fall away; ``@`` is away."""
    found = tables(pages).where(F.col("table_id").rlike("^(games|schedule)$|-(regular-season|playoffs)$") | (F.array_contains("headers", "Date") & F.array_contains("headers", "Result")))
    rows = by_stat(found)
    v = lambda k: S.blank_to_null(F.col("values")[k])
    date = S.first_value(F.col("values")["date_game_full"], F.col("values")["date_game"])
    link = F.coalesce(F.col("links")["date_game_full"], F.col("links")["date_game"])
    opponent = S.first_value(F.col("values")["opp_name_link"], F.col("values")["opp_name"])
    slug = S.blank_to_null(F.regexp_extract(F.coalesce(F.col("links")["opp_name_link"], F.col("links")["opp_name"]), r"/teams/([^/]+)/", 1))
    keep = [c for c in pages.columns if c != "html"]
    out = rows.select(
        *keep,
        date.alias("date"),
        opponent.alias("opponent"),
        slug.alias("opponent_slug"),
        F.when(link.contains("boxscores"), link).alias("boxscore_url"),
        (F.coalesce(F.col("values")["game_location"], F.lit("")) != "@").alias("is_home"),
        S.to_int(v("pts")).alias("points"),
        S.to_int(v("opp_pts")).alias("opp_points"),
        v("notes").alias("notes"),
        S.table_competition(F.col("table_id")).alias("league"),
    )
    return out.where("date is not null")


def day_schedule(pages: DataFrame, team: str | None = None) -> DataFrame:
    """Games on day pages (``date, league, html``) from the side of ``team``, or without one from both sides of each.

    The score is read by its header, away side first where the Away column leads; the reference reads the fourth
    cell, home side first.
    """
    found = tables(pages).where(F.array_contains("headers", "Away Team") & F.array_contains("headers", "Home Team"))
    v = F.col("values")
    score = F.coalesce(v["Score"], v["Result"], F.lit(""))
    points = lambda k: F.nullif(F.regexp_extract(score, r"(\d+)\s*-\s*(\d+)", k), F.lit("")).cast("int")
    side = lambda home: F.struct((v["Home Team"] if home else v["Away Team"]).alias("team"), (v["Away Team"] if home else v["Home Team"]).alias("opponent"), F.lit(home).alias("is_home"), points(1 + home).alias("points"), points(2 - home).alias("opp_points"))
    rows = by_header(found).select("date", F.inline(F.array(side(True), side(False))), "league")
    return rows if team is None else rows.where(F.col("team") == team).drop("team")


def player_pages(pages: DataFrame) -> DataFrame:
    """Player pages: their meta paragraph and the rows of their per-game table."""
    meta = F.regexp_extract("html", r'(?is)<div[^>]*\bid="meta"[^>]*>(.*?)</div>', 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(meta, r"<[^>]*>", " "), r"\s+", " "))
    return team_roster(pages.withColumn("meta", plain))


def game_logs(pages: DataFrame) -> DataFrame:
    """Rows of the game-log table of player pages, under canonical header names: tables with a date and points."""
    found = tables(pages).where(F.array_contains("headers", "Date") & F.array_contains("headers", "PTS"))
    return by_header(canonical_headers(found)).where(S.blank_to_null(F.col("values")["Date"]).isNotNull())


class _Links(_Reader):
    """Collects links with their texts."""

    def __init__(self):
        super().__init__()
        self.found: list[dict] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.inside = True
            self.found.append({"text": "", "href": dict(attrs).get("href")})

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "a"

    def handle_data(self, data):
        if self.inside:
            self.found[-1]["text"] += data


def parse_links(html: str | None) -> list[dict]:
    """All links of a page in order."""
    found = _Links().read(html or "").found
    return [{"text": " ".join(x["text"].split()), "href": x["href"]} for x in found]


def _anchors(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("text", pa.string()), ("href", pa.string())]))
    yield from _portions(pages, parse_links, len, lambda held: pa.array(held, kind))


def anchors(html: Column | str) -> Column:
    """All links of a page, in its order, with their texts."""
    return F.arrow_udf(_anchors, LINKS)(html)


def link_to(html: Column | str, text: Column) -> Column:
    """The first link of a page whose text is ``text`` but for case: how a team's or a player's page is found."""
    return F.get(F.filter(anchors(html), lambda a: F.lower(a["text"]) == F.lower(F.trim(text))), F.lit(0))["href"]


def game_log_url(summary: Column) -> Column:
    """The game-log page that belongs to a player's summary page."""
    return F.replace(summary, F.lit("/Summary"), F.lit("/GameLogs"))


def canonical_headers(found: DataFrame) -> DataFrame:
    """Tables under the canonical header names."""
    known = F.create_map(*[F.lit(x) for kv in HEADER_ALIASES.items() for x in kv])
    return found.withColumn("headers", F.transform("headers", lambda h: F.coalesce(F.element_at(known, h), h)))


def box_scores(pages: DataFrame, key: str) -> DataFrame:
    """Player rows of box-score pages with ``side``: tables named for the sides (also in comments), else the
    first two that have Player and PTS, home first. Rows without a name fall away."""
    found = tables(pages).where(F.array_contains("headers", "Player") & F.array_contains("headers", "PTS"))
    order = F.row_number().over(W.partitionBy(key).orderBy("ordinal"))
    named = F.when(F.col("table_id").endswith("box-score-home"), "home").when(F.col("table_id").endswith("box-score-visitor"), "away")
    sided = found.withColumn("side", F.coalesce(named, F.when(order == 1, "home").when(order == 2, "away"))).where("side is not null")
    rows = by_header(canonical_headers(sided))
    return rows.withColumn("player_name", S.blank_to_null(F.col("values")["Player"])).where("player_name is not null")


def box_stats(rows: DataFrame) -> DataFrame:
    """Player rows with typed columns; the shooting percentages follow from them."""
    v = F.col("values")
    ints = {"points": "PTS", "rebounds": "TRB", "offensive_rebounds": "ORB", "defensive_rebounds": "DRB", "assists": "AST", "steals": "STL", "blocks": "BLK", "turnovers": "TOV", "fg_made": "FG", "fg_attempted": "FGA"}
    ints |= {"fg3_made": "3P", "fg3_attempted": "3PA", "ft_made": "FT", "ft_attempted": "FTA", "personal_fouls": "PF", "games_started": "GS"}
    out = rows.withColumns({c: S.to_int(v[k]) for c, k in ints.items()} | {"minutes": S.first_value(v["MP"], v["Min"]), "plus_minus": S.to_float(v["+/-"])})
    efg = S.effective_fg(F.col("fg_made"), F.col("fg_attempted"), F.col("fg3_made"))
    return out.withColumn("efg_pct", efg).withColumn("ts_pct", S.true_shooting(F.col("points"), F.col("fg_attempted"), F.col("ft_attempted"))).drop("values")


def fetch_days(season: int, spark) -> DataFrame:
    """The days of a season on which a day page is to be fetched: October to June."""
    first, last = S.season_range(F.lit(season))
    return spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))


def urls(base: str, teams: DataFrame, season: int) -> DataFrame:
    """Schedule and team page of each team (``slug``) under ``base``, as the fetcher's list."""
    page = lambda kind: F.format_string(f"%s/teams/%s/{season}{kind}.html", F.lit(base), F.col("slug"))
    return teams.select("slug", page("").alias("team_url"), page("-schedule").alias("schedule_url"))
