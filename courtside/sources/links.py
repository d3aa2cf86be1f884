"""Following links over landed pages: from seeds to all that they lead to, and from a league's page to players' logs.

Pages are landed by a fetcher; a page that isn't landed is where a chain ends, and what the fetcher has to get next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions import scalars as S
from courtside.sources import html_tables
from courtside.written import Written


def absolute(base: str | Column, href: str | Column) -> Column:
    """A link as a full address: of another host, from the host's root, or beside the page that has it."""
    base, href = (F.col(c) if isinstance(c, str) else c for c in (base, href))
    host = F.regexp_extract(base, r"^(\w+://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(\w+://[^/]*(?:/.*(?=/))?)", 1)
    scheme = F.regexp_extract(base, r"^(\w+:)", 1)
    return F.when(href.rlike(r"^\w+://"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(host, href)).otherwise(F.concat(folder, F.lit("/"), href))


def links(pages: DataFrame) -> DataFrame:
    """``url, n, text, href``: every link of ``pages(url, html)`` in its order, its text in single spaces, its address
    full; links without an address, and to a place in the page itself, are left out."""
    found = pages.where("url is not null").select("url", F.posexplode(html_tables.anchors("html")).alias("n", "a"))
    href = F.trim(F.col("a.href"))
    return found.where(href.isNotNull() & (href != "") & ~F.startswith(href, F.lit("#"))).select("url", "n", F.col("a.text").alias("text"), absolute("url", F.regexp_replace(href, "#.*$", "")).alias("href"))


def reached(pages: DataFrame, seeds: DataFrame, matching: str = "") -> DataFrame:
    """``url, depth, landed``: all pages that ``seeds(url)`` lead to, with the least number of links to each.

    A frontier of addresses meets the links of the pages landed, and what it leads to is the next one, without
    addresses that were met before, so cycles end. Links are read from the pages once and kept; a round moves addresses
    only. ``matching`` is a pattern that followed addresses fit. Rounds are as many as the farthest page is links away.
    """
    written = Written(pages.sparkSession, "links")
    edges = links(pages).select("url", "href")
    edges = written.save((edges.where(F.col("href").rlike(matching)) if matching else edges).distinct())
    there = written.save(pages.select("url").where("url is not null").distinct())
    frontier = written.save(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    met, depth = frontier, 0
    while frontier.head(1):
        depth += 1
        onward = frontier.select("url").join(edges, "url").select(F.col("href").alias("url")).distinct()
        frontier = written.save(onward.join(met.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        met = written.save(met.union(frontier))
    return met.join(there.withColumn("here", F.lit(True)), "url", "left").select("url", "depth", F.coalesce("here", F.lit(False)).alias("landed"))


def first_link(asked: DataFrame, found: DataFrame, page: str, text: str, name: str) -> DataFrame:
    """``asked`` with ``name``: the address of the first link on the page ``page`` whose text is ``text`` but for case;
    rows without one fall away."""
    named = found.groupBy(F.col("url").alias("__url"), F.lower("text").alias("__text")).agg(F.min_by("href", "n").alias(name))
    return asked.join(named, (F.col(page) == F.col("__url")) & (F.lower(F.trim(text)) == F.col("__text"))).drop("__url", "__text")


def player_logs(pages: DataFrame, wanted: DataFrame, leagues: DataFrame) -> DataFrame:
    """Game-log rows of ``wanted(player_name, team_name)``, found by links: league page, team, roster, player, log.

    ``leagues(rank, league_url)`` are the pages of teams to look in; of several that lead to the player the one of least
    rank counts. A team's roster lies under its page's address, a player's log beside the summary. Returns ``player_name,
    team_name, log_url`` and ``values`` under canonical names, a row a game. Whoever isn't found, or whose log isn't
    landed, has no row.
    """
    written = Written(pages.sparkSession, "logs")
    found = written.save(links(pages).where("text <> ''"))
    teams = wanted.select("team_name").distinct().join(F.broadcast(leagues.select("rank", "league_url")))  # a handful of leagues
    teams = first_link(teams, found, "league_url", "team_name", "team_url").withColumn("roster_url", F.concat(F.regexp_replace("team_url", "/+$", ""), F.lit("/Rosters")))
    asked = first_link(wanted.select("player_name", "team_name").distinct().join(teams.select("team_name", "rank", "roster_url"), "team_name"), found, "roster_url", "player_name", "player_url")
    logs = asked.groupBy("player_name", "team_name").agg(F.min_by(html_tables.game_log_url(F.col("player_url")), "rank").alias("log_url"))
    landed = pages.select("url", "html").join(logs.select(F.col("log_url").alias("url")).distinct(), "url", "left_semi")
    rows = html_tables.game_logs(landed).select(F.col("url").alias("log_url"), "row", "values")
    return logs.join(rows, "log_url").select("player_name", "team_name", "log_url", "row", "values")


def typed_logs(rows: DataFrame) -> DataFrame:
    """Game-log rows with a date, minutes and numbers as columns."""
    v = F.col("values")
    return rows.select("player_name", "team_name", v["Date"].alias("date"), S.blank_to_null(v["MP"]).alias("minutes"), S.to_int(v["PTS"]).alias("points"), S.to_int(v["TOV"]).alias("turnovers"))
