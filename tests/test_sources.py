import datetime
import json
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from courtside.sources import html_tables, json_games, reports
from courtside.streaming import capture

SCHEDULE = """<table id="blue-ELG-regular-season"><thead><tr><th>Date</th></tr></thead><tbody>
<tr class="thead"><th>x</th></tr>
<tr><td data-stat="date_game_full"><a href="/boxscores/1.html">Sun, Nov 23, 2025</a></td><td data-stat="opp_name_link"><a href="/teams/red/2026.html">Red</a></td><td data-stat="game_location">@</td><td data-stat="pts">80</td><td data-stat="opp_pts"></td></tr>
<tr><td data-stat="date_game_full"></td><td data-stat="opp_name_link">Nobody</td></tr>
</tbody></table>"""
BOX = """<html><!-- <table id="x-box-score-home"><thead><tr><th>Player</th><th>MIN</th><th>PTS</th></tr></thead><tbody><tr><th>Ana</th><td>30:00</td><td>22</td><td>9</td></tr><tr><td></td><td>1</td></tr></tbody></table>
<table id="x-box-score-visitor"><thead><tr><th>Player</th><th>MIN</th><th>PTS</th></tr></thead><tr><td>Bea</td><td>28:00</td><td>n/a</td></tr></table> --></html>"""
STANDINGS = '<table id="a"><tr><td data-stat="team">No</td></tr></table><table id="acb_standings"><tbody><tr><td data-stat="team|p1">Red</td><td data-stat="wins|p1">3</td><td data-stat="wins|p2">9</td></tr></tbody></table>'


def test_schedule(spark):
    rows = html_tables.schedule(spark.createDataFrame([("blue", SCHEDULE), ("none", None), ("empty", "<table>")], "team string, html string")).collect()
    assert [tuple(r) for r in rows] == [("blue", "Sun, Nov 23, 2025", "Red", "red", "/boxscores/1.html", False, 80, None, None, "euroleague")]


def test_box_scores_in_comments(spark):
    rows = html_tables.box_stats(html_tables.box_scores(spark.createDataFrame([(1, BOX)], "game long, html string"), "game")).collect()
    assert {(r.side, r.player_name, r.minutes, r.points) for r in rows} == {("home", "Ana", "30:00", 22), ("away", "Bea", "28:00", None)}


def test_standings_and_rosters(spark):
    row = html_tables.standings(spark.createDataFrame([("acb", STANDINGS)], "league string, html string"), "league").first()
    assert row["values"] == {"team": "Red", "wins": "3"}
    page = '<table><caption>Per Game stats</caption><thead><tr><th>Player</th><th>Pos</th></tr></thead><tr><td>Ana</td><td>G</td><td>more</td></tr></table>'
    assert html_tables.team_roster(spark.createDataFrame([("t", page)], "team string, html string")).first()["values"] == {"Player": "Ana", "Pos": "G", "col_2": "more"}


def test_day_schedule(spark):
    page = "<table><thead><tr><th>Away Team</th><th>Score</th><th>Home Team</th><th>Venue</th></tr></thead><tr><td>Blue</td><td>80 - 71</td><td>Red</td><td>Hall</td></tr><tr><td>A</td><td></td><td>B</td></tr></table>"
    df = spark.createDataFrame([("2025-11-23", "acb", page)], "date string, league string, html string")
    assert tuple(html_tables.day_schedule(df, "Red").first()) == ("2025-11-23", "Blue", True, 71, 80, "acb")
    assert html_tables.fetch_days(2025, spark).count() == 273


def test_player_pages_and_links(spark):
    page = '<div id="meta"><p>Ana <b>Luz</b></p></div><table id="per_game"><thead><tr><th>Season</th><th>PTS</th></tr></thead><tr><td>2025</td><td>9</td></tr></table><a href="/x">Other</a><a href="/p/Summary/1">ana  luz</a>'
    df = spark.createDataFrame([("p", page)], "player string, html string")
    row = html_tables.player_pages(df).first()
    assert row.meta == "Ana Luz" and row["values"] == {"Season": "2025", "PTS": "9"}
    assert df.select(html_tables.game_log_url(html_tables.link_to("html", F.lit("Ana Luz"))).alias("u")).first().u == "/p/GameLogs/1"
    logs = "<table><thead><tr><th>Date</th><th>MIN</th><th>PTS</th></tr></thead><tr><td>11/23</td><td>30</td><td>22</td></tr><tr><td></td><td></td><td>99</td></tr></table>"
    assert [r["values"] for r in html_tables.game_logs(spark.createDataFrame([("p", logs)], "player string, html string")).collect()] == [{"Date": "11/23", "MP": "30", "PTS": "22"}]


def test_service_json(spark):
    items = [{"fecha": "2025-11-23", "local": {"nombre": " Blue "}, "awayTeam": "Red", "homeScore": 80, "visitanteScore": "71", "competition": "Copa del Rey"}, {"date": "x", "home": "A"}, {"gameDate": "d", "home": "Red", "away": {"name": "blue"}}]
    for body in (items, {"data": items}):
        rows = json_games.service_games(spark.createDataFrame([(json.dumps(body),)], "body string"), "BLUE").collect()
        assert [tuple(r) for r in rows] == [("2025-11-23", "Red", True, 80, 71, "copa-del-rey"), ("d", "Red", False, None, None, "acb")]


def test_cms_json(spark):
    named = lambda n: {"data": {"attributes": {"name": n}}}
    games = {"data": [{"attributes": {"gameDate": "2025-11-23T18:00:00Z", "homeScore": 1, "awayScore": 2, "homeTeam": named("Red"), "awayTeam": named("Blue"), "competition": named("Liga Endesa")}}, {"attributes": {"gameDate": "2025-11-24", "homeTeam": {"data": None}, "awayTeam": named("Blue")}}]}
    df = spark.createDataFrame([(json.dumps(games),)], "body string")
    assert [tuple(r) for r in json_games.cms_games(df, "Blue").collect()] == [("Sun, Nov 23, 2025", "Red", False, 2, 1, "acb")]
    assert json_games.cms_games(df, "Blue", first="2025-11-24").count() == 0
    roster = {"data": [{"attributes": {"name": " Ana ", "lastName": "Luz", "dorsal": 7, "photo": {"data": {"attributes": {"url": "/full.jpg", "formats": {"small": {"url": "/s.jpg"}}}}}}}, {"attributes": {"name": " ", "lastName": None}}]}
    row = json_games.cms_roster(spark.createDataFrame([(json.dumps(roster),)], "body string"), "https://m.example").collect()
    assert [tuple(r) for r in row] == [("Ana Luz", None, "7", "https://m.example/s.jpg")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 0.123456, None)], "b int, a double, c double, d string")
    assert reports.canonical(df).first().json == '{"a":null,"b":1,"c":0.1235,"d":null}'
    assert reports.version_tag(df).first().etag != reports.version_tag(df.withColumn("b", F.lit(2))).first().etag
    form = spark.createDataFrame([(1, "Ana", 3, 30.0, 22.0, None, 0.5223, 0.6)], "team_id long, player_name string, games long, avg_minutes double, avg_pts double, avg_pts_per36 double, avg_efg_pct double, avg_ts_pct double")
    lines = reports.form_lines(form)
    assert lines.first().line == "Ana" + " " * 21 + "   3    30.0    22.0       -    52.2    60.0"
    more = reports.form_lines(form.union(form.withColumns({"player_name": F.lit("Bea"), "avg_pts": F.lit(30.0)})))
    reports.write_text(more, f"file://{tmp_path}/out")
    (file,) = (tmp_path / "out" / "team_id=1").glob("part-*")
    assert [x[:3] for x in file.read_text().splitlines()] == ["Bea", "Ana"]


def test_streaming_capture_is_idempotent(spark, tmp_path):
    src, table, mark = (f"file://{tmp_path}/{x}" for x in ("src", "table", "mark"))
    schema = "game_id long, player string, ord long"
    spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 3)], schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: capture.capture(capture.landed(spark, src, schema), table, ["game_id", "player"], "ord", mark).awaitTermination()
    run()
    spark.createDataFrame([(2, "b", 9), (3, "c", 10)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    rows = spark.read.parquet(table).select("game_id", "player", "ord").collect()
    assert sorted(map(tuple, rows)) == [(1, "a", 1), (2, "b", 3), (3, "c", 10)]
    again = capture.append_new(table, ["game_id", "player"], "ord")
    again(spark.createDataFrame([(2, "b", 9), (3, "c", 10)], schema), 1)
    assert spark.read.parquet(table).count() == 3


def test_streaming_jobs_and_windows(spark, tmp_path):
    src, table, mark = (f"file://{tmp_path}/{x}" for x in ("src", "table", "mark"))
    at = datetime.datetime(2026, 1, 1)
    spark.createDataFrame([(1, 1, 5, at), (2, 1, 5, at), (3, 2, 5, at)], capture.JOB_SCHEMA).coalesce(1).write.parquet(src)
    work = lambda j: j.select("id", F.when(F.col("team_id") == 2, "boom").alias("error"), F.current_timestamp().alias("finished_at"))
    capture.work_jobs(capture.landed(spark, src, capture.JOB_SCHEMA), table, mark, work).awaitTermination()
    assert {(r.id, r.status) for r in spark.read.parquet(table).collect()} == {(1, "done"), (3, "failed")}
    rows = spark.createDataFrame([(at, 1, "Ana", "30:00"), (at + datetime.timedelta(days=1), 1, "Ana", "10:00"), (at, 1, "Ana", "")], "ts timestamp, team_id long, player_name string, minutes string")
    loads = {r.load_minutes for r in capture.windowed_load(rows, 2).collect()}
    assert loads == {30.0, 40.0, 10.0}


def test_report_lines_keep_long_names(spark):
    form = spark.createDataFrame([(1, "A player of a very long name, " + x, 2, 10.0, 8.0, 20.0, 0.5, 0.5) for x in ("Ana", "Bea")] + [(1, "Eva", 2, 10.0, 7.0, 20.0, 0.5, 0.5)], "team_id long, player_name string, games long, avg_minutes double, avg_pts double, avg_pts_per36 double, avg_efg_pct double, avg_ts_pct double")
    lines = [r.line for r in reports.form_lines(form).orderBy("place").collect()]
    assert [x.split("   2")[0] for x in lines] == ["A player of a very long name, Ana", "A player of a very long name, Bea", "Eva".ljust(24)]
    summary = spark.createDataFrame([(1, 70.0, 100.0, 90.0, 10.0, 0.5, 0.5)], "team_id long, avg_pace double, avg_off_rating double, avg_def_rating double, avg_net_rating double, avg_efg_pct double, avg_ts_pct double")
    team = spark.createDataFrame([(1, "A team of a very long name")], "id long, name string")
    assert reports.summary_lines(summary, team).first().line.startswith("A team of a very long name  Pace ")


def test_service_lists_with_items_that_are_no_games(spark):
    body = '[1, "x", null, [2], {}, {"fecha": "2024-01-02", "local": {"teamName": "A"}, "awayTeam": "B", "homeScore": "80", "visitanteScore": 7}, {"fecha": "2024-01-03", "local": "{broken", "awayTeam": "A"}, {"fecha": "", "date": null, "home": "A", "away": "B"}]'
    df = spark.createDataFrame([(body, 1), (None, 2), ("", 3), ("not json", 4), ('{"data": []}', 5)], "body string, note int")
    got = json_games.service_games(df, "a").collect()
    assert [(r.note, r.date, r.opponent, r.is_home, r.points, r.opp_points, r.league) for r in got] == [(1, "2024-01-02", "B", True, 80, 7, "acb")]


def test_pages_are_parsed_alike_by_pattern_and_parser(monkeypatch):
    rng = random.Random(1)
    bits = '<table id="a">|<TABLE>|</table>|<tr class="thead">|</tr>|<td data-stat="x">|</td>|<th>|</th>|<a href="/q">|</a>|<thead>|</thead>|<caption>|text| & |&lt;b|\n|<!-- <table><tr><td>h</td></tr></table> -->|<br>|<!-- x -- y -->|<!-->|<script>a<b</script>|<|>|<p x=1>|é|<td\n class="u" >|<br/>'.split("|")
    pages = ["".join(rng.choice(bits[: 20 if n % 2 else None]) for _ in range(rng.randint(0, 25))) for n in range(3000)]
    fast = [(html_tables.parse(p), html_tables.parse_links(p)) for p in pages]
    assert sum(bool(html_tables._PLAIN.fullmatch(p)) for p in pages) > 1000
    monkeypatch.setattr(html_tables, "_PLAIN", re.compile("(?!)"))
    assert fast == [(html_tables.parse(p), html_tables.parse_links(p)) for p in pages]


def test_parsed_pages_are_given_back_in_portions():
    page = "<table>" + "<tr><td>1</td><td>2</td></tr>" * 1000 + "</table>"
    parts = list(html_tables._tables(iter([pa.array([page, None] * 100)])))
    assert sum(map(len, parts)) == 200 and len(parts) > 10
    assert max(len(p.flatten().field("rows").flatten()) for p in parts) <= html_tables.PORTION
    assert parts[0].to_pylist()[:2] == [html_tables.parse(page), []]


def test_headers_that_are_one_under_their_canonical_name(spark):
    page = "<table><thead><tr><th>Date</th><th>MIN</th><th>MP</th><th>PTS</th></tr></thead><tr><td>d</td><td>1</td><td>2</td><td>3</td></tr><tr><td>e</td><td>4</td></tr></table>"
    rows = html_tables.game_logs(spark.createDataFrame([("p", page)], "player string, html string")).collect()
    assert [r["values"] for r in rows] == [{"Date": "d", "MP": "2", "PTS": "3"}, {"Date": "e", "MP": "4"}]


def test_rows_of_bare_cells_are_read_whole(monkeypatch):
    """A page's handlers are called by row, not by cell; what they find is what the parser finds."""
    rng, calls = random.Random(2), []
    bits = ["<table>", '<table id="b">', "</table>", "<thead>", "</thead>", "<caption>", "</caption>", "<tr>", "<td>", "<tr><td>a</td><td> b\n c</td></tr>", "<tr><th>h</th><th></th></tr>", "<tr><td>&lt;</td></tr>", "<tr><td></td></tr>", "<tr><th></th></tr>", "<tr><td>a</td><td>b", "<TR><TD>u</TD></TR>", '<td data-stat="s">v</td>', "<td>w</th>", '<a href="/q">', "x", "<!-- <table><tr><td>h</td></tr></table> -->", "<tr><td>1</td><th>2</th></tr>"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 15))) for _ in range(3000)]
    table = "<table><thead><tr><th>A</th><th>B</th></tr></thead>" + "<tr><td>1</td><td>2</td></tr>" * 500 + "</table>"
    start = html_tables._Tables.handle_starttag
    with monkeypatch.context() as m:
        m.setattr(html_tables._Tables, "handle_starttag", lambda self, *a: calls.append(a) or start(self, *a))
        assert len(html_tables.parse(f"<!-- {table} -->")[0]["rows"]) == 501
    assert len(calls) < 10
    fast = [(html_tables.parse(p), html_tables.parse_links(p)) for p in pages]
    arrow = pa.concat_arrays(list(html_tables._tables(iter([pa.array(pages)])))).to_pylist()
    monkeypatch.setattr(html_tables, "_PLAIN", re.compile("(?!)"))
    assert fast == [(html_tables.parse(p), html_tables.parse_links(p)) for p in pages] and arrow == [f[0] for f in fast]
