"""Chains of links over landed pages, and differences of dumps."""

import json
from pathlib import Path

from courtside.sources import dumps, links

H = "https://h.example"


def page(url, *anchors, more=""):
    return (url, "<html>" + "".join(f'<p><a href="{h}">{t}</a>' for t, h in anchors) + more + "</html>")


def test_addresses(spark):
    rows = [("https://a/b/c?x=/y", h) for h in ("https://o/p", "//o/p", "/p", "p", "p/q")] + [("https://a", "p"), ("https://a/", "p")]
    got = [r[0] for r in spark.createDataFrame(rows, "base string, href string").select(links.absolute("base", "href")).collect()]
    assert got == ["https://o/p", "https://o/p", "https://a/p", "https://a/b/p", "https://a/b/p/q", "https://a/p", "https://a/p"]


def test_reached_pages_with_a_cycle_and_a_dead_end(spark):
    rows = [page(f"{H}/a", ("b", "/b"), ("c", "c"), ("self", "/a#x"), ("x", "#y")), page(f"{H}/b", ("c", f"{H}/c"), ("gone", "/gone")), page(f"{H}/c", ("a", "/a"), ("d", "/d")), page(f"{H}/d", ("far", "https://far.example/")), page(f"{H}/alone", ("a", "/a")), (None, "x"), (f"{H}/e", None)]
    pages = spark.createDataFrame(rows, "url string, html string")
    seeds = spark.createDataFrame([(f"{H}/a",), (None,)], "url string")
    got = {(r.url.removeprefix(H), r.depth, r.landed) for r in links.reached(pages, seeds).collect()}
    assert got == {("/a", 0, True), ("/b", 1, True), ("/c", 1, True), ("/gone", 2, False), ("/d", 2, True), ("https://far.example/", 3, False)}
    own = {r.url.removeprefix(H) for r in links.reached(pages, seeds, matching=f"^{H}/[abc]$").collect()}
    assert own == {"/a", "/b", "/c"}
    assert links.reached(pages.limit(0), seeds).count() == 1 and links.reached(pages, seeds.limit(0)).count() == 0


def test_player_logs_by_links(spark):
    log = "<table><thead><tr><th>Date</th><th>Opponent</th><th>MIN</th><th>PTS</th><th>TO</th></tr></thead>{}</table>"
    line = "<tr><td>2025-11-2{0}</td><td>Rio</td><td>1{0}:00</td><td>{0}</td><td></td></tr>"
    rows = [
        page(f"{H}/euro", ("Solar  City", "/team/1/sol/"), ("Luna", "/team/2/luna")),
        page(f"{H}/acb", ("SOLAR CITY", "/team/9/sol"), ("Rio", "/team/3/rio"), ("Rio", "/team/4/rio")),
        page(f"{H}/team/1/sol/Rosters", ("Ana", "/p/Ana/Summary/1"), ("Bea", "/p/Bea/Summary/2")),
        page(f"{H}/team/9/sol/Rosters", ("Ana", "/p/Ana/Summary/99"), ("Eva", "/p/Eva/Summary/5")),
        page(f"{H}/team/3/rio/Rosters", ("ana", "/p/Ana/Summary/3")),
        page(f"{H}/p/Ana/GameLogs/1", more=log.format(line.format(1) + line.format(2))),
        page(f"{H}/p/Ana/GameLogs/99", more=log.format(line.format(9))),
        page(f"{H}/p/Ana/GameLogs/3", more=log.format(line.format(3))),
        page(f"{H}/p/Eva/GameLogs/5", more=log.format(line.format(5))),
    ]
    wanted = spark.createDataFrame([("Ana", "solar city"), ("Bea", "Solar City"), ("Eva", "Solar City"), ("ANA", "Rio"), ("Ana", "Luna"), ("Zoe", "Nowhere"), (None, "Rio")], "player_name string, team_name string")
    leagues = spark.createDataFrame([(1, f"{H}/euro"), (2, f"{H}/acb")], "rank int, league_url string")
    got = links.typed_logs(links.player_logs(spark.createDataFrame(rows, "url string, html string"), wanted, leagues)).collect()
    assert {(r.player_name, r.team_name, r.minutes, r.points, r.turnovers) for r in got} == {("Ana", "solar city", "11:00", 1, None), ("Ana", "solar city", "12:00", 2, None), ("Eva", "Solar City", "15:00", 5, None), ("ANA", "Rio", "13:00", 3, None)}


def plain_leaves(v, path="$"):
    if isinstance(v, dict) and v:
        return {k: x for key, child in v.items() for k, x in plain_leaves(child, f"{path}.{key}").items()}
    if isinstance(v, list) and v:
        return {k: x for i, child in enumerate(v) for k, x in plain_leaves(child, f"{path}[{i}]").items()}
    return {path: v}


def test_differences_of_dumps(spark):
    base = {"a": {"x": 100.0, "y": [1, 2, {"z": None}], "e": [], "o": {}}, "n": "v", "t": True, "gone": [1, {"q": 2}], "s": 1, "zero": 0}
    now = {"a": {"x": 100.4, "y": [1, 2.2, {"z": None, "new": 1}], "e": [], "o": {}}, "n": "w", "t": 1, "s": "1", "zero": 0.1, "more": {"deep": {"er": [[3]]}}}
    frame = lambda **d: spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in d.items()], "name string, json string")
    flat = {r.path: json.loads(r.value) for r in dumps.flattened(frame(base=base)).collect()}
    assert flat == plain_leaves(base)
    out = {(r.name, r.path, r.change) for r in dumps.differences(frame(d=now, only=[7], odd="no json", void=None), frame(d=base, lost={"k": 1}, odd="no json", void=None)).collect()}
    assert out == {("d", "$.a.y[1]", "different"), ("d", "$.a.y[2].new", "added"), ("d", "$.n", "different"), ("d", "$.t", "different"), ("d", "$.s", "different"), ("d", "$.gone[0]", "gone"), ("d", "$.gone[1].q", "gone"), ("d", "$.more.deep.er[0][0]", "added"), ("only", "$[0]", "added"), ("lost", "$.k", "gone")}
    assert dumps.differences(frame(d=base), frame(d=base)).count() == 0 and dumps.differences(frame(d=base).limit(0), frame(d=base).limit(0)).count() == 0


def test_only_what_differs_is_opened(spark):
    """Documents and members that are the same are not written leaf by leaf, and depth is not bound to what one pass opens."""
    deep = lambda x: {"a": [{"b": {"c": [[{"d": {"e": [x]}}]]}}], "same": list(range(50))}
    frame = lambda rows: spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()], "name string, json string")
    base = {str(k): deep(k) for k in range(40)}
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    out = dumps.differences(frame(base | {"7": deep("x")}), frame(base))
    assert [tuple(r) for r in out.collect()] == [("7", "$.a[0].b.c[0][0].d.e[0]", "different", '"x"', "7")]
    written = [spark.read.parquet(str(p)).count() for folder in set(shared.iterdir()) - before for p in folder.iterdir()]
    assert written and sum(written) == len(written)  # one pair a pass
