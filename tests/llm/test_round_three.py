"""Centroid clustering, fill-in-middle and WARC archives against plain versions, and their promised edge cases."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside.llm import balls, middle, mixing, simhash, warc, wrappers

# --- 11 balls ---------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<double>, label int"


def plain_clusters(rows, clusters=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[math.floor(Fraction(sum(x), len(groups[k]))) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def clustered(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VEC).withColumns({"cluster": F.lit("x"), "v": F.lit(1), "points": F.lit(2)})
    got, centroids = balls.cluster(df.repartition(3), **kw)
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in got.collect()), centroids.tolist()


@pytest.mark.parametrize("spread", [0.002, 0.3])
def test_clusters_against_plain(spark, monkeypatch, spread):
    monkeypatch.setattr(balls.trees, "__defaults__", (70,))
    rng = np.random.default_rng(5)
    homes = rng.normal(size=(6, 64))
    rows = [(i, (homes[i % 6] + spread * rng.normal(size=64)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)] + [rows[3], rows[3]]  # copies, and repeated rows
    rows += [(None, rows[1][1]), (None, rows[2][1]), (2000, None), (2001, [0.0] * 64), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [math.nan] * 64), (2005, [math.inf] + [0.0] * 63), (2006, []), (2007, [-1 / 512] * 64)]
    want, centroids = plain_clusters(rows)
    got = clustered(spark, rows)
    assert got == (sorted((i if i is not None else -1, c, d) for i, c, d in want), centroids)


def test_clusters_of_few_equal_or_no_vectors(spark):
    one = [(7, [0.5] * 64), (8, [0.5] * 64), (9, [-0.5] * 64)]
    assert clustered(spark, one) == (sorted(plain_clusters(one)[0]), plain_clusters(one)[1])
    df = spark.createDataFrame([], VEC)
    assert balls.report(df).collect() == [] and balls.cluster(df)[1].size == 0
    assert set(balls.report(df).columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}


def test_ties_go_to_the_smaller_number(spark):
    """Vectors midway between centroids, and whole balls of them."""
    rows = [(i, [float(x)] + [0.0] * 63) for i, x in enumerate([0, 2, 1, 1, 1, 1, 4, 3, 3])]
    got = clustered(spark, rows, clusters=3, rounds=0)[0]
    assert got == sorted(plain_clusters(rows, 3, 0)[0])


def test_components_too_large_for_exact_doubles_or_longs(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-5e5, 5e5) for _ in range(64)]) for i in range(50)]
    assert clustered(spark, rows, clusters=5) == (sorted(plain_clusters(rows, 5)[0]), plain_clusters(rows, 5)[1])
    with pytest.raises(Exception, match="don't fit in a long"):
        clustered(spark, [(1, [2.0**19] + [0.0] * 63)])


def test_balls_are_assigned_whole():
    rng = np.random.default_rng(1)
    homes = rng.normal(size=(5, 64)) * 1000
    points = np.floor(np.repeat(homes, 200, axis=0) + rng.normal(size=(1000, 64))).astype(np.int64)
    order, tree = balls.grown(points)
    assert sorted(order) == list(range(1000))
    for lo, hi, r, c, s in zip(tree["starts"], tree["ends"], tree["radii"], tree["centres"], tree["sums"]):
        mine = points[order[lo:hi]]
        assert (s == mine.sum(axis=0)).all() and np.sqrt(((mine - c) ** 2).sum(axis=1)).max() <= r + 1e-9
    parts = list(balls.assigned(tree, points[order], np.floor(homes).astype(np.int64)))
    # halves are cut at medians: each of the four boundaries between groups lies in one leaf
    assert sum(hi - lo for lo, hi, one, more in parts if one is not None) >= 1000 - 4 * balls.LEAF_ROWS
    assert sorted(x for lo, hi, *_ in parts for x in range(lo, hi)) == list(range(1000))


# --- 12 middle --------------------------------------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, d = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def test_middle_against_plain(spark):
    rng = random.Random(4)
    pieces = ["a", "\n", "\n\n", "\r\n", "\r", "é", "\U0001f600", "\x1e", "\x1b", "\x1bd", "\x1be", "\x1b\x1e", "<P", ">", "<S", "<M", "$0", "\\", " ", "word\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(300)]
    texts += [None, "", "\n", "one", "x\n<P>\n", "<S>", "a<M>b", "\x85line sep\n\x0b", "line\n" * 20_000, "long " * 100_000]
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "form": F.lit(1), "units": F.lit(2), "h": F.lit(3)})
    out = middle.digests(df)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(map(tuple, out.collect())) == Counter(plain_middle(*r) for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert middle.digests(df.limit(0)).count() == 0


def test_middle_parts_and_rates(spark):
    df = spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(400)], "doc_id long, text string")
    rows = middle.fill_in_middle(df, rate=30, suffix_first=10).collect()
    assert all(r.output == r.text and r.prefix is None for r in rows if r.form == "plain")
    assert all(r.prefix + r.middle + r.suffix == r.text for r in rows if r.form != "plain")
    forms = Counter(r.form for r in rows)
    assert 80 < forms["psm"] + forms["spm"] < 160 and forms["spm"] < forms["psm"]
    words = middle.fill_in_middle(df, unit=r"\s*\S+\s*").first()  # other units
    assert words.n == 3 and words.prefix + words.middle + words.suffix == words.text


# --- 13 warc ----------------------------------------------------------------------------------------


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({"digest": F.lit("x"), "shard": F.lit(1), "record": F.lit(2), "first": F.lit(3), "payload": F.lit(4), "refers_to": F.lit(5), "salt": F.lit(6)})


def plain_warc(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = least.get(h or "")
        again = len(b) >= 100 and first is not None and first != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


ODD = ["http://a.example/x", None, "", "http://a.example/a b\r\nWARC-Type: x", "http://é.example/ü?q=%20", "x: y", "\x00"]


def some_pages():
    rng = random.Random(8)
    rows = [(rng.randrange(10**6), rng.choice(ODD), "".join(rng.choices("abc \r\n<é", k=rng.randrange(300)))) for _ in range(200)]
    same = "copy \r\n\r\nWARC/1.1\r\n" * 30
    rows += [(5000 + i, f"http://h/{i}", same) for i in range(150)] + [(-3, "http://h/first", same), (None, "u", same), (None, "u", "é" * 50), (None, "u", "é" * 50)]
    return rows + [(1, "u", None), (2, "u", ""), (3, "u", "x" * 99), (4, "u", "x" * 99), (6, "u", "y" * 100), (9, "u", "y" * 100), (9, "u", "y" * 100), (6, "v", "y" * 100), (10, "u", "long " * 60_000)]


def same(a, b):
    return Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_archive_round_trip(spark, tmp_path):
    rows = some_pages()
    df = pages(spark, rows)
    assert same(warc.round_trip(df).collect(), plain_warc(rows))
    folders = [f"file://{tmp_path}/{k}" for k in "ab"]
    manifest = warc.write(df, folders[0], "2001-02-03T04:05:06Z", shard_bytes=20_000, roll_bytes=3_000)
    warc.write(df.repartition(7), folders[1], "2001-02-03T04:05:06Z", shard_bytes=20_000, roll_bytes=3_000)
    files = {p.name: p.read_bytes() for p in Path(f"{tmp_path}/a").glob("*.gz")}
    assert files == {p.name: p.read_bytes() for p in Path(f"{tmp_path}/b").glob("*.gz")}  # the same bytes however pages lie
    m = manifest.collect()
    assert len({r["shard"] for r in m}) > 5 and max(r["roll"] for r in m) >= 1 and sum(r["records"] for r in m) == len(rows)
    assert {r["name"]: (r["bytes"], r["sha256"]) for r in m} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items()}
    assert not Path(f"{tmp_path}/a/_temporary").exists()
    back = warc.read(spark, folders[0]).collect()
    full = {h or "" for _, _, h in rows}
    assert same([(r.page_id, r.url, r.payload_digest) for r in back], [(i, u, hashlib.sha256((h or "").encode()).hexdigest()) for i, u, h in rows])
    assert {bytes(r.payload).decode() for r in back if r.record_type == "response"} == full and all(r.payload is None for r in back if r.record_type == "revisit")
    ids = [r.page_id for n in sorted(files) for r in map(lambda x: type("R", (), x), filter(None, map(warc.parsed, warc.members(files[n])))) if r.page_id is not None]
    assert ids == sorted(ids)  # range-sorted through all files
    text = gzip.decompress(files[sorted(files)[0]])
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"WARC-Date: 2001-02-03T04:05:06Z" in text


def test_archive_of_no_page_and_without_a_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    assert warc.write(pages(spark, []), folder, "d").count() == 0 and warc.read(spark, folder).count() == 0
    assert warc.round_trip(pages(spark, [])).columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = some_pages()[:20]
    folder = f"file://{tmp_path}/f"
    warc.write(pages(spark, rows), folder, "d")
    (Path(tmp_path) / "f" / "part-99999-00000.warc.gz").write_bytes(b"left by a writer that died")
    assert warc.read(spark, folder).count() == 20  # only what the manifest names
    name = next(p for p in (Path(tmp_path) / "f").glob("part-00000-*.gz"))
    name.write_bytes(name.read_bytes()[:-9] + b"123456789")
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.read(spark, folder).count()


def test_revisits_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_IDS", 0)
    rows = some_pages()
    assert same(warc.round_trip(pages(spark, rows)).collect(), plain_warc(rows))


# --- stages of the pipeline -------------------------------------------------------------------------

CLASHING = {c: 11 for c in ("_t1", "_t2", "t1", "t2", "row", "rows", "plan", "times", "stays", "size", "n", "k", "slot", "__h1", "taken")}


def test_keep_one_keeps_columns_of_any_name(spark):
    rng = random.Random(12)
    base = [" ".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base + [base[0], base[1] + " tail", None, "", " "])] + [(None, "alone one two three four five"), (None, base[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in CLASHING.items()})
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    got = out.collect()
    assert all(r[c] == 11 for r in got for c in CLASHING)
    assert sorted((r.doc_id for r in got), key=str) == sorted([0, 1, 2, 3, 4, 5, 8, None, None], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_mixed_meets_its_targets_without_ids(spark):
    """Half of the documents without an id, a few rows repeated: the mix has what each source's target says."""
    rng = random.Random(13)
    rows = [(i if i % 2 else None, f"text {i} " + " ".join(["w"] * rng.randint(10, 90)), "abc"[min(2, rng.randrange(6))]) for i in range(1200)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(v) for c, v in CLASHING.items()})
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got, words = Counter(), Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
        got[r.text] += 1
        assert r.slot == 11
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = {"a": 0.0, "b": 0.0, "c": 0.0}
    known, _ = mixing.schedule(df)
    for r in known.select("source", "target").distinct().collect():
        want[r.source] = r.target
    for s in want:
        assert abs(words[s] - want[s]) <= 0.02 * want[s], (s, words[s], want[s])
    times = Counter(t for _, t, _ in rows)
    assert all(n <= 2 * times[t] for t, n in got.items())
    assert Counter(r.text for r in mixing.mixed(df.repartition(5)).collect()) == got


# --- 6 wrappers -------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 60])
@pytest.mark.parametrize("zone", ["article", "main", "div"])
def test_headings_stay_however_many_pages_have_them(spark, n, zone):
    rows = [(k, f"http://r.example/{k}", f"<body><div class=top><p>Kitchen of all</p></div><{zone}><h1>Dish {k}</h1><h2>Ingredients</h2><ul><li>{k} eggs</li><li>salt {k}</li></ul><h2>Method</h2><p>Stir {k} times</p></{zone}></body>") for k in range(n)]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    top = "Kitchen of all\n" if zone == "div" and n < 3 else ""  # nothing tells the template of fewer pages
    assert got == {k: f"{top}Dish {k}\nIngredients\n{k} eggs\nsalt {k}\nMethod\nStir {k} times" for k in range(n)}


def test_furniture_within_articles(spark):
    gone = ["<div class='ad-slot-1'>A</div>", "<ins class=adsbygoogle><p>A</p></ins>", "<div class=post-comments>A</div>", "<div class=user-comments>A</div>", "<div id=respond>A</div>", "<div class=gdpr>A</div>", "<div class=related-articles>A</div>", "<div hidden>A</div>", "<div style='color:red; display: none'>A</div>"]
    inline = "<p>one <span class=advert>A <span>B</span> C</span>two <b class=x>three</b></p>"
    stay = ["<p class=alert>Mind the step</p>", "<p class=main-menu>Soup and fish</p>", "<div class='overflow-hidden' data-x='hidden'>seen</div>"]
    html = "<article>" + inline + "".join(gone) + "".join(stay) + "<p>left <i class=ad>open</p><p>end</p></article>"
    out = wrappers.main_texts(spark.createDataFrame([(1, "http://h/1", html)], "page_id long, url string, html string")).first()
    assert out.text == "one two three\nMind the step\nSoup and fish\nseen\nleft\nend"


def test_bars_of_links_in_articles_go_by_the_wrapper(spark):
    """A bar that no name tells is known by its host: the same links on every page. Without the wrapper it stays."""
    page = "<article><div class=x><a href=/>Home</a> <a href=/b>More</a></div><h1>Title {0}</h1><p>Text {0} with <a href=/{0}>a link {0}</a></p><p><a href=/s>Source {0}</a></p></article>"
    rows = [(k, f"http://b.example/{k}", page.format(k)) for k in range(5)]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nText {k} with a link {k}\nSource {k}" for k in range(5)}
    alone = wrappers.main_text(rows[0][2], wrappers.labelled(wrappers.tree(rows[0][2]))[0], set())
    assert alone.startswith("Home More\n")
