"""Deliveries resolved row by row in a plain version, and as a set."""

import random

from pyspark.sql import functions as F

from courtside.operators import entities

TEAM = "id long, slug string, name string, league string"
ROW = "src_ord long, opponent string, opponent_slug string, league string"


def key(name):
    return name.lower().replace(" ", "").replace("-", "")


def one_by_one(rows, teams):
    """Rows (order, name, slug) in turn: the team of each, how the first row of each pair found it, and teams afterwards.

    A team is its id, or the row that made it."""
    teams = [dict(t) for t in teams]
    out, first = {}, {}
    for o, name, slug in sorted(set(rows)):
        if not name.strip():
            continue
        wanted, k = slug or key(name), key(name)
        team = next((t for t in teams if t["slug"] == wanted), None)
        how = "slug"
        if team is None and len(k) >= 4:
            team, how = next((t for t in teams if key(t["name"]) and (k in key(t["name"]) or key(t["name"]) in k)), None), "name"
            if team and slug:
                team["slug"] = slug
        if team is None:
            team, how = {"id": (o, name, slug), "slug": wanted, "name": name}, "new"
            teams.append(team)
        out[o, name, slug] = team["id"]
        first.setdefault((name, slug), (o, team["id"], how))
    return out, first, {t["id"]: (t["slug"], t["name"]) for t in teams}


def settled(spark, rows, teams):
    df = spark.createDataFrame([(*r, "acb") for r in rows], ROW)
    base = spark.createDataFrame([(t["id"], t["slug"], t["name"], "old") for t in teams], TEAM)
    resolved, every, found = entities.settle(df, base)
    resolved, found = resolved.collect(), found.collect()
    most = max((t["id"] for t in teams), default=0)
    made = {}  # a new team is first met by the row that makes it
    for r in resolved:
        if r.team_id > most:
            made[r.team_id] = min(made.get(r.team_id, (1 << 60,)), (r.src_ord, r.opponent, r.opponent_slug))
    assert sorted(made) == list(range(most + 1, most + 1 + len(made))) and [made[i] for i in sorted(made)] == sorted(made.values())
    named = lambda i: made.get(i, i)
    every = every.collect()
    assert all(r.league == ("acb" if r.id in made else "old") for r in every)
    return (
        {(r.src_ord, r.opponent, r.opponent_slug): named(r.team_id) for r in resolved},
        {(r.opponent, r.opponent_slug): (r.src_ord, named(r.team_id), r.found_by) for r in found},
        {named(r.id): (r.slug, r.name) for r in every},
    )


def test_three_spellings_are_one_team(spark):
    rows = [(1, "Rio Plata", ""), (2, "Rio Plata Basket", "rpl"), (3, "RIO-PLATA", ""), (4, "Sol", "sol"), (5, " ", "x")]
    teams = [{"id": 4, "slug": "sol", "name": "Solar City"}]
    got = settled(spark, rows, teams)
    assert got == one_by_one(rows, teams)
    assert got[2] == {4: ("sol", "Solar City"), (1, "Rio Plata", ""): ("rpl", "Rio Plata")}


def test_slugs_that_come_and_go(spark):
    """Two slugs in turn on one team, an old slug asked for after it has moved, and repeated rows of both."""
    teams = [{"id": 1, "slug": "a", "name": "Alpha"}, {"id": 2, "slug": "b", "name": "Beta Club"}]
    rows = [(1, "Alpha One", "s1"), (2, "Alpha", "s2"), (3, "Alpha One", "s1"), (4, "Alpha", "s2"), (5, "Beta Club", "a"), (6, "Beta", "a"), (7, "Alpha One", "a"), (8, "Gamma", "b"), (9, "Gamma", "s2"), (10, "Beta Club", "s2")]
    rows += [(10 + o, n, s) for o, n, s in rows]
    assert settled(spark, rows, teams) == one_by_one(rows, teams)


def test_a_thousand_random_deliveries(spark):
    """Each in an alphabet of its own, so that they don't meet and all are settled at once."""
    rng = random.Random(17)
    rows, teams, want = [], [], ({}, {}, {})
    for d in range(1000):
        letters = [chr(0x4E00 + 3 * d + k) for k in range(3)]

        def word(lo, hi, letters=letters):
            return "".join(rng.choices(letters, k=rng.randint(lo, hi)))

        slugs = sorted({word(1, 2) + "!" for _ in range(4)})
        own = [{"id": d * 1000 + k, "slug": s, "name": word(2, 6)} for k, s in enumerate(slugs[:2])]
        names_ = [word(3, 7) for _ in range(5)]
        mine = [(d * 100 + k, rng.choice(names_) + rng.choice(["", " ", "-"]), rng.choice([*slugs, *map(key, names_[:2]), "", "", ""])) for k in range(rng.randint(1, 16))]
        rows += mine
        teams += own
        for w, r in zip(want, one_by_one(mine, own)):
            w.update(r)
    got = settled(spark, rows, teams)
    assert got[2] == want[2] and got[1] == want[1] and got[0] == want[0]


def test_no_delivery(spark):
    assert settled(spark, [], [{"id": 1, "slug": "a", "name": "A"}]) == ({}, {}, {1: ("a", "A")})


def test_a_shared_word_makes_no_pairs(spark):
    """20,000 names with one word in common: what is compared grows with the names."""
    keys = spark.range(20_000).select(F.concat(F.lit("basketclub"), F.lpad(F.conv((F.col("id") * 7919 % 65_536).cast("string"), 10, 16), 6, "x")).alias("key"))
    out = entities.contained(keys, keys)
    assert out.count() == 20_000
    plan = out._jdf.queryExecution().executedPlan()
    joined = [m for m in plan.toString().split("\n") if "Join" in m]
    assert joined and not any("NestedLoop" in m or "Cartesian" in m for m in joined)
    short = spark.createDataFrame([("a",), ("ab",), ("xab",), ("abcd",), ("",), (None,)], "key string")
    assert {tuple(r) for r in entities.contained(short, short).collect()} == {("a", "a"), ("a", "ab"), ("a", "xab"), ("a", "abcd"), ("ab", "ab"), ("ab", "xab"), ("ab", "abcd"), ("xab", "xab"), ("abcd", "abcd")}
    seen = entities.candidates(keys, keys).count()
    assert seen < 20_000 * 40


def test_few_rows_take_their_rounds_without_a_shuffle(spark, monkeypatch):
    """Sixty random deliveries at once: equal to one by one, and no round deals its rows out, though the
    planner takes its joins for large."""
    rng, plans, save = random.Random(5), [], entities.Written.save
    rows, teams, want = [], [], ({}, {}, {})
    for d in range(60):
        letters = [chr(0x4E00 + 3 * d + k) for k in range(3)]
        word = lambda lo, hi, letters=letters: "".join(rng.choices(letters, k=rng.randint(lo, hi)))
        slugs, names_ = sorted({word(1, 2) + "!" for _ in range(4)}), [word(3, 7) for _ in range(5)]
        own = [{"id": d * 100 + k, "slug": s, "name": word(2, 6)} for k, s in enumerate(slugs[:2])]
        mine = [(d * 100 + k, rng.choice(names_) + rng.choice(["", " ", "-"]), rng.choice([*slugs, key(names_[0]), "", ""])) for k in range(16)]
        rows, teams = rows + mine, teams + own
        for w, r in zip(want, one_by_one(mine, own)):
            w.update(r)

    def saved(self, df):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] * (not {"team", "found_by"} - {*df.columns} and "at" in df.columns))
        return save(self, df)

    monkeypatch.setattr(entities.Written, "save", saved)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        assert settled(spark, rows, teams) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 2 and not any("Exchange hashpartitioning" in p for p in plans)


def _deliveries(rng, n):
    """Random deliveries, each in an alphabet of its own, with much said again later."""
    rows, teams = [], []
    for d in range(n):
        letters = [chr(0x4E00 + 3 * d + k) for k in range(3)]
        word = lambda lo, hi, letters=letters: "".join(rng.choices(letters, k=rng.randint(lo, hi)))
        slugs, names_ = sorted({word(1, 2) + "!" for _ in range(4)}), [word(3, 7) for _ in range(5)]
        teams += [{"id": d * 100 + k, "slug": s, "name": word(2, 6)} for k, s in enumerate(slugs[:2])]
        rows += [(d * 100 + k, rng.choice(names_) + rng.choice(["", " ", "-"]), rng.choice([*slugs, key(names_[0]), "", ""])) for k in range(40)]
    return rows, teams


def test_few_rows_are_walked_through_in_few_writes(spark, monkeypatch):
    """A chain of forty rows, each of which finds its team by what the one before has set, takes no round for each."""
    rows = [(k, "Alpha " + "x" * (40 - k), f"s{k}") for k in range(40)]
    teams, writes, save = [{"id": 1, "slug": "a", "name": "Sol"}], [], entities.Written.save
    monkeypatch.setattr(entities.Written, "save", lambda self, df: writes.append(df.columns) or save(self, df))
    assert settled(spark, rows, teams) == one_by_one(rows, teams)
    rows, teams = _deliveries(random.Random(23), 20)
    assert settled(spark, rows, teams) == one_by_one(rows, teams)
    assert len(writes) <= 24


def test_rows_that_are_too_many_to_walk_through_go_on_in_rounds(spark, monkeypatch):
    """Few pairs, whose repeated rows are many: the same teams, though the walk met some before their leaders."""
    rows, teams = _deliveries(random.Random(29), 40)
    assert len({r[1:] for r in rows}) < len(rows)
    pairs = len({r[1:] for r in rows}) + len(teams)
    monkeypatch.setattr(entities, "WALKED", pairs + 1)
    walked = []
    monkeypatch.setattr(entities, "_walked", lambda *a, f=entities._walked: walked.append(1) or f(*a))
    led = []
    monkeypatch.setattr(entities, "_led", lambda *a, f=entities._led: led.append(1) or f(*a))
    assert settled(spark, rows, teams) == one_by_one(rows, teams)
    assert walked and led
