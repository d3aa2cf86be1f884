"""Entity resolution: which team a reported name means, which teams are one, and re-pointing the facts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.functions import names
from courtside.operators.base import ranked
from courtside.written import Written

#: Reported names whose normal form is shorter than this are never matched by name; also the length of a gram.
SHORTEST = 4


def _grams(key: str, length: int | Column) -> Column:
    """The runs of ``length`` characters of a name, the whole of a shorter one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - length + 1, F.lit(1))), lambda i: F.substring(F.col(key), i, F.lit(length) if isinstance(length, int) else length))


def candidates(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``(inner, outer)``: keys of ``inner(key)`` and those of ``outer(key)`` in which they may stand.

    An inverted index: outer keys lie under all their grams, inner keys ask under one, that of theirs which the fewest
    outer keys have. So a word that many names share makes no pairs: whoever has nothing rarer is really contained
    wherever it is found. Keys shorter than a gram are grams themselves. Empty and null keys are in nothing.
    """
    asked = inner.select("key").where("key <> ''").distinct()
    held = outer.select("key").where("key <> ''").distinct()
    runs = F.array_distinct(F.flatten(F.array(*[_grams("key", n) for n in range(1, SHORTEST + 1)])))
    held = held.select(F.col("key").alias("outer"), F.explode(runs).alias("g"))
    usual = held.groupBy("g").agg(F.count("*").alias("df"))
    own = F.array_distinct(_grams("key", F.least(F.length("key"), F.lit(SHORTEST))))
    wanted = asked.select(F.col("key").alias("inner"), F.explode(own).alias("g")).join(usual, "g", "left")
    rarest = wanted.groupBy("inner").agg(F.min_by("g", F.struct("df", "g")).alias("g"), F.bool_and(F.col("df").isNotNull()).alias("all")).where("all").drop("all")
    return rarest.join(held, "g").select("inner", "outer")


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``(inner, outer)``: keys of ``inner(key)`` that stand within keys of ``outer(key)``, equal ones too."""
    return candidates(inner, outer).where(F.contains("outer", "inner"))


def _alike(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``(key, other)``: keys of ``asked`` long enough, and keys of ``known`` that hold them or are held by them."""
    long = asked.where(F.length("key") >= SHORTEST)
    within = contained(long, known).select(F.col("inner").alias("key"), F.col("outer").alias("other"))
    around = contained(known, long).where("inner <> outer").select(F.col("outer").alias("key"), F.col("inner").alias("other"))
    return within.union(around)


def _one(table: DataFrame, few: bool) -> DataFrame:
    """``table`` as one partition, if its rows are few."""
    return table.coalesce(1) if few else table


def _sent(table: DataFrame, few: bool) -> DataFrame:
    """``table`` to be broadcast, if its rows are few: the planner takes a join's result for as large as its sides' product."""
    return table.hint("broadcast") if few else table


def _named(opponents: DataFrame, teams: DataFrame, few: bool = False) -> DataFrame:
    """``(key, name_id)``: the team with the least id whose normal name holds the key or is held by it."""
    known = teams.select(names.team_key(F.col("name")).alias("key"), "id")
    met = _one(_alike(opponents, known), few).join(_sent(known.withColumnRenamed("key", "other"), few), "other")
    return _sent(met.groupBy("key").agg(F.min("id").alias("name_id")), few)


def resolve(opponents: DataFrame, teams: DataFrame) -> DataFrame:
    """``opponents(opponent, opponent_slug)`` with ``team_id`` among ``teams`` and how it was found: slug, name or new.

    First by slug. What is left matches a team whose normal name holds the opponent's or is held by it; of several,
    the one with the least id. Here no opponent changes what another meets; ``settle`` has that.
    """
    asked = opponents.select("opponent", "opponent_slug").distinct().withColumn("key", names.team_key(F.col("opponent")))
    by_slug = teams.groupBy(F.col("slug").alias("opponent_slug")).agg(F.min("id").alias("slug_id"))
    found = asked.join(by_slug, "opponent_slug", "left").join(_named(asked, teams), "key", "left")
    how = F.when(F.col("slug_id").isNotNull(), "slug").when(F.col("name_id").isNotNull(), "name").otherwise("new")
    return found.select("opponent", "opponent_slug", F.coalesce("slug_id", "name_id").alias("team_id"), how.alias("found_by"))


# --- a delivery, row by row ---------------------------------------------------------------------------

#: Rows up to which one task takes a round: dealing so few out, by team and by slug, takes longer than the round itself.
SMALL = 4096

#: Rows up to which one task, with names as few, walks through a delivery before a round.
WALKED = 64 * SMALL

#: Rows that make their team, and rows after which their team has their slug: those that bring one, those that make it,
#: and (without ``at``, before all others) those that say who holds a slug at first.
_MADE = "(team.new = 1 AND team.at <=> at)"
_SETS = f"(at IS NULL OR given OR {_MADE})"
_OWN = ["at", "slug", "given", "key", "name_id", "league", "first", "open"]


def _stored(id_: str) -> str:
    """A stored team as a reference: stored ones come first, by id, then new ones in the order in which they came up."""
    return f"IF({id_} IS NULL, NULL, struct(0 AS new, CAST({id_} AS bigint) AS id, CAST(NULL AS struct<ord: bigint, opponent: string, slug: string>) AS at))"


def _fresh(at: str) -> str:
    return f"IF({at} IS NULL, NULL, struct(1 AS new, CAST(NULL AS bigint) AS id, {at} AS at))"


def _saved(written: Written, table: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """A table written, and figures of it that are taken as it is written. With few rows it is read as one partition,
    in which windows and groups need no shuffle."""
    seen = Observation()
    saved = written.save(table.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in figures.items()]))
    out = _one(saved, seen.get["rows"] <= SMALL)
    out._written = saved._written
    return out, seen.get


def _led(state: DataFrame, near: DataFrame, few: bool) -> DataFrame:
    """``state`` with ``leader``: of the rows that make a team whose name is near the row's, the first."""
    made = state.where(_MADE).select(F.col("key").alias("other"), "at")
    leaders = near.join(_sent(made, few), "other").groupBy("key").agg(F.min("at").alias("leader"))
    return state.drop("leader").join(_sent(leaders, few), "key", "left")


def _stepped(state: DataFrame) -> DataFrame:
    """Every row's team as it follows from the teams that ``state`` holds for the rows before it.

    Who holds a slug at a row: the team of the last row before it that set this slug, if no row in between set another
    one on that team. ``torn`` tells of rows of ``state`` that may find another team when they come again: those whose
    team is given several slugs, or another than that under which a row looks for it; and those whose slug some row sets
    on a team that isn't theirs.
    """
    by_team, by_slug = (f"OVER (PARTITION BY {k} ORDER BY at {way} ROWS BETWEEN UNBOUNDED PRECEDING AND" for k, way in (("team", "DESC"), ("slug", "ASC")))
    before, whole = "1 PRECEDING)", "UNBOUNDED FOLLOWING)"
    seen = state.selectExpr(*_OWN, "leader", "team", f"{_SETS} AS sets", f"{_MADE} AS made")
    seen = seen.selectExpr("*", f"min(IF(sets, at, NULL)) {by_team} {before} AS until", *[f"{f}(IF(sets, slug, NULL)) {by_team} {whole} AS {f}_slug" for f in ("min", "max")])
    seen = seen.selectExpr("*", f"last(IF(sets, struct(team, until), NULL), true) {by_slug} {before} AS last", *[f"{f}(IF(sets AND at IS NOT NULL, team, NULL)) {by_slug} {whole} AS {f}_team" for f in ("min", "max")])
    torn = "at IS NOT NULL AND (coalesce(min_slug <> max_slug, false) OR coalesce(min_team <> max_team, false) OR coalesce(min_team <> team, false)) AS torn"
    named = f"coalesce({_stored('name_id')}, IF(leader < at, {_fresh('leader')}, NULL)) AS named"
    seen = seen.selectExpr(*_OWN, "leader", "made", "team AS was", torn, "IF(last.until IS NULL OR last.until >= at, last.team, NULL) AS holder", named)
    now = f"IF(at IS NULL, was, coalesce(holder, named, {_fresh('at')})) AS team"
    how = "CASE WHEN holder IS NOT NULL THEN 'slug' WHEN named IS NOT NULL THEN 'name' ELSE 'new' END AS found_by"
    return seen.selectExpr("*", now, how).selectExpr(*_OWN, "leader", "team", "found_by", "torn", "NOT team <=> was AS moved", f"made <> {_MADE} AS remade")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in their order, after the stored teams (rows without ``at`` and ``team``): what each finds at its turn.

    Held are the names of all teams and their slugs, not the rows.
    """
    teams, keys, slugs, holder, seen = [], [], [], {}, {}

    def add(key: str, slug: str | None, team: dict) -> int:
        teams.append(team)
        keys.append(key)
        slugs.append(slug)
        if slug is not None:
            holder.setdefault(slug, len(teams) - 1)
        return len(teams) - 1

    def near(key: str) -> int | None:
        """The first team whose name holds the key or is held by it; only teams that are new since are looked at again."""
        upto, found = seen.get(key, (0, None))
        if found is None and len(key) >= SHORTEST:
            found = next((i for i in range(upto, len(keys)) if keys[i] and (key in keys[i] or keys[i] in key)), None)
            seen[key] = len(keys), found
        return found

    for batch in batches:
        whose, named = [], []
        has_turn, has_team = (batch[c].is_valid() for c in ("at", "team"))
        columns = [has_turn, has_team, *(batch[c] for c in ("slug", "key", "given", "name_id"))]
        for place, (turn, held, slug, key, given, id_) in enumerate(zip(*[c.to_pylist() for c in columns])):
            if not turn and not held:
                add(key, slug, {"new": 0, "id": id_, "at": None})
                continue
            team, like = holder.get(slug), near(key) if turn else None
            if team is None and like is None:
                team = add(key, slug, {"new": 1, "id": None, "at": batch["at"][place].as_py()})
            elif team is None:
                team = like
                if given:
                    if holder.get(slugs[team]) == team:
                        del holder[slugs[team]]
                    slugs[team], holder[slug] = slug, team
            whose.append(team)
            named.append(like)
        out = batch.filter(pc.or_(has_turn, has_team))
        all_, named = pa.array(teams, out.schema.field("team").type), pa.array(named, pa.int64())
        found = {"team": all_.take(pa.array(whose, pa.int64())), "name_id": all_.field("id").take(named), "leader": all_.field("at").take(named)}
        yield pa.RecordBatch.from_arrays([found.get(c, out[c]) for c in out.schema.names], schema=out.schema)


def _walked(state: DataFrame, teams: DataFrame) -> DataFrame:
    """``state``, of few rows, with the team that each finds when they come one by one, as one task walks through them."""
    state = state.select(*_OWN, "leader", "team")
    stored = teams.select("slug", names.team_key(F.col("name")).alias("key"), F.col("id").cast("long").alias("name_id"))
    rows = state.unionByName(stored, allowMissingColumns=True).coalesce(1)
    return rows.sortWithinPartitions("at", F.asc_nulls_last("name_id")).mapInArrow(_walk, state.schema)


def settle(delivery: DataFrame, teams: DataFrame, order: str = "src_ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What storing a delivery's opponents one by one, in the order of ``order``, makes of them and of ``teams``.

    A row finds the team that holds its slug at that moment (its normal name, where it brings no slug); else the first
    team whose normal name holds its own or is held by it, which then takes over the slug that the row brings; else it
    makes a team, which later rows find. Returns

    * ``resolved``: ``order, opponent, opponent_slug, team_id`` of every distinct row;
    * ``teams`` with migrated slugs and the new teams, whose ids go on from the greatest in the order in which they
      came up; a new team has the columns ``slug, name`` and, where ``delivery`` has it, the row's ``league``;
    * ``found``: of each pair of opponent and slug the first row, ``order, opponent, opponent_slug, team_id, found_by``.

    Rows with a blank opponent are left out; a null slug is a blank one; rows of equal order take turns by name and
    slug. A normal name that is empty is matched by slug only.

    The order is not walked through. All rows guess their team, and correct it from the guesses of the rows before
    them until nothing moves: a row is right one round after those that it depends on. Only the first row of each pair
    takes part, and all rows of pairs whose team or slug moves, as no other repeated row changes anything. A round is one
    pass by team and one by slug; who leads a name is only asked again after rounds in which other rows make teams.
    Where rows and names are few, one task walks through them for the guess, and a round only confirms it.
    """
    written = Written(delivery.sparkSession, "settle")
    slug = F.coalesce("opponent_slug", F.lit(""))
    league = F.col("league") if "league" in delivery.columns else F.lit(None).cast("string")
    rows = delivery.where("trim(coalesce(opponent, '')) <> ''").select(F.col(order).cast("long").alias("ord"), "opponent", slug.alias("given_slug"), league.alias("league"))
    rows = written.save(rows.groupBy("ord", "opponent", "given_slug").agg(F.min("league").alias("league")))
    columns, id_type = teams.columns, teams.schema["id"].dataType
    teams, of_teams = _saved(written, teams, most=F.max("id").cast("long"))

    pairs = rows.groupBy("opponent", "given_slug").agg(F.min("ord").alias("ord"), F.min_by("league", "ord").alias("league"))
    pairs = pairs.withColumn("key", names.team_key(F.col("opponent")))
    pairs = pairs.withColumn("given", F.col("given_slug") != "").withColumn("slug", F.when(F.col("given"), F.col("given_slug")).otherwise(F.col("key")))
    pairs, seen = _saved(written, pairs)
    few = seen["rows"] + of_teams["rows"] <= SMALL
    holders = teams.groupBy("slug").agg(F.min("id").cast("long").alias("slug_id"))
    held = holders.join(_sent(pairs.select("slug").distinct(), few), "slug").selectExpr("slug", f"{_stored('slug_id')} AS team")
    at = "struct(ord, opponent, given_slug AS slug) AS at"
    if few:
        state = pairs.selectExpr("*", at, "CAST(NULL AS bigint) AS name_id", "true AS first", "false AS open", f"{_fresh('NULL')} AS team")
    else:
        known = pairs.join(holders, "slug", "left").join(_named(pairs, teams).select("key", F.col("name_id").cast("long").alias("name_id")), "key", "left")
        state = known.selectExpr("*", at, "true AS first", "false AS open").withColumn("team", F.expr(f"coalesce({_stored('slug_id')}, {_stored('name_id')}, {_fresh('at')})"))
    leader = F.lit(None).cast(state.schema["at"].dataType).alias("leader")
    state = state.select(*_OWN, leader, "team").unionByName(held, allowMissingColumns=True)
    if not few:
        state, seen = _saved(written, state)

    near, any_ = None, lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    remade = True
    while True:
        walk = few and seen["rows"] <= WALKED
        if walk:
            guess = _walked(state, teams)
        elif remade:
            if near is None:
                # names that no stored team has: who of them would be whose team
                unknown = state.where("at is not null and name_id is null").select("key").distinct()
                near, of_near = _saved(written, _alike(unknown, unknown))
            guess = _led(state, near, seen["rows"] + of_near["rows"] <= SMALL)
        else:
            guess = state
        step, seen = _saved(written, _stepped(guess), moved=any_(F.col("moved")), remade=any_(F.col("remade")), torn=any_(F.expr("torn and not open")))
        if hasattr(state, "_written"):
            written.drop(state)
        state, remade = step, walk or seen["remade"]  # whom a walk has not met yet may still lead
        if not seen["moved"] and seen["torn"]:
            # every row of the pairs that turned out torn takes part from here on, with the team of the first at first
            kept = state.where("open or not torn").select(*_OWN, "leader", "team")
            again = state.where("torn and not open").selectExpr("at.opponent", "at.slug AS given_slug", "at.ord AS first_ord", "slug", "given", "key", "name_id", "leader", "team")
            every = rows.join(again, ["opponent", "given_slug"]).selectExpr("*", at, "ord = first_ord AS first", "true AS open")
            state, seen = _saved(written, kept.unionByName(every.select(*kept.columns)))
            written.drop(step)
        elif not seen["moved"]:
            break

    # the teams: last slug set on each, and new ones numbered; what is few is made twice sooner than written
    few = seen["rows"] <= WALKED
    last = state.where(f"at is not null and {_SETS}").groupBy("team").agg(F.max_by("slug", "at").alias("new_slug"), F.min_by("league", "at").alias("new_league"))
    last = last if few else written.save(last)
    most = of_teams["most"] or 0
    made = last.where("team.new = 1").select("team.at", "new_slug", "new_league")
    made = _one(made, few).withColumn("rank", F.row_number().over(W.orderBy("at"))) if few else ranked(made, "rank", [F.asc("at")], F.floor(F.col("at.ord") / 65536))
    numbered = made.select("at", (F.lit(most) + F.col("rank")).cast("long").alias("team_id"), "new_slug", "new_league")
    numbered = numbered if few else written.save(numbered)
    migrated = last.where("team.new = 0").select(F.col("team.id").alias("__id"), "new_slug")
    kept = teams.join(migrated, teams["id"] == F.col("__id"), "left").withColumn("slug", F.coalesce("new_slug", "slug")).select(*columns)
    fresh = numbered.select(F.col("team_id").cast(id_type).alias("id"), F.col("new_slug").alias("slug"), F.col("at.opponent").alias("name"), F.coalesce("new_league", F.lit("")).alias("league"))
    fresh = fresh.select(*[c for c in fresh.columns if c in columns])
    every_team = kept.unionByName(fresh, allowMissingColumns=True)

    of_new = numbered.select(F.col("at").alias("made_at"), F.col("team_id").alias("new_id"))
    ids = state.where("at is not null").join(of_new, F.col("team.at") == F.col("made_at"), "left")
    ids = written.save(ids.select("at.ord", "at.opponent", F.col("at.slug").alias("given_slug"), F.coalesce("team.id", "new_id").alias("team_id"), "found_by", "first", "open"))
    single = rows.join(ids.where("not open").select("opponent", "given_slug", "team_id"), ["opponent", "given_slug"])
    resolved = single.select("ord", "opponent", "given_slug", "team_id").union(ids.where("open").select("ord", "opponent", "given_slug", "team_id"))
    out = lambda df, *more: df.select(F.col("ord").alias(order), "opponent", F.col("given_slug").alias("opponent_slug"), "team_id", *more)
    return out(resolved), every_team, out(ids.where("first"), "found_by")


# --- teams that are one -------------------------------------------------------------------------------


def duplicates(teams: DataFrame, canonical: DataFrame) -> DataFrame:
    """``(id, canonical_id)``: teams whose normal name holds the slug of a canonical team that is not theirs."""
    keyed = teams.select("id", "slug", names.team_key(F.col("name")).alias("key"))
    of = canonical.select(F.col("id").alias("canonical_id"), F.col("slug").alias("canonical_slug"))
    held = contained(of.select(F.col("canonical_slug").alias("key")), keyed)
    pairs = keyed.join(held, F.col("key") == F.col("outer")).join(of, F.col("inner") == F.col("canonical_slug")).where(F.col("slug") != F.col("canonical_slug"))
    return pairs.groupBy("id").agg(F.min("canonical_id").alias("canonical_id")).where("id <> canonical_id")


def remap(facts: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """``facts`` with the ids of merged teams replaced by the canonical ones."""
    to = merged.select(F.col("id").alias(column), F.col("canonical_id").alias("__to"))
    return facts.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to").select(*facts.columns)


def merge_duplicates(tables: dict[str, DataFrame], merged: DataFrame) -> dict[str, DataFrame]:
    """All tables with merged teams re-pointed and dropped; a game that then stands twice stays once, the smaller id."""
    columns = {"games": ["home_team_id", "away_team_id"], "boxscores": ["team_id"], "team_game_stats": ["team_id"], "players": ["team_id"], "season_team_stats": ["team_id"], "ingest_jobs": ["team_id"]}
    out = dict(tables)
    for name in columns.keys() & tables.keys():
        for column in columns[name]:
            out[name] = remap(out[name], column, merged)
    if "games" in out:
        first = W.partitionBy("date", "home_team_id", "away_team_id").orderBy("id")
        out["games"] = out["games"].withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    if "teams" in out:
        out["teams"] = out["teams"].join(merged.select("id"), "id", "left_anti")
    return out
