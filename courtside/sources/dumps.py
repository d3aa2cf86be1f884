"""Comparing two dumps of results: JSON opened side by side, and numbers told apart beyond a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.written import Written

ABSOLUTE, RELATIVE = 0.11, 0.005

#: Levels that are opened in one pass; deeper pairs are written and opened in passes of their own.
LEVELS = 4


def _members(v: Column, nested: Column) -> Column:
    """A nested variant's members by their step of the path, ``.key`` or ``[0]``; none of any other."""
    fields = F.transform_keys(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: F.concat(F.lit("."), k))
    items = F.try_variant_get(v, "$", "array<variant>")
    places = F.transform(items, lambda _, i: F.concat(F.lit("["), i.cast("string"), F.lit("]")))
    none = F.lit(None).cast("map<string,variant>")
    by_step = F.when(nested, F.coalesce(fields, F.map_from_arrays(places, items))).otherwise(none)
    return F.coalesce(by_step, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def _with_text(pairs: DataFrame) -> DataFrame:
    """Pairs with each side's JSON and whether it has members; those of which both sides are the same are left out."""
    texts = pairs.withColumns({f"{s}_text": F.to_json(s) for s in ("now", "base")})
    same = F.col("now_there") & F.col("base_there") & F.col("now_text").eqNullSafe(F.col("base_text"))
    open_ = lambda t: F.coalesce(F.substring(t, 1, 1).isin("{", "[") & ~F.col(t).isin("{}", "[]"), F.lit(False))
    return texts.where(~same).withColumns({f"{s}_nested": open_(f"{s}_text") for s in ("now", "base")})


def _opened(pairs: DataFrame) -> DataFrame:
    """Pairs of ``_with_text`` a level deeper. A side that is a leaf stays where it is."""
    leaf = lambda s: F.when(~F.col(f"{s}_nested"), F.col(s)).alias(s)
    there = lambda s: F.col(f"{s}_there") & ~F.col(f"{s}_nested")
    own = F.array(F.struct(F.lit("").alias("step"), leaf("now"), leaf("base"), there("now").alias("now_there"), there("base").alias("base_there")))
    zipped = F.map_zip_with(_members(F.col("now"), F.col("now_nested")), _members(F.col("base"), F.col("base_nested")), lambda _, a, b: F.struct(a.alias("now"), b.alias("base"), a.isNotNull().alias("now_there"), b.isNotNull().alias("base_there")))
    below = F.transform(F.map_entries(zipped), lambda e: F.struct(e["key"].alias("step"), e["value"]["now"].alias("now"), e["value"]["base"].alias("base"), e["value"]["now_there"].alias("now_there"), e["value"]["base_there"].alias("base_there")))
    every = F.when(~F.col("now_nested") & ~F.col("base_nested"), own).when(there("now") | there("base"), F.concat(own, below)).otherwise(below)
    out = pairs.select("name", "path", F.explode(every).alias("e"))
    return _with_text(out.select("name", F.concat("path", "e.step").alias("path"), *[F.col(f"e.{c}").alias(c) for c in ("now", "base", "now_there", "base_there")]))


def flattened(dumps: DataFrame) -> DataFrame:
    """``name, path, value, number`` of every leaf of ``dumps(name, json)``.

    A path is like ``$.a[0].b``; ``value`` is the leaf as JSON text, ``number`` its value if it is a number. Objects and
    lists without members are leaves. JSON is parsed once to a variant and opened level by level, a round a level, so
    depth is bound by the data only. What is no JSON, and null, is a leaf ``$`` with a null value.
    """
    spark = dumps.sparkSession
    written = Written(spark, "dumps")
    level = written.save(dumps.select("name", F.lit("$").alias("path"), F.try_parse_json("json").alias("v")))
    leaves = None
    while level.head(1):
        kind = F.schema_of_variant("v")
        nested = (F.startswith(kind, F.lit("OBJECT<")) & (kind != "OBJECT<>")) | (F.startswith(kind, F.lit("ARRAY<")) & (F.to_json("v") != "[]"))
        typed = level.withColumn("nested", F.coalesce(nested, F.lit(False)))
        is_number = F.schema_of_variant("v").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        own = typed.where("not nested").select("name", "path", F.to_json("v").alias("value"), F.when(is_number, F.try_variant_get("v", "$", "double")).alias("number"))
        leaves = own if leaves is None else leaves.union(own)
        opened = typed.where("nested").select("name", "path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        level = written.save(opened.select("name", F.concat("path", step).alias("path"), F.col("value").alias("v")))
    return leaves if leaves is not None else spark.createDataFrame([], "name string, path string, value string, number double")


def differences(now: DataFrame, baseline: DataFrame, absolute: float = ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """``name, path, change, now, baseline``: where two dumps ``(name, json)`` differ.

    ``change`` is added or gone for a path that one side lacks, different where both have it: numbers that are apart by
    more than ``absolute`` and by more than ``relative`` of the baseline's, and other values that are not the same. A name
    that one side lacks is added or gone with all its paths. Names are unique in a dump.

    Dumps are joined once, whole, and opened in pairs: members meet by their key or place inside their row, so no leaf is
    shuffled, and pairs that are the same are not opened.
    """
    spark = now.sparkSession
    written = Written(spark, "differences")
    side = lambda df, s: df.select("name", F.col("json").alias(f"{s}_json"), F.lit(True).alias(f"{s}_there"))
    both = side(now, "now").join(side(baseline, "base"), "name", "full").withColumns({f"{s}_there": F.coalesce(f"{s}_there", F.lit(False)) for s in ("now", "base")})
    both = both.where(~(F.col("now_there") & F.col("base_there") & F.col("now_json").eqNullSafe(F.col("base_json"))))
    pairs = _with_text(both.select("name", F.lit("$").alias("path"), *[F.try_parse_json(f"{s}_json").alias(s) for s in ("now", "base")], "now_there", "base_there"))
    number = lambda s: F.when(F.col(f"{s}_text").rlike("^[-0-9]"), F.try_variant_get(s, "$", "double"))
    apart = F.abs(number("now") - number("base"))
    close = (apart <= absolute) | (apart <= relative * F.abs(number("base")))
    open_ = F.col("now_nested") | F.col("base_nested")
    found = None
    while True:
        for _ in range(LEVELS):
            pairs = _opened(pairs)
        pairs = written.save(pairs.where(open_ | ~F.coalesce(close, F.lit(False))))
        own = pairs.where(~open_)
        found = own if found is None else found.union(own)
        pairs = pairs.where(open_)
        if not pairs.head(1):
            break
    change = F.when(~F.col("base_there"), "added").when(~F.col("now_there"), "gone").otherwise("different")
    return found.select("name", "path", change.alias("change"), F.col("now_text").alias("now"), F.col("base_text").alias("baseline"))
