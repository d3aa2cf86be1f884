"""Mixing sources to target weights by a low-discrepancy schedule (operator 2).

The documents of a source, in a shuffled order, are one string of words, cut into blocks of equal size
and repeated once (two epochs). Slots of the mix are points of the golden-ratio sequence, mapped through
the cumulative targets to a source; the r-th slot of a source takes its r-th block. Only DataFrame
operations are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.llm.common import Scratch, word_count

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and how often a document may be read.
SHARE, EPOCHS = 1.5, 2
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Cells of the unit interval by which slots meet sources.
CELLS = 4096
#: A block has this share of the square root of the mix, so blocks and their number both grow with it.
BLOCK = 1 / 32


def targets(sized: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, target, rank`` and the cumulative interval ``lo, hi`` of each source.

    One row a source; the windows run over this table only. A target is ``weight * level``, but
    ``epochs * source_size`` at most: sources are taken in the order in which a rising level fills them,
    and the level is the first that leaves the next source unfilled. Intervals are in thousandths of a word.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_source)
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", rank)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1))
    t = t.withColumn("most", epochs * F.col("source_size"))
    filling = W.orderBy(F.col("most") / F.col("weight"), "rank")
    everything = filling.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = F.sum("most").over(filling.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("most")
    open_weight = F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * share - filled) / open_weight
    t = t.withColumn("level", level).withColumn("over", F.col("most") / F.col("weight") > F.col("level"))
    at = F.first(F.when(F.col("over"), F.col("level")), ignorenulls=True).over(everything)
    t = t.withColumn("target", F.when(F.col("over"), F.col("weight") * at).otherwise(F.col("most").cast("double")))
    t = t.withColumn("width", F.round(F.col("target") * 1000).cast("long"))
    hi = F.sum("width").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return t.select("source", "source_size", "target", "rank", (hi - F.col("width")).alias("lo"), hi.alias("hi"))


def running(df: DataFrame, key: str, bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the earlier rows of ``key`` in the order (bucket, *order).

    In two levels, so that no task sees more than one bucket of a key: sums of buckets, then a window in each.
    """
    valued = df.withColumn("__v", value)
    sums = valued.groupBy(key, bucket).agg(F.sum("__v").alias("__s"))
    before = F.sum("__s").over(W.partitionBy(key).orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__s")
    within = F.sum("__v").over(W.partitionBy(key, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__v")
    offsets = sums.select(key, bucket, before.alias("__before"))
    return valued.join(offsets, [key, bucket]).withColumn(name, F.col("__before") + within).drop("__v", "__before")


def schedule(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, **more: Column) -> tuple[DataFrame, DataFrame]:
    """The sized documents and the mix.

    ``(row, doc_id, source, size, source_size, target)`` has one row per row of ``docs``, and the columns ``more`` of it;
    the mix is ``(slot, row, epoch, from_word, words)``: slot by slot, the words that it takes of a document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(docs.select("doc_id", "source", word_count("text").alias("size"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("__salt"), *[v.alias(k) for k, v in more.items()]).withColumn("row", F.monotonically_increasing_id()))
    sources = scratch.save(targets(sized, share, epochs))
    n, total = sized.count(), sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max("hi"), F.lit(0))).first()
    mix_words, width = total[0] * share, total[1]
    block = max(1, math.ceil(math.sqrt(mix_words) * BLOCK))

    # Slots: golden-ratio points, joined to the sources by cell of the unit interval.
    slots = spark.range(math.ceil(mix_words / block)).withColumnRenamed("id", "slot")
    x = F.col("slot") * F.lit(GOLDEN)
    slots = slots.withColumn("u", x - F.floor(x)).withColumn("cell", F.floor(F.col("u") * CELLS).cast("long"))
    cell = lambda c: F.floor(c / max(1, width) * CELLS).cast("long")
    cells = sources.where("hi > lo").select("rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")) - 1, cell(F.col("hi")) + 1)).alias("cell"))
    point = F.col("u") * F.lit(float(width))
    slots = slots.join(cells, "cell").where((point >= F.col("lo")) & (point < F.col("hi"))).select("slot", "rank")
    slots = slots.withColumn("chunk", F.shiftright("slot", 12))
    slots = running(slots, "rank", "chunk", ["slot"], F.lit(1).cast("long"), "block").select("slot", "rank", "block")

    # Words: each source in the order of a digest of the id (of the text, where there is none), both epochs, cut into blocks.
    digits = max(2, math.ceil(math.log(max(n, 2) / 2000, 16)))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("__salt").cast("string"))))
    known = sized.join(sources.select("source", "source_size", "target", "rank"), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    known = scratch.save(known)
    laid = known.where("size > 0").select("row", "rank", "size", "source_size", digest.alias("digest"), "doc_id")
    laid = running(laid.withColumn("bucket", F.substring("digest", 1, digits)), "rank", "bucket", ["digest", "doc_id", "row"], F.col("size"), "start")
    laid = laid.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs))))).withColumn("start", F.col("start") + F.col("epoch") * F.col("source_size"))
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / block), F.floor((end - 1) / block)
    cut = laid.withColumn("end", end).withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    left, right = F.greatest("start", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    pieces = cut.select("rank", "block", "row", "epoch", (left - F.col("start")).alias("from_word"), (right - left).alias("words"))
    mix = pieces.join(slots, ["rank", "block"]).select("slot", "row", "epoch", "from_word", "words")
    return known.select("row", "doc_id", "source", "size", "source_size", "target", *more), mix


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``taken`` counts the words that the mix takes of it, repeats counted, twice its size at most. A null
    text has size 0 and is never taken; a null source is a source, the last; repeated rows are documents
    of their own. Other columns are not read. An empty table gives an empty result.
    """
    known, mix = schedule(docs)
    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    return known.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix reads them: whole documents, each as often as its words are taken, rounded.

    Every row is planned for itself, also where ids are null or repeated, and found again by two hashes of all its
    columns; rows that are equal in all of them are one document, read as often as all of them together. A document that
    is not taken, or without a word (null and empty texts), is not in the mix. A null source is a source. All columns
    are kept, whatever their names. An empty table gives an empty result. Slots order the plan; the rows of the
    result are a set.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    hashes = [F.xxhash64(*docs.columns, F.lit(salt)) for salt in ("one", "two")]
    known, mix = schedule(docs, __h1=hashes[0], __h2=hashes[1])
    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    key = ["__h1", "__h2"]
    plan = known.where("size > 0").join(taken, "row").groupBy(*key).agg(F.sum(times).cast("int").alias("times"), F.count("*").alias("n")).where("times > 0")
    plan = scratch.save(plan)
    rows = docs.select(F.struct(*docs.columns).alias("rows"), *[h.alias(k) for k, h in zip(key, hashes)])
    both = rows.join(plan, key)
    if plan.where("n > 1").limit(1).count():  # equal rows
        both = both.where("n = 1").union(both.where("n > 1").dropDuplicates(key))
    each = both.select("rows", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k"))
    return each.select(*[F.col("rows").getField(c).alias(c) for c in docs.columns])


#: The same rows in DuckDB's SQL.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(rnk - 1) % 3 + 1] AS weight, 2 * source_size AS most FROM ranked
), levels AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE
    - (sum(most) OVER (ORDER BY most / weight, rnk ROWS UNBOUNDED PRECEDING) - most))
    / sum(weight) OVER (ORDER BY most / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), aimed AS (
  SELECT *, CASE WHEN most / weight > level
    THEN weight * (SELECT arg_min(level, most / weight) FROM levels WHERE most / weight > level) ELSE most::DOUBLE END AS target FROM levels
), spans AS (
  SELECT *, sum(round(target * 1000)::BIGINT) OVER (ORDER BY rnk ROWS UNBOUNDED PRECEDING)::BIGINT AS hi, round(target * 1000)::BIGINT AS width FROM aimed
), size_of AS (
  SELECT sum(source_size) * {SHARE}::DOUBLE AS mix, greatest(1, ceil(sqrt(sum(source_size) * {SHARE}::DOUBLE) / 32))::BIGINT AS block, max(hi)::DOUBLE AS width FROM spans
), points AS (
  SELECT k * {GOLDEN}::DOUBLE - floor(k * {GOLDEN}::DOUBLE) AS u FROM (SELECT unnest(range(ceil(mix / block)::BIGINT)) AS k FROM size_of)
), slots AS (
  SELECT s.rnk, count(*) AS n FROM points, size_of z, spans s WHERE u * z.width >= s.hi - s.width AND u * z.width < s.hi GROUP BY s.rnk
), laid AS (
  SELECT d.*, s.rnk, s.source_size, s.target, sum(size) OVER (PARTITION BY s.rnk ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized d JOIN spans s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target,
  (least(size, greatest(0, coalesce(n, 0) * block - start)) + least(size, greatest(0, coalesce(n, 0) * block - source_size - start)))::BIGINT AS taken
FROM laid LEFT JOIN slots USING (rnk), size_of
"""
