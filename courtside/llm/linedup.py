"""Repeated line runs by prefix doubling over line-ID sequences (operator 5).

The corpus is one sequence of line IDs, documents in order of their id, with a break after each. Suffixes
that agree in their first 2^k lines form an interval of the suffix array with a longest common prefix of
at least 2^k; round k+1 refines the intervals of round k by the pair (interval here, interval 2^k lines
on). An interval is named by its first suffix, so names are exact, whatever the number of lines, and no
sorted copy of the sequence is written. Suffixes alone in their interval leave the search at once. Any
longer prefix is the overlap of two prefixes of a power of two, so each interval of the wanted depth is
a group of such pairs. Later copies of a run are deleted. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.llm.common import WORD, Scratch

#: A run of lines that repeats is deleted from this many words on.
MIN_WORDS = 50
#: Deletions are broadcast up to this many bytes, counted as ROW_BYTES a document and four a line; else the join shuffles.
BROADCAST_BYTES, ROW_BYTES = 16_000_000, 100


def _numbered(scratch: Scratch, parts: DataFrame) -> DataFrame:
    """``parts`` with ``base``: the lines before a document, documents in order of (doc_id, th)."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("th").asc()]
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(parts.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("s"))
    before = sums.select("part", (F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("s")).alias("before"))
    within = F.sum("n").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    base = dealt.select("doc_id", "th", "part", "n", "lines").withColumn("within", within)
    return base.join(before, "part").withColumn("base", F.col("before") + F.col("within")).drop("part", "before", "within")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, th, gone)``: of each text with a later copy of a run, the indices of the lines to delete.

    ``th`` is the xxhash64 of the text, which tells texts of one doc_id apart; rows equal in both are one
    text. A run is a sequence of lines with words, of ``min_words`` words or more; lines without a word
    don't count and stay. Lines are equal if they are when trimmed of spaces. A copy is deleted if the
    run's first place, by (doc_id, null last, then place in the text), ends before it.
    """
    scratch = Scratch(docs.sparkSession, "linedup")
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(i.alias("at"), F.xxhash64(F.trim(x)).alias("h1"), F.xxhash64(F.lit("line"), F.trim(x)).alias("h2"), F.regexp_count(x, F.lit(WORD)).alias("w")),
    )
    parts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.filter(lines, lambda s: s["w"] > 0).alias("lines")).where(F.size("lines") > 0)
    parts = parts.dropDuplicates(["doc_id", "th"]).withColumn("n", F.size("lines").cast("long") + 1)  # and the break
    texts = scratch.save(_numbered(scratch, parts))
    flat = texts.select("doc_id", "th", "base", F.posexplode("lines").alias("i", "line"))
    seq = flat.select((F.col("base") + F.col("i")).alias("pos"), "base", F.col("line.w").cast("long").alias("w"), "line.h1", "line.h2")

    # Round 0: lines that occur twice, named by their first place.
    # Groups are written before the join, here and below: a join of two plain tables is split where a line is
    # in a great part of all documents, a join that shares its shuffle with the grouping is not.
    groups = scratch.save(seq.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("pos").alias("name")).where("c > 1"))
    here = scratch.save(seq.join(groups, ["h1", "h2"]).select("pos", "base", "w", "name"))

    # Shortest windows of min_words from each line on, and up to each line, inside unbroken repeated lines.
    row = F.row_number().over(W.partitionBy("base").orderBy("pos"))
    runs = here.withColumn("run", F.col("pos") - row)
    before = F.sum("w").over(W.partitionBy("base", "run").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("w")
    runs = runs.withColumn("before", before).withColumn("after", F.col("before") + F.col("w"))
    ahead = W.partitionBy("base", "run").orderBy("before").rangeBetween(0, min_words - 1)
    behind = W.partitionBy("base", "run").orderBy("after").rangeBetween(-(min_words - 1), 0)
    wide = runs.select(
        "pos",
        F.when(F.sum("w").over(ahead) >= min_words, F.count("*").over(ahead)).alias("ahead"),
        F.when(F.sum("w").over(behind) >= min_words, F.count("*").over(behind)).alias("behind"),
    )
    spans = F.array(F.struct(F.col("pos").alias("start"), F.col("ahead").alias("n")), F.struct((F.col("pos") - F.col("behind") + 1).alias("start"), F.col("behind").alias("n")))
    windows = scratch.save(wide.select(F.inline(spans)).where("n is not null").distinct())

    # Prefix doubling, as deep as the longest window needs.
    deepest = (windows.agg(F.max("n")).first()[0] or 1).bit_length() - 1
    level = here.select("pos", "name")
    levels = level.withColumn("k", F.lit(0))
    for k in range(deepest):
        onward = level.select((F.col("pos") - (1 << k)).alias("pos"), F.col("name").alias("next"))
        pairs = scratch.save(level.join(onward, "pos"))
        named = scratch.save(pairs.groupBy("name", "next").agg(F.count("*").alias("c"), F.min("pos").alias("new")).where("c > 1"))
        level = scratch.save(pairs.join(named, ["name", "next"]).select("pos", F.col("new").alias("name")))
        levels = levels.union(level.withColumn("k", F.lit(k + 1)))

    # A window of n lines is named by its two overlapping prefixes of 2^k lines, k = floor(log2 n).
    deep = windows.withColumn("k", (F.length(F.bin("n")) - 1).cast("int"))
    deep = deep.withColumn("end", F.col("start") + F.col("n") - F.expr("shiftleft(1L, k)"))
    first = levels.select(F.col("pos").alias("start"), "k", F.col("name").alias("a"))
    last = levels.select(F.col("pos").alias("end"), "k", F.col("name").alias("b"))
    whole = scratch.save(deep.join(first, ["start", "k"]).join(last, ["end", "k"]).select("start", "n", "a", "b"))
    copies = scratch.save(whole.groupBy("n", "a", "b").agg(F.min("start").alias("origin"), F.count("*").alias("c")).where("c > 1"))
    later = whole.join(copies, ["n", "a", "b"]).where(F.col("origin") + F.col("n") <= F.col("start"))
    gone = later.select(F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()

    places = texts.select("doc_id", "th", F.posexplode("lines").alias("i", "line"), "base").select("doc_id", "th", F.col("line.at").alias("at"), (F.col("base") + F.col("i")).alias("pos"))
    found = places.join(gone, "pos").groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("at")).alias("gone"))  # at most the lines of one text
    return scratch.save(found)


def cleaned(docs: DataFrame, keep: list[str], min_words: int = MIN_WORDS) -> DataFrame:
    """``rows``, a struct of the columns ``keep`` of ``docs`` (doc_id and text among them), with ``gone`` (indices of deleted lines, empty if
    none), ``n_lines`` and ``rest`` (the text without them). Columns of any name can be kept."""
    found = repeated_lines(docs, min_words)
    n, lines = found.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    found = found.select(F.struct("doc_id", "th", "gone").alias("found"))
    small = ROW_BYTES * n + 4 * lines <= BROADCAST_BYTES
    rows, text = docs.select(F.struct(*keep).alias("rows")), F.col("rows.text")
    match = F.col("rows.doc_id").eqNullSafe(F.col("found.doc_id")) & (F.xxhash64(text) == F.col("found.th"))
    both = rows.join(F.broadcast(found) if small else found, match, "left")

    def without(lines: Column) -> Column:
        """The stretches between the deleted lines: each line is touched once."""
        gone = F.col("found.gone")
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        end = lambda i: F.when(i == F.size(gone), F.size(lines)).otherwise(F.get(gone, i))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i)))), "\n")

    # the one-element array binds the split text to a name, so that it is split once and not for each stretch
    rest = F.get(F.transform(F.array(F.split(text, "\n")), without), F.lit(0))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    gone = F.coalesce(F.col("found.gone"), F.array().cast("array<int>"))
    return both.select("rows", gone.alias("gone"), n_lines.alias("n_lines"), F.when(F.col("found").isNull(), text).otherwise(rest).alias("rest"))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_removed, n_chars_left`` and the MD5 ``digest`` of the rest.

    A null text has no line and a null digest; an empty one is one line without words. Repeated rows are
    one text and lose the same lines. Other columns are not read. An empty table gives an empty result.
    """
    found = cleaned(docs, ["doc_id", "text"], min_words)
    return found.select(
        F.col("rows.doc_id").alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.coalesce(F.length("rest"), F.lit(0)).cast("long").alias("n_chars_left"),
        F.md5("rest").alias("digest"),
    )


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of runs cut from ``text`` (and ``n_chars`` counted anew, where there is one).

    A document that loses every line with words is a copy altogether and goes; one that had none stays, null
    and empty texts too. A null doc_id comes after all others, so its copies are the later ones. Rows equal in
    id and text are one text: they lose the same lines, none for each other. All columns are kept, whatever
    their names. An empty table gives an empty result.
    """
    found = cleaned(docs, docs.columns, min_words)
    empty = (F.size("gone") > 0) & ~F.coalesce(F.col("rest").rlike(WORD), F.lit(False))
    new = {"text": F.col("rest")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("gone") == 0, F.col("rows.n_chars")).otherwise(F.length("rest")).cast(docs.schema["n_chars"].dataType)
    return found.where(~empty).select(*[new.get(c, F.col("rows").getField(c)).alias(c) for c in docs.columns])


#: The same rows in DuckDB's SQL: every window's text is spelt out.
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS line FROM documents
), worded AS (
  SELECT doc_id, idx, trim(line, ' ') AS line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM lines
), seq AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i, row_number() OVER (ORDER BY doc_id, idx) AS pos,
    sum(w) OVER (PARTITION BY doc_id ORDER BY idx) AS after FROM worded WHERE w > 0
), windows AS (
  SELECT DISTINCT doc_id, start, n FROM (
    SELECT a.doc_id, a.pos AS start, min(b.pos) - a.pos + 1 AS n FROM seq a JOIN seq b
      ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {MIN_WORDS} AND b.after - a.after + a.w >= {MIN_WORDS} GROUP BY a.doc_id, a.pos
    UNION ALL
    SELECT a.doc_id, max(b.pos) AS start, a.pos - max(b.pos) + 1 AS n FROM seq a JOIN seq b
      ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - {MIN_WORDS} AND a.pos AND a.after - b.after + b.w >= {MIN_WORDS} GROUP BY a.doc_id, a.pos)
), spelt AS (
  SELECT start, n, md5(string_agg(line, chr(10) ORDER BY pos)) AS content FROM windows v JOIN seq s ON s.pos BETWEEN v.start AND v.start + v.n - 1 AND s.doc_id = v.doc_id GROUP BY start, n
), later AS (
  SELECT start, n FROM (SELECT *, min(start) OVER (PARTITION BY n, content) AS origin FROM spelt) WHERE origin + n <= start
), gone AS (
  SELECT DISTINCT s.doc_id, s.idx FROM later l JOIN seq s ON s.pos BETWEEN l.start AND l.start + l.n - 1
), per AS (
  SELECT l.doc_id, count(g.idx) AS n_removed, string_agg(line, chr(10) ORDER BY l.idx) FILTER (g.idx IS NULL) AS rest
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.idx = g.idx GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN text IS NULL THEN 0 ELSE length(coalesce(rest, '')) END::BIGINT AS n_chars_left, CASE WHEN text IS NULL THEN NULL ELSE md5(coalesce(rest, '')) END AS digest
FROM documents d LEFT JOIN per USING (doc_id)
"""
