"""Fill-in-middle transformation by escaped marker injection (operator 12).

A delimiter that stands in a text is escaped, then appended to every unit of the text. Units are thereby counted,
and taken by rank with ``substring_index``; what is taken is joined and unescaped again. All of it is built-in
functions of one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is a line with its end, or the rest of the text.
UNIT = r"[^\n]*\n|[^\n]+"
#: Percentage of texts that are transformed, and of those that come suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: What ends a unit inside, and what escapes it: two control characters and the letters that stand for them.
DELIMITER, ESCAPE = "\x1e", "\x1b"
_ESCAPED = ((ESCAPE, f"{ESCAPE}e"), (DELIMITER, f"{ESCAPE}d"))


def marked(text: Column, unit: str = UNIT) -> Column:
    """``text`` with the delimiter behind each unit, and escaped where the text itself has it."""
    for plain, escaped in _ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.regexp_replace(text, unit, f"$0{DELIMITER}")


def unmarked(units: Column) -> Column:
    """The text that marked units stand for."""
    out = F.replace(units, F.lit(DELIMITER), F.lit(""))
    for plain, escaped in reversed(_ESCAPED):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def _index(units: Column, n: Column) -> Column:
    """What stands before the n-th delimiter, or, of a negative n, behind the n-th from the end."""
    return F.call_function("substring_index", units, F.lit(DELIMITER), n.cast("int"))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from a digest of the seed and the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = UNIT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix, middle, suffix, text, output``.

    ``n`` counts the units of the whole text, a null text being an empty one. The prefix ends behind the smaller of
    two drawn ranks, the middle behind the larger. ``form`` is ``psm``, ``spm``, or ``plain`` where the text is
    empty, holds one of the three marks, or isn't drawn for the transformation; the parts of a plain text are null
    and its output is the text. ``unit`` must match every character of a text. Repeated rows are transformed alike,
    as the draws follow from the id; a null id is carried along. Other columns are not read. An empty table gives
    an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    units = docs.select("doc_id", text.alias("text"), marked(text, unit).alias("units"), F.array(*draws(F.col("doc_id"), seed)).alias("h"))
    counted = units.withColumn("n", (F.length("units") - F.length(F.replace("units", F.lit(DELIMITER), F.lit("")))).cast("long"))
    h = F.col("h")
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    whole = F.col("text") == ""
    for mark in (PREFIX, SUFFIX, MIDDLE):
        whole |= F.contains("text", F.lit(mark))
    form = F.when(whole | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    cut = counted.select("doc_id", "text", "units", "n", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), form.alias("form"))
    before = _index(F.col("units"), F.col("hi"))
    moved = F.col("form") != "plain"
    part = lambda x: F.when(moved, unmarked(x))
    # the text ends with a delimiter, so its last part by the delimiter is empty: one more than the units of the suffix
    parts = cut.select(
        "doc_id",
        "text",
        "n",
        "form",
        part(_index(F.col("units"), F.col("lo"))).alias("prefix"),
        part(F.when(F.col("hi") > F.col("lo"), _index(before, F.col("lo") - F.col("hi"))).otherwise("")).alias("middle"),
        part(_index(F.col("units"), F.col("hi") - F.col("n") - 1)).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", "text", output.alias("output"))


def _between(output: Column, first: str | None, last: str | None) -> Column:
    """What stands between two marks, each of which stands once."""
    if first:
        output = F.substring_index(output, first, -1)
    return F.substring_index(output, last, 1) if last else output


def restored(output: Column, form: Column) -> Column:
    """The text of an output: parts between marks, in their old order."""
    psm = F.concat(_between(output, PREFIX, SUFFIX), _between(output, MIDDLE, None), _between(output, SUFFIX, MIDDLE))
    spm = F.concat(_between(output, PREFIX, MIDDLE), _between(output, MIDDLE, None), _between(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``fill_in_middle`` in figures: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``.

    The text is rebuilt from the output and its form. Edge cases are those of ``fill_in_middle``.
    """
    out = fill_in_middle(docs, seed)
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", chars("prefix"), chars("middle"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same rows in DuckDB's SQL, by lists of lines.
SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), drawn AS (
  SELECT *, len(u)::BIGINT AS n, [('0x' || substr(d, 1 + 8 * k, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS h FROM lines
), formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
