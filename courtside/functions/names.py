"""Normal forms of team names. Spark has no Unicode decomposition, so accents go in a vectorised UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that sources add to a club's name or leave out (fixed values).
CLUB_WORDS = "bc|basket|basketball|club|sad|sporting|sports"


#: Characters, about, of which Python holds the names before it gives them back.
PORTION = 1_000_000


def _bare(name: str | None) -> str | None:
    return name and "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))


def _strip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        held, size = [], 0
        for name in batch:
            held.append(_bare(name.as_py()))
            size += 1 + len(held[-1] or "")
            if size >= PORTION:
                yield pa.array(held, pa.string())
                held, size = [], 0
        if held or not len(batch):
            yield pa.array(held, pa.string())


def without_accents(name: Column | str) -> Column:
    """NFKD without combining marks. Names in ASCII are that already and don't go to Python."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.arrow_udf(_strip, "string")(F.when(name.rlike(r"[^\x00-\x7F]"), name)), name)


def team_key(name: Column) -> Column:
    """For entity resolution: no accents, lower case, no white space, no hyphens."""
    return F.regexp_replace(F.lower(without_accents(name)), r"[\s-]+", "")


def source_key(name: Column) -> Column:
    """For fusion: no accents, lower case, club words removed, single spaces."""
    bare = F.regexp_replace(F.lower(without_accents(name)), rf"\b({CLUB_WORDS})\b", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def latin1(text: Column) -> Column:
    """Text that a Latin-1 document can hold: accents removed, other characters as ``?``."""
    return F.regexp_replace(without_accents(text), r"[^\x00-\xFF]", "?")
