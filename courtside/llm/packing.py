"""Conflict-constrained best-fit packing (operator 1).

Pieces of documents go into bins of a fixed number of words. A bin never holds two pieces of one source
or of one duplicate cluster: it carries a bitmap of both. Bins are ordered by residual; the search starts
at the first residual that fits and goes on to the next until the tightest compatible bin is found. A
tree over the residuals holds the AND of the bitmaps below each node, so a stretch in which every bin
has the same conflict is passed in one step. Shards of bounded size are packed on their own.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import Scratch, word_count

#: Words of a bin, and pieces that one task packs.
CAPACITY = 2048
SHARD_ROWS = 10_000


class Bins:
    """Open bins by residual, with the AND of the bitmaps of every stretch of residuals."""

    def __init__(self, capacity: int):
        self.capacity, self.width = capacity, 1 << capacity.bit_length()
        self.all = [-1] * (2 * self.width)  # -1, every bit set, marks a stretch without a bin
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bitmap: list[int] = []

    def _update(self, residual: int) -> None:
        i = residual + self.width
        self.all[i] = reduce(and_, (self.bitmap[b] for b in self.at[residual]), -1)
        while i > 1:
            i >>= 1
            new = self.all[2 * i] & self.all[2 * i + 1]
            if new == self.all[i]:
                return
            self.all[i] = new

    def _within(self, i: int, mask: int) -> tuple[int, int] | None:
        """The tightest compatible (residual, bin) below node i."""
        if self.all[i] & mask:
            return None
        if i >= self.width:
            residual = i - self.width
            return next(((residual, b) for b in self.at[residual] if not self.bitmap[b] & mask), None) if residual <= self.capacity else None
        return self._within(2 * i, mask) or self._within(2 * i + 1, mask)

    def find(self, words: int, mask: int) -> tuple[int, int] | None:
        """The tightest compatible (residual, bin) with residual >= words."""
        i = words + self.width
        while True:
            if found := self._within(i, mask):
                return found
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1

    def place(self, words: int, mask: int) -> int:
        found = self.find(words, mask)
        if found:
            residual, b = found
            self.at[residual].remove(b)
            self._update(residual)
        else:
            residual, b = self.capacity, len(self.bitmap)
            self.bitmap.append(0)
        self.bitmap[b] |= mask
        self.at[residual - words].append(b)
        self._update(residual - words)
        return b


def best_fit(words: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece, packed from the largest down. A bit a source, a bit a cluster of two or more."""
    bit: dict = {}
    many = {c for c, n in Counter(clusters).items() if n > 1}
    masks = [1 << bit.setdefault(("source", s), len(bit)) | (1 << bit.setdefault(("cluster", c), len(bit)) if c in many else 0) for s, c in zip(sources, clusters)]
    bins, out = Bins(capacity), [0] * len(words)
    for i in sorted(range(len(words)), key=lambda i: -words[i]):
        out[i] = bins.place(words[i], masks[i])
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster: str | None = None) -> DataFrame:
    """``bin_id, slot, doc_id, piece, from_word, words``: every word of every document in one bin.

    A text of more than ``capacity`` words is cut into pieces of that size and a rest. ``cluster`` names a
    column of duplicate clusters; by default texts that are equal but for case and white space form one.
    A null source is a source; a null text and an empty one are pieces of no word, of one cluster.
    Repeated rows are pieces of their own, of one cluster. Ids of any type, null ones too, come back as they
    are. Which of several equal sizes goes first follows the order of the rows. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    same = F.col(cluster) if cluster else F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")))
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64(same).alias("cluster"))
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / capacity) - 1).cast("int")
    pieces = sized.withColumn("row", F.monotonically_increasing_id()).withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.withColumn("from_word", F.col("piece").cast("long") * capacity)
    pieces = scratch.save(pieces.withColumn("words", F.least(F.col("size") - F.col("from_word"), F.lit(capacity)).cast("int")).drop("size"))
    n = pieces.count()
    shards = max(1, -(-n // shard_rows))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        bins = best_fit(*(table[c].to_pylist() for c in ("words", "source", "cluster")), capacity)
        held: Counter = Counter()
        slots = []
        for b in bins:
            slots.append(held[b])
            held[b] += 1
        shard = table["shard"][0].as_py() << 32
        return pa.table([pa.array(np.array(bins, dtype=np.int64) + shard), pa.array(slots, pa.int32()), *(table[c] for c in ("doc_id", "piece", "from_word", "words"))], ["bin_id", "slot", "doc_id", "piece", "from_word", "words"])

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("long"))
    return sharded.groupBy("shard").applyInArrow(run, f"bin_id long, slot int, doc_id {kind}, piece int, from_word long, words int")
