"""SimHash near-duplicates by multi-index hashing (operator 10).

Two fingerprints that differ in at most three of 64 bits differ in at most one bit of their upper or
of their lower half. Every distinct fingerprint is stored under both halves and looked up under the
33 values of the one-bit ball around each half; a match is kept if the whole distance is three or less.
Copies share a fingerprint, so they enter the search once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import BROADCAST_IDS, Scratch, components

SEED = 42
MAX_BITS = 3
SHINGLE = 3
#: Fingerprints at one value of a half from which on they are looked up by their other bits too.
CROWD = 64
#: A whole text is hashed in pieces of this many shingles, so that a very long one takes bounded memory.
PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text; zero if it has no word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, split at ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PIECE):
        h = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(n, at + PIECE))], dtype="<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * bits > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of each whole text as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def fingerprint_components(scratch: Scratch, fps: DataFrame) -> DataFrame:
    """``(node, root)`` for the distinct fingerprints ``fp`` that differ in three bits or fewer from another.

    First each is compared with the least one of each of its halves. What that joins is not compared again:
    of the probes of a ball only those go on that reach a half where another component lives, and only
    pairs of different components are made. A half with more than ``CROWD`` fingerprints is split by the
    four segments of the other half, one of which is equal in any two that are three bits apart. So a large
    group costs no square of its size, and every link that could join two components is found.
    """
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.array(F.struct(F.lit(0).alias("part"), low.alias("at")), F.struct(F.lit(1).alias("part"), high.alias("at")))
    key = ["part", "at"]
    homes = fps.select("fp", F.inline(halves))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS

    leaders = scratch.save(homes.groupBy(*key).agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"))
    first = homes.withColumnRenamed("fp", "b").join(leaders, key).where((F.col("a") < F.col("b")) & near).select("a", "b")
    links = scratch.save(first.distinct())
    roots = scratch.save(components(scratch, links))
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    lived = scratch.save(placed.select("fp", "root", F.inline(halves)))
    spans = scratch.save(lived.groupBy(*key).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")))

    # of a half that many live at, the rest of the bits is an index of its own: of four segments one is equal
    rest = F.when(F.col("part") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    segment = lambda i: F.struct(F.lit(i).alias("seg"), F.shiftright(F.col("rest"), 8 * i).bitwiseAND(F.lit(0xFF)).alias("val"))
    finer = F.inline(F.when(F.col("n") > CROWD, F.array(*map(segment, range(4)))).otherwise(F.array(F.struct(F.lit(-1).alias("seg"), F.lit(0).cast("long").alias("val")))))
    homes = lived.withColumn("rest", rest)
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    probes = homes.select("part", F.explode(F.transform(ball, lambda m: F.col("at").bitwiseXOR(m))).alias("at"), F.col("fp").alias("a"), "root", "rest")
    foreign = probes.join(spans, key).where("low <> root or high <> root").select(*key, "a", "root", finer)
    there = homes.join(spans.select(*key, "n"), key).select(*key, F.col("fp").alias("b"), F.col("root").alias("other"), finer)
    second = foreign.join(there, [*key, "seg", "val"]).where((F.col("root") != F.col("other")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return components(scratch, scratch.save(links.union(second.distinct())))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Null or wordless texts have fingerprint zero and link like any other. Repeated rows are one text,
    returned as often as given. ``component_id`` is the smallest non-null doc_id that links reach; it is
    null only where no document of the component has an id. Other columns of ``docs`` are not read.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.save(fingerprints(docs, shingle))
    classes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = fingerprint_components(scratch, classes.select("fp"))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = scratch.save(named.select("fp", "root").join(least, "root").select("fp", "component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(of, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# --- documents that share most of their five-word shingles ------------------------------------------

#: Segments of the long fingerprint, and their bits. They only join large groups early, at a cost linear in them.
SEGMENTS, BITS = 12, 32
#: Bits of the long fingerprint that are worth comparing shingles at that point. Which links are found doesn't depend on it.
FAR = 64
SIMILARITY, WORDS = 0.8, 5
#: Shingles with OFTEN copies in one of SAMPLE texts come last in the order of shingles, the LISTED most usual at
#: most. Any order finds the same links; one that has the usual ones last finds them with fewer candidates.
SAMPLE, OFTEN, LISTED = 16, 8, 100_000
#: Members of a key that are compared at once.
CHUNK = 512
#: Candidate pairs of a block for each of its rows, up to which they become rows; more are compared in the block.
SPARSE = 2


def _mixed(z: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``z``."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _words(text: str | None) -> np.ndarray:
    """The hash of each word, A-Z in lower case."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, SEED) for w in (text or "").encode().lower().split()], dtype=np.uint64)


def _hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles, in order; fewer words are one shingle."""
    n = max(1, len(words) - k + 1)
    h = np.full(n, min(k, len(words)), dtype=np.uint64)
    for j in range(min(k, len(words))):  # the order of the words counts, as each is mixed into what precedes it
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def long_fingerprint(words: np.ndarray) -> np.ndarray:
    """The fingerprint of the two-word shingles of hashed words as SEGMENTS unsigned words.

    Two-word shingles change less under an edit than those by which similarity is measured.
    """
    h = _hashes(words, 2)
    total = np.zeros(SEGMENTS * BITS, dtype=np.int64)
    lanes = np.arange(SEGMENTS * BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255):  # 64 bits more of each hash for each lane; a byte holds the count of 255 of them
        z = _mixed(h[at : at + 255, None] + lanes)
        total += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    margin = (2 * total - len(h)).reshape(SEGMENTS, BITS)
    return ((margin > 0) * (1 << np.arange(BITS, dtype=np.int64))).sum(axis=1)


def prefix(words: np.ndarray, usual: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int, bytes]:
    """The first shingles of a text of hashed words in an order that all texts share, the number of all, and a
    bitmap of all, two to four bits for each.

    Of two similar texts with n shingles each has at least ``SIMILARITY * n`` in common with the other, so the
    first that both have is among the first ``n - SIMILARITY * n + 1`` of either.
    """
    h = _hashes(words, WORDS).view(np.int64)
    values, places = usual
    late = np.zeros(len(h), dtype=np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, h), len(values) - 1)
        late = np.where(values[at] == h, places[at], 0)
    bits = np.zeros(max(8, 1 << (2 * len(h) - 1).bit_length()), dtype=np.uint8)
    bits[h & (len(bits) - 1)] = 1
    return h[np.lexsort((h, late))][: int((1 - SIMILARITY) * len(h) + 1e-6) + 1], len(h), np.packbits(bits, bitorder="little").tobytes()


def _text_hashes() -> list:
    """What tells texts apart: 128 bits of hashes."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def _usual(scratch: Scratch, docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most usual shingles by value, and the place of each in the order, from 1."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.record_batch([pa.array(_hashes(_words(t.as_py()), WORDS).view(np.int64))], ["shingle"])

    sample = docs.where(F.pmod(_text_hashes()[0], F.lit(SAMPLE)) == 0).select("text")
    often = scratch.save(sample.mapInArrow(shingled, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN))
    least, listed = 0, 0
    for n, shingles in sorted(map(tuple, often.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        listed += shingles
        if listed > LISTED:
            least = n + 1
            break
    found = sorted((n, h) for h, n in often.where(F.col("n") >= least).collect())
    scratch.drop(often)
    values, places = np.array([h for _, h in found], dtype=np.int64), np.arange(1, len(found) + 1)
    order = np.argsort(values)
    return values[order], places[order]


def _signed(usual: tuple[np.ndarray, np.ndarray]):
    """(doc_id, t1, t2, text) -> the fields, the segments, the first shingles, the number and the bitmap of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [_words(t.as_py()) for t in part.column(3)]
                firsts = [prefix(t, usual) for t in texts]
                segments = pa.array([long_fingerprint(t) for t in texts], pa.list_(pa.int64()))
                keys, sizes, bits = (pa.array(x, t) for x, t in zip(zip(*firsts), (pa.list_(pa.int64()), pa.int32(), pa.binary())))
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), segments, keys, sizes, bits], ["doc_id", "t1", "t2", "segments", "keys", "size", "bits"])

    return run


def _sets(scratch: Scratch, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(cid, set)``: the five-word shingles of the classes ``wanted(cid, t1, t2)``, hashed to 32 bits.

    Two of a thousand different shingles of a text fall together once in ten thousand texts.
    """
    n = wanted.count()
    texts = docs.select(*_text_hashes(), "text").join(F.broadcast(wanted) if n <= BROADCAST_IDS // 3 else wanted.hint("shuffle_hash"), ["t1", "t2"]).select("cid", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [np.unique(_hashes(_words(t.as_py()), WORDS).astype(np.uint32)).view(np.int32) for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int32()))], ["cid", "set"])

    # copies of a text give one row each and are one class
    return scratch.save(texts.mapInArrow(shingled, "cid long, set array<int>").groupBy("cid").agg(F.first("set").alias("set")))


def _near(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` of classes those whose long fingerprints are near."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("segments").alias(f"s{c}"))
    distance = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(distance <= FAR).select("a", "b")


def _verified(scratch: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` of classes those whose shingles are similar."""
    near = scratch.save(pairs.distinct())
    wanted = scratch.save(near.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "t1", "t2"), "cid"))
    sets = _sets(scratch, docs, wanted)
    of = lambda c: sets.select(F.col("cid").alias(c), F.col("set").alias(f"s{c}"))
    both = near.join(of("a"), "a").join(of("b"), "b")
    common, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return scratch.save(both.where(common >= SIMILARITY * (total - common)).select("a", "b"))


def _candidates(root, pos, size) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block that are in different components so far and may be similar: by their sizes, and by what
    follows the key in both, as one key of a pair is the first that both have."""
    left, all_ = size - pos, np.add.outer(size, size)
    able = np.minimum.outer(left, left) >= SIMILARITY / (1 + SIMILARITY) * all_ - 1e-6
    able &= np.minimum.outer(size, size) >= SIMILARITY / (1 + SIMILARITY) * all_ - 1e-6
    return np.nonzero(np.triu(able & (root[:, None] != root[None]), 1))


def _block_links(cid, root, pos, size, sets) -> list[tuple[int, int]]:
    """A spanning forest of the links among the documents of a block that are in different components so far."""
    i, j = _candidates(root, pos, size)
    up = {r: r for r in root.tolist()}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    held: dict[int, set] = {}
    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(int(root[a])), find(int(root[b]))
        if x == y:
            continue
        for k in (a, b):
            if k not in held:
                held[k] = set(sets[k].tolist())
        common = len(held[a] & held[b])
        if common >= SIMILARITY * (len(held[a]) + len(held[b]) - common):
            up[max(x, y)] = min(x, y)
            out.append((int(cid[a]), int(cid[b])))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows (key, a, b, ...), sorted by these -> the columns of each block of two rows and more."""

    def numbers(column) -> np.ndarray:
        if not pa.types.is_list(column.type):
            return column.to_numpy(zero_copy_only=False)
        lists = np.empty(len(column), dtype=object)
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        for k in range(len(column)):
            lists[k] = values[offsets[k] : offsets[k + 1]]
        return lists

    rest: list | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            cols = [numbers(c) for c in batch.slice(at, 1024).columns]
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols)]
            change = np.zeros(len(cols[0]), dtype=bool)
            for k in cols[:3]:
                change[1:] |= k[1:] != k[:-1]
            edges = [0, *np.nonzero(change)[0].tolist()]  # the last block may go on in the next rows
            for s, e in zip(edges, edges[1:]):
                if e - s > 1:
                    yield [c[s:e] for c in cols]
            rest = [c[edges[-1] :] for c in cols]
    if rest is not None and len(rest[0]) > 1:
        yield rest


def _in_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, cid, root, pos, size), sorted by block -> those that are in a candidate pair."""
    found: list = []
    names = ["key", "a", "b", "cid", "root", "pos", "size"]
    batch = lambda: pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found)], names)
    for cols in _blocks(batches):
        kept = np.unique(np.concatenate(_candidates(*cols[4:7])))
        if len(kept):
            found.append([c[kept] for c in cols])
        if len(found) >= 4096:
            yield batch()
            found = []
    if found:
        yield batch()


def _missing(a: bytes, b: bytes) -> tuple[int, int]:
    """How many shingles of each are not in the other, at least: bits that are set in one bitmap only."""

    def folded(x: bytes, n: int) -> int:
        whole = 0
        for at in range(0, len(x), n):
            whole |= int.from_bytes(x[at : at + n], "little")
        return whole

    n = min(len(a), len(b))
    x, y = folded(a, n), folded(b, n)
    return (x & ~y).bit_count(), (y & ~x).bit_count()


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, cid, root, pos, size, bits), sorted by block -> candidate pairs (cid, other) that the bitmaps
    allow, or, where a block has more than SPARSE for each row, its rows in such pairs, with other null."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = ["key", "a", "b", "cid", "root", "pos", "size", "other"]
    found: list = []
    batch = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
    for cols in _blocks(batches):
        size, bits = cols[6].tolist(), cols[7]
        pairs = []
        for i, j in zip(*(x.tolist() for x in _candidates(*cols[4:7]))):
            x, y = _missing(bits[i], bits[j])
            if min(size[i] - x, size[j] - y) >= SIMILARITY / (1 + SIMILARITY) * (size[i] + size[j]) - 1e-6:
                pairs.append((i, j))
        rows = list(zip(*(c.tolist() for c in cols[:7])))
        if len(pairs) <= SPARSE * len(rows):
            found += [(*rows[i], rows[j][3]) for i, j in pairs]
        else:
            found += [(*rows[i], None) for i in sorted({k for pair in pairs for k in pair})]
        if len(found) >= 8192:
            yield batch()
            found = []
    if found:
        yield batch()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, cid, root, pos, size, set), sorted by block -> links (a, b)."""
    for cols in _blocks(batches):
        if found := _block_links(*cols[3:]):
            yield pa.record_batch([pa.array([p[0] for p in found]), pa.array([p[1] for p in found])], ["a", "b"])


def _blocked(scratch: Scratch, docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """Links of different components among ``members(key, cid, root, pos, size)`` of each key.

    Thinned out inside tasks by what size, place and bitmaps allow. What is left of a block with few candidates for
    each row is compared pair by pair, once for all keys of a pair; of others inside tasks, where what comes out is
    a forest, not the pairs. Keys with many members are cut into chunks, and pairs of chunks are tasks of their own.
    """
    block = ["key", "a", "b"]
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("cid", F.lit("chunk")), F.col("chunks")).cast("int")
    dealt = members.join(sizes, "key").withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "cid", "root", "pos", "size")
    by_block = lambda df, work, schema: scratch.save(df.repartition(*block).sortWithinPartitions(*block).mapInArrow(work, schema))
    kept = by_block(dealt, _in_pairs, "key long, a int, b int, cid long, root long, pos int, size int")
    thin = by_block(kept.join(classes.select("cid", "bits"), "cid").select(*kept.columns, "bits"), _thinned, "key long, a int, b int, cid long, root long, pos int, size int, other long")
    pairs = thin.where("other is not null").select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b"))
    dense = thin.where("other is null").drop("other")
    wanted = scratch.save(dense.select("cid").distinct().join(classes.select("cid", "t1", "t2"), "cid"))
    rows = dense.join(_sets(scratch, docs, wanted), "cid").select(*kept.columns, "set")
    scratch.drop(kept)
    return by_block(rows, _compared, "a long, b long").union(_verified(scratch, docs, classes, pairs))


def _decided(docs: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, component_id, stays`` for each row: its text by hashes, and whether this id with this text
    is the one that stays of its component."""
    scratch = Scratch(docs.sparkSession, "similar")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("doc_id", *_text_hashes(), "text").mapInArrow(_signed(_usual(scratch, docs)), f"doc_id {kind}, t1 long, t2 long, segments array<long>, keys array<long>, size int, bits binary")
    signed = scratch.save(signed)
    ids = scratch.save(signed.select("doc_id", "t1", "t2"))
    once = signed.groupBy("t1", "t2").agg(*[F.first(c).alias(c) for c in ("segments", "keys", "size", "bits")], F.min("doc_id").alias("least"))
    classes = scratch.save(once.withColumn("cid", F.monotonically_increasing_id()))
    scratch.drop(signed)
    # a key is the number of its segment above the 32 bits of a value
    homes = classes.select("cid", F.posexplode("segments").alias("i", "value")).select("cid", (F.shiftleft(F.col("i").cast("long"), BITS) + F.col("value")).alias("key"))

    leaders = scratch.save(homes.groupBy("key").agg(F.min("cid").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"))
    first = homes.join(leaders, "key").where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b"))
    links = _verified(scratch, docs, classes, _near(classes, first))
    roots = scratch.save(components(scratch, links))
    firsts = classes.select("cid", "size", "keys").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(F.posexplode("keys").alias("pos", "key"), "cid", F.coalesce("root", "cid").alias("root"), "size")
    spans = firsts.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    members = scratch.save(firsts.join(spans, "key").select("key", "cid", "root", "pos", "size"))
    links = scratch.save(links.union(_blocked(scratch, docs, classes, members)))
    scratch.drop(members)

    roots = components(scratch, links)
    named = classes.select("cid", "t1", "t2", "least").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = scratch.save(named)
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "t1", "t2"))).alias("first")
    of = scratch.save(named.join(named.groupBy("root").agg(first), "root").select("t1", "t2", "first"))
    stays = (F.col("doc_id") == F.col("first.least")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    return ids.join(of, ["t1", "t2"]).select("doc_id", "t1", "t2", F.col("first.least").alias("component_id"), stays.alias("stays"))


def similar(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, component_id``, documents linked where the Jaccard similarity of their
    five-word shingles (lower-case, white space aside) is ``SIMILARITY`` or more.

    Equal texts are one class. First each class is compared with the least class of each segment of its long
    fingerprint, which joins large groups of near copies at a cost that is linear in them. Then those whose
    components still differ are compared if they share one of their first shingles (see ``prefix``), as all
    similar texts do: no link between components is lost, wherever the texts differ. Null and wordless texts
    are alike. A null doc_id names no component. Other columns are not read. An empty table gives an empty result.
    """
    return _decided(docs).select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of similar ones: the one with the smallest id.

    Documents without an id stay, as no decision can name them. Repeated rows of one id and text become one; an id
    that stands for several texts is decided for each of them. Null and wordless texts are alike, so one of them stays.
    All columns are kept, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    found = scratch.save(_decided(docs))
    key = ["doc_id", "t1", "t2"]
    named = found.select(*key, "stays").where("doc_id is not null")
    away = scratch.save(named.where("not stays").select(*key).distinct())
    t1, t2 = _text_hashes()
    # the caller's columns go in one, so that none of them meets a name in here
    rows = docs.select(F.struct(*docs.columns).alias("rows"), "doc_id", t1.alias("t1"), t2.alias("t2"))
    kept = rows.join(F.broadcast(away) if away.count() <= BROADCAST_IDS // 3 else away, key, "left_anti")
    twice = named.where("stays").groupBy(*key).count().where("count > 1").limit(1).count()
    if twice:
        kept = kept.where("doc_id is null").union(kept.where("doc_id is not null").dropDuplicates(key))
    return kept.select(*[F.col("rows").getField(c).alias(c) for c in docs.columns])
