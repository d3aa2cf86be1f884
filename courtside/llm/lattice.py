"""Embedding near-duplicates by E8 lattice hashing (operator 9).

Each of several tables projects a unit vector to eight dimensions and decodes it to the nearest point of
the E8 lattice, its home cell; it also probes the neighbouring cells that lie closest. Vectors that meet
in a cell, at least one of them at home, are compared by cosine in double precision. Equal vectors are one
class and are hashed once. A cell with many classes is cut into chunks, and pairs of chunks are compared
in tasks of their own; a task returns counts and a spanning forest, not pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import Scratch, components

MIN_COSINE = 0.98
#: Tables, probed neighbours of the home cell, and the cell width for 64 dimensions. A pair at the
#: threshold is missed by one table in 80 and so by all three in two of a million (measured by simulation).
TABLES, PROBES, WIDTH = 3, 8, 0.15
#: Classes of a cell that are compared at once.
CHUNK = 1024


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [[(s if k == i else t if k == j else 0) for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*pairs, *halves], dtype=float)


ROOTS = roots()


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with even sums: round, and turn the worst coordinate where the sum is odd."""
    f = np.rint(x)
    rest = x - f
    (odd,) = np.nonzero(f.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    f[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of two shifted copies of D8."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cells(u: np.ndarray) -> np.ndarray:
    """Codes of unit vectors: (rows, TABLES, 1 + PROBES), the home cell first."""
    n, dim = u.shape
    out = np.empty((n, TABLES, 1 + PROBES), dtype=np.int64)
    for t in range(TABLES):
        rng = np.random.default_rng([8, t, dim])
        g = rng.normal(size=(dim, 8))
        g = np.linalg.qr(g)[0] if dim >= 8 else g / np.sqrt(dim)
        key = rng.integers(-(2**62), 2**62, size=8) * 2 + 1
        x = u @ g * (np.sqrt(dim / 64) / WIDTH) + rng.random(8)
        home = decode(x)
        near = np.argpartition(-((x - home) @ ROOTS.T), PROBES, axis=1)[:, :PROBES]
        points = np.concatenate([home[:, None, :], home[:, None, :] + ROOTS[near]], axis=1)
        with np.errstate(over="ignore"):
            code = (np.rint(2 * points).astype(np.int64) * key).sum(axis=2)
            out[:, t, :] = (code ^ (code >> 29)) * np.int64(0x1B873593 * 2 + 1) + t
    return out


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_size(b: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors, for each length of vector in column ``at``."""
    lengths = np.diff(b.column(at).offsets.to_numpy())
    for n in np.unique(lengths):
        rows = np.nonzero(lengths == n)[0]
        yield rows, _matrix(b.column(at).take(pa.array(rows)))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, label key, vector) -> (cid, key, tab, code, home)."""
    for b in batches:
        for rows, v in _by_size(b, 2):
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                code = cells(units(v[at : at + 4096]))
                each = TABLES * (1 + PROBES)
                home = np.zeros((len(part), TABLES, 1 + PROBES), dtype=bool)
                home[:, :, 0] = True
                tab = np.broadcast_to(np.arange(TABLES, dtype=np.int32)[None, :, None], code.shape)
                take = pa.array(np.repeat(part, each))
                yield pa.record_batch(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(tab.reshape(-1)), pa.array(code.reshape(-1)), pa.array(home.reshape(-1))], ["cid", "key", "tab", "code", "home"]
                )


def _links(cid, weight, u, home, left, right, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a block of one cell: cids with new links, their number, and the least cid they reach in the block.

    A pair counts here only if no earlier table brings it together and, where each of the two probes the
    other's home, in the home of the smaller cid: so every linked pair counts once in the whole search.
    """
    same = left == right  # one chunk against itself
    a, b = np.nonzero(left)[0], np.nonzero(right)[0]
    if not same.all():
        i, j = np.nonzero(u[a] @ u[b].T >= MIN_COSINE)
        i, j = a[i], b[j]
    else:
        i, j = np.nonzero(np.triu(u @ u.T >= MIN_COSINE, 1))
    ok = home[i] | home[j]
    i, j = i[ok], j[ok]
    if not len(i):
        return None
    keep = np.ones(len(i), dtype=bool)
    some = np.unique(np.concatenate([i, j]))  # codes of those only that have a near one here
    codes = np.empty((len(u), TABLES, 1 + PROBES), dtype=np.int64)
    codes[some] = cells(u[some])
    for s in range(0, len(i), 1 << 17):
        x, y = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
        first = np.ones(len(x), dtype=bool)
        for t in range(table + 1):
            hx, hy = codes[x, t, 0], codes[y, t, 0]
            x_to_y = (codes[x, t, 1:] == hy[:, None]).any(axis=1)
            y_to_x = (codes[y, t, 1:] == hx[:, None]).any(axis=1)
            if t < table:
                first &= ~((hx == hy) | x_to_y | y_to_x)
            else:
                twice = x_to_y & y_to_x & (hx != hy)
                here = np.where(cid[x] < cid[y], home[x], home[y])
                first &= ~twice | here
        keep[s : s + (1 << 17)] = first
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    n = np.bincount(i, weights=weight[j], minlength=len(cid)) + np.bincount(j, weights=weight[i], minlength=len(cid))
    root = cid.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        if (new == root).all():
            break
        root = new
    (rows,) = np.nonzero(n)
    return cid[rows], n[rows].astype(np.int64), root[rows]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, tab, code, a, b, home, chunk, cid, members, vector) -> (cid, links, root)."""

    def blocks(rest: list | None, cols: list, last: bool):
        """Whole blocks among the rows at hand, and what is left of the last one."""
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        keys = cols[:5]
        change = np.zeros(len(keys[0]), dtype=bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        edges = [0, *np.nonzero(change)[0].tolist()]
        ends = [*edges[1:], len(change)]
        whole = list(zip(edges, ends)) if last else list(zip(edges, ends))[:-1]
        return whole, cols, None if last else [c[edges[-1] :] for c in cols]

    def results(whole, cols):
        found = []
        for s, e in whole:
            if e - s < 2:
                continue
            key, tab, code, a, b, home, chunk, cid, members, u = (c[s:e] for c in cols)
            if (out := _links(cid, members, u, home, chunk == a[0], chunk == b[0], int(tab[0]))) is not None:
                found.append(out)
        if found:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)], ["cid", "links", "root"])

    rest = None
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            # one length of vector at a time: a key stands for one label and length, so blocks stay whole
            for rows, v in _by_size(part, 9):
                u = units(v)
                cols = [part.column(k).take(pa.array(rows)).to_numpy(zero_copy_only=False) for k in range(9)] + [u]
                if rest is not None and rest[9].shape[1] != u.shape[1]:
                    yield from results(*blocks(None, rest, True)[:2])
                    rest = None
                whole, all_cols, rest = blocks(rest, cols, False)
                yield from results(whole, all_cols)
    if rest is not None:
        yield from results(*blocks(None, rest, True)[:2])


def near_duplicates(vectors: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared only if their labels are equal. One that is null, empty, zero or holds a null or a
    non-finite component, and one without a label, links with nothing and is its own component. Repeated
    rows and equal vectors link with each other. ``component_id`` is the least vec_id that links reach. Null
    vec_ids are never a component's name: where no vector of a component has an id, name and kept are null.
    """
    scratch = Scratch(vectors.sparkSession, "lattice")
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull()
    grouped = v.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("members"))
    classes = scratch.save(grouped.withColumn("cid", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("label", F.size("embedding"))))

    codes = scratch.save(classes.select("cid", "key", "embedding").mapInArrow(_codes, "cid long, key long, tab int, code long, home boolean"))
    cell = ["key", "tab", "code"]
    sizes = codes.groupBy(*cell).agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("n > 1 and lived")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    of = F.pmod(F.xxhash64("cid", F.lit("chunk")), F.col("chunks")).cast("int")
    meets = codes.join(sizes.select(*cell, chunks.alias("chunks")), cell).withColumn("chunk", of)
    meets = meets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    meets = meets.select(*cell, F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "home", "chunk", "cid")
    block = [*cell, "a", "b"]
    loaded = meets.join(classes.select("cid", "members", "embedding"), "cid").select(*block, "home", "chunk", "cid", "members", "embedding")
    linked = scratch.save(loaded.repartition(*block).sortWithinPartitions(*block).mapInArrow(_compare, "cid long, links long, root long"))

    roots_ = components(scratch, linked.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "least", "members", "label", "embedding").join(links, "cid", "left").join(roots_.withColumnRenamed("node", "cid"), "cid", "left")
    named = scratch.save(named.withColumn("root", F.coalesce("root", "cid")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("members") - 1).drop("links"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("label", "embedding", "n_links", "component_id")
    joined = v.where(usable).join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = v.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The same rows by brute force in DuckDB's SQL.
SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN degree d ON d.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""
