"""Centroid clustering by ball-tree filtering (operator 11).

Vectors are whole numbers. Each task builds metric trees over the vectors that it reads, up to some thousands a
tree; a ball stores its centre, radius, number and integer sum of its vectors. A round sends the centroids to the
trees: where the triangle inequality leaves a ball one nearest centroid, its number and sum are taken as they are,
otherwise the centroids that can't be nearest are dropped and its two halves are asked, down to leaves, which are
compared exactly. What comes back is one count and sum of each centroid and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import Scratch

DIM, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Vectors of a tree and of a leaf.
TREE_ROWS, LEAF_ROWS = 8192, 32
#: Components lie below this, so that squared distances fit in a long.
LARGEST = 1 << 27

TREE_SCHEMA = "ids array<long>, null_id array<boolean>, points array<int>, starts array<int>, ends array<int>, childs array<int>, centres array<double>, radii array<double>, sums array<long>"


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: vectors of ``dim`` components, none null or not finite, as ``floor(scale * x)``."""
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    fine = (F.size("x") == dim) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(F.lit(float(scale)) * c)
    large = F.raise_error(F.concat(F.lit(f"a component of {scale} times a vector is {LARGEST} or more: its squared distances don't fit in a long; vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    checked = F.when(F.forall("x", lambda c: F.abs(c) < LARGEST / scale), F.transform("x", lambda c: whole(c).cast("int"))).otherwise(large.cast("array<int>"))
    return x.where(F.coalesce(fine, F.lit(False))).select("vec_id", checked.alias("v"))


def grown(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of ``points`` (whole numbers) in their tree, and its balls: from, to, first child, centre, radius, sum.

    A ball is split across the line through two of its far points, at the median; equal points are one leaf.
    """
    order = np.arange(len(points))
    x = points.astype(np.float64)
    starts, ends, childs, centres, radii, sums = [0], [len(points)], [], [], [], []
    at = 0
    while at < len(starts):  # balls are appended level by level
        lo, hi = starts[at], ends[at]
        mine = x[order[lo:hi]]
        total = points[order[lo:hi]].sum(axis=0, dtype=np.int64)
        centre = total / (hi - lo)
        far = ((mine - centre) ** 2).sum(axis=1)
        centres.append(centre)
        radii.append(float(np.sqrt(far.max())))
        sums.append(total)
        a = mine[far.argmax()]
        from_a = ((mine - a) ** 2).sum(axis=1)
        if hi - lo <= leaf_rows or not from_a.any():
            childs.append(-1)
        else:
            b = mine[from_a.argmax()]
            half = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(mine @ (b - a), half)]
            childs.append(len(starts))
            starts += [lo, lo + half]
            ends += [lo + half, hi]
        at += 1
    return order, {"starts": np.array(starts, np.int32), "ends": np.array(ends, np.int32), "childs": np.array(childs, np.int32), "centres": np.array(centres), "radii": np.array(radii), "sums": np.array(sums)}


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole vectors, exactly: in doubles where every intermediate number fits in their 53 bits."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    a, b = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def assigned(tree: dict[str, np.ndarray], points: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """``(from, to, centroid, sum)`` of balls that go to one centroid whole, ``(from, to, None, centroids)`` of leaves.

    Distances from centres are doubles; a margin far above their error keeps ties and close calls for the leaves.
    """
    c = centroids.astype(np.float64)
    todo, open_ = np.array([0]), np.ones((1, len(c)), dtype=bool)
    while len(todo):
        far = np.sqrt(((tree["centres"][todo][:, None, :] - c) ** 2).sum(axis=2)) if len(todo) * c.size < 1 << 20 else np.stack([np.sqrt(((tree["centres"][t] - c) ** 2).sum(axis=1)) for t in todo])
        far[~open_] = np.inf
        best = far.argmin(axis=1)
        reach = far.min(axis=1) + 2 * tree["radii"][todo]
        open_ &= far <= (reach * (1 + 1e-9) + 1e-3)[:, None]
        single = open_.sum(axis=1) == 1
        leaf = tree["childs"][todo] < 0
        for k in np.nonzero(single | leaf)[0]:
            lo, hi = tree["starts"][todo[k]], tree["ends"][todo[k]]
            if single[k]:
                yield lo, hi, int(best[k]), tree["sums"][todo[k]]
            else:
                near = np.nonzero(open_[k])[0]
                yield lo, hi, None, near
        down = np.nonzero(~single & ~leaf)[0]
        first = tree["childs"][todo[down]]
        todo, open_ = np.concatenate([first, first + 1]), np.concatenate([open_[down], open_[down]])


def _tree(row: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A stored tree and its points."""
    flat = {k: np.asarray(row[k]) for k in ("points", "starts", "ends", "childs", "centres", "radii", "sums")}
    dim = len(flat["centres"]) // len(flat["starts"])
    return {**flat, "centres": flat["centres"].reshape(-1, dim), "sums": flat["sums"].reshape(-1, dim)}, flat["points"].reshape(-1, dim)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].values.to_numpy(zero_copy_only=False) for name in batch.schema.names}


def trees(scratch: Scratch, whole: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Trees over the partitions of ``whole(vec_id, v)`` as they are read, a row each: no vector is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, tree_rows - n)
                held.append(part)
                n += part.num_rows
                b = b.slice(part.num_rows)
                if n == tree_rows:
                    yield one(held)
                    held, n = [], 0
        if n:
            yield one(held)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids = t.column("vec_id").combine_chunks()
        points = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(t.num_rows, -1)
        order, tree = grown(points)
        lists = {"ids": ids.fill_null(0).to_numpy(zero_copy_only=False)[order], "null_id": ids.is_null().to_numpy(zero_copy_only=False)[order], "points": points[order].reshape(-1), **tree}
        kinds = {"ids": pa.int64(), "null_id": pa.bool_(), "points": pa.int32(), "starts": pa.int32(), "ends": pa.int32(), "childs": pa.int32(), "centres": pa.float64(), "radii": pa.float64(), "sums": pa.int64()}
        return pa.record_batch([pa.array([lists[k].reshape(-1)], pa.list_(kinds[k])) for k in kinds], list(kinds))

    return scratch.save(whole.mapInArrow(run, TREE_SCHEMA))


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest digests of seed and id, equal digests by vector: ``clusters`` rows at most."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.select(digest.alias("d"), "v").orderBy("d", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(-1, DIM)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floors of exact means, those without a vector as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            for row in _rows(b):
                tree, points = _tree(row)
                label = np.full(len(points), -1)
                for lo, hi, one, more in assigned(tree, points, centroids):
                    if one is not None:
                        count[one] += hi - lo
                        total[one] += more
                    else:
                        label[lo:hi] = more[squared(points[lo:hi], centroids[more]).argmin(axis=1)]
                single = np.argsort(label, kind="stable")[np.count_nonzero(label < 0) :]
                if len(single):
                    which, first = np.unique(label[single], return_index=True)
                    count[which] += np.diff(np.append(first, len(single)))
                    total[which] += np.add.reduceat(points[single], first, axis=0, dtype=np.int64)
        used = np.nonzero(count)[0]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([[count[k], *total[k]] for k in used], pa.list_(pa.int64()))], ["cluster", "sums"])

    # sums of a task fit in a long as its vectors do in its memory; those of all tasks are decimals
    balls = forest.drop("ids", "null_id").mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("i", "s"))
    sums = balls.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()  # a number a component and centroid
    whole = {(r.cluster, r.i): int(r.s) for r in sums}
    out = centroids.copy()
    for c in {c for c, _ in whole}:
        out[c] = [whole[c, i + 1] // whole[c, 0] for i in range(centroids.shape[1])]
    return out


def members(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector of the trees: its nearest centroid, ties to the smaller number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                tree, points = _tree(row)
                cluster, distance = np.zeros(len(points), np.int32), np.zeros(len(points), np.int64)
                for lo, hi, one, more in assigned(tree, points, centroids):
                    near = np.array([one]) if one is not None else more
                    d = squared(points[lo:hi], centroids[near])
                    k = d.argmin(axis=1)
                    cluster[lo:hi], distance[lo:hi] = near[k], d[np.arange(hi - lo), k]
                yield pa.record_batch([pa.array(row["ids"], pa.int64(), mask=row["null_id"].astype(bool)), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return forest.select("ids", "null_id", "points", "starts", "ends", "childs", "centres", "radii", "sums").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of every kept vector after ``rounds`` rounds, and the centroids.

    Kept are vectors of 64 components, none null or not finite; others are not in the result. Vectors are whole
    numbers, ``floor(256 x)``, and all sums and comparisons exact, so neither partitioning nor a repeated task changes
    a result. A component of 2^19 or more raises an error, as distances would not fit in a long. With fewer vectors
    than ``clusters`` there are as many centroids as vectors. Repeated rows are vectors of their own, also as first
    centroids: of equal centroids the smaller number gets all. A null vec_id counts as empty in the digest and comes
    back as null. Columns besides ``vec_id`` and ``embedding`` are not read. An empty table gives an empty result and
    no centroid.
    """
    scratch = Scratch(vectors.sparkSession, "balls")
    whole = whole_vectors(vectors)
    centroids = first_centroids(whole, clusters, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    forest = trees(scratch, whole)
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    return scratch.save(members(forest, centroids)), centroids


def report(vectors: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Edge cases are those of ``cluster``.
    """
    rows, centroids = cluster(vectors)
    spark = vectors.sparkSession
    texts = [(k, ",".join(map(str, c))) for k, c in enumerate(centroids.tolist())]
    digest = spark.createDataFrame(texts, "cluster int, c string").select("cluster", F.sha2("c", 256).alias("centroid_sha256"))
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("long").alias("cluster_inertia")).collect()  # a row a centroid
    whole = sum(r.cluster_inertia for r in inertia)
    known = spark.createDataFrame([(r.cluster, r.cluster_inertia, whole) for r in inertia], "cluster int, cluster_inertia long, inertia long")
    return rows.join(F.broadcast(known.join(digest, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(k: int) -> str:
    near = f"near{k} AS (SELECT row, arg_min(c, [d, c]) AS c FROM (SELECT row, c, xx - 2 * list_inner_product(x, m) + list_inner_product(m, m) AS d FROM kept, centroids{k}) GROUP BY row)"
    means = f"""means{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::DOUBLE[] AS m FROM (
    SELECT c, i, sum(x[i]::BIGINT)::HUGEINT AS s, count(*) AS n FROM kept JOIN near{k} USING (row), (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY c, i) GROUP BY c)"""
    return f"{near}, {means}, centroids{k + 1} AS (SELECT o.c, coalesce(n.m, o.m) AS m FROM centroids{k} o LEFT JOIN means{k} n ON n.c = o.c)"


#: The same rows in DuckDB's SQL, for whole numbers whose products are exact in doubles.
SQL = f"""
WITH kept AS (
  SELECT *, row_number() OVER () AS row, list_inner_product(x, x) AS xx FROM (
    SELECT vec_id, [floor(256 * v::DOUBLE) FOR v IN embedding] AS x FROM embeddings WHERE len(embedding) = {DIM} AND len([v FOR v IN embedding IF v IS NOT NULL AND isfinite(v)]) = {DIM})
), centroids0 AS (
  SELECT row_number() OVER (ORDER BY h, x)::INTEGER - 1 AS c, x AS m FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept ORDER BY h, x LIMIT {CLUSTERS})
), {reduce(lambda a, b: f"{a}, {b}", map(_round_sql, range(ROUNDS)))}, last AS (
  SELECT row, c, d::BIGINT AS distance FROM (SELECT row, c, d, row_number() OVER (PARTITION BY row ORDER BY d, c) AS r FROM (SELECT row, c, xx - 2 * list_inner_product(x, m) + list_inner_product(m, m) AS d FROM kept, centroids{ROUNDS})) WHERE r = 1
)
SELECT vec_id, c AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m::BIGINT[], ',')) AS centroid_sha256 FROM last JOIN kept USING (row) JOIN centroids{ROUNDS} USING (c)
"""
