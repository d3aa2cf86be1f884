"""Approximate nearest neighbours: a navigable small-world graph per shard (operator 3).

Distinct vectors are dealt to shards of bounded size. Each shard is one hierarchical graph, stored as flat
neighbour arrays in a table; every query searches every shard and the results are merged. Equal vectors
are one node, so a vector with thousands of copies neither crowds out its neighbours nor is searched twice.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.llm.common import Scratch

#: Nodes of a shard (a shard must fit in one task), queries of a block.
SHARD_ROWS, BLOCK = 4096, 4096
#: Links of a node above the ground layer and on it; candidates when building and when searching.
M, M0, EF_BUILD, EF_SEARCH = 16, 32, 64, 160
NEIGHBOURS = 10


def _spread(x: np.ndarray, near: np.ndarray, most: int) -> list[int]:
    """Of candidates, nearest first, up to ``most`` that lie nearer to the node than to one already taken."""
    v = x[near[1:]]
    to = ((v - x[near[0]]) ** 2).sum(axis=1)
    sq = (v * v).sum(axis=1)
    between = sq[:, None] + sq[None] - 2 * (v @ v.T)
    taken: list[int] = []
    free = np.ones(len(v), dtype=bool)
    for k in range(len(v)):
        if free[k]:
            taken.append(k)
            if len(taken) == most:
                break
            free &= between[k] > to
    return [int(near[1 + k]) for k in taken]


def _layer(x: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Flat neighbour array (nodes x most, -1 where none) of one layer, nodes linked in the order given.

    A node's candidates are the nearest of those linked before it, so early nodes keep the long links.
    """
    links: list[list[int]] = [[] for _ in nodes]
    v = x[nodes]
    sq = (v * v).sum(axis=1)

    def nearest(i: int, others) -> np.ndarray:
        d = ((v[others] - v[i]) ** 2).sum(axis=1)
        return np.concatenate([[i], np.asarray(others)[np.argsort(d, kind="stable")]])

    for s in range(0, len(nodes), 512):
        e = min(len(nodes), s + 512)
        d = sq[s:e, None] + sq[None, :e] - 2 * (v[s:e] @ v[:e].T)
        d[np.arange(e)[None] >= np.arange(s, e)[:, None]] = np.inf
        k = min(EF_BUILD, e - 1)
        near = np.argpartition(d, max(0, k - 1), axis=1)[:, :k] if k else np.empty((e - s, 0), dtype=int)
        for i in range(s, e):
            mine = near[i - s]
            mine = mine[np.isfinite(d[i - s, mine])]
            if not len(mine):
                continue
            mine = mine[np.argsort(d[i - s, mine], kind="stable")]
            links[i] = _spread(v, np.concatenate([[i], mine]), M)
            for j in links[i]:
                links[j].append(i)
                if len(links[j]) > 2 * most:
                    links[j] = _spread(v, nearest(j, links[j]), most)
    flat = np.full((len(nodes), most), -1, dtype=np.int32)
    for i, own in enumerate(links):
        if len(own) > most:
            own = _spread(v, nearest(i, own), most)
        flat[i, : len(own)] = nodes[own]
    return flat


def build(x: np.ndarray) -> dict[str, np.ndarray]:
    """The graph of one shard: for each layer its nodes and their flat neighbour array. Node 0 of the top layer is the entry."""
    rng = np.random.default_rng(len(x))
    level = np.floor(-np.log(1 - rng.random(len(x))) / math.log(M)).astype(int)
    layers = []
    for at in range(int(level.max()) + 1):
        nodes = np.nonzero(level >= at)[0]
        layers.append((nodes.astype(np.int32), _layer(x, nodes, M0 if at == 0 else M)))
    return {"sizes": np.array([len(n) for n, _ in layers], dtype=np.int32), "nodes": np.concatenate([n for n, _ in layers]), "links": np.concatenate([f.reshape(-1) for _, f in layers])}


class Graph:
    def __init__(self, x: np.ndarray, sizes, nodes, links):
        self.x, self.layers = x, []
        at = to = 0
        for k, n in enumerate(sizes):
            most = M0 if k == 0 else M
            flat = np.asarray(links[to : to + n * most]).reshape(n, most)
            self.layers.append((dict(zip(np.asarray(nodes[at : at + n]).tolist(), range(n))), flat))
            at, to = at + n, to + n * most

    def _search(self, q: np.ndarray, start: tuple[float, int], layer: int, ef: int) -> list[tuple[float, int]]:
        row, flat = self.layers[layer]
        seen = np.zeros(len(self.x), dtype=bool)
        seen[start[1]] = True
        todo, best = [start], [(-start[0], start[1])]
        while todo:
            d, node = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= ef:
                break
            near = flat[row[node]]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            far = ((self.x[near] - q) ** 2).sum(axis=1)
            for dist, other in zip(far.tolist(), near.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (-dist, other))
                    heapq.heappush(todo, (dist, other))
                elif dist < -best[0][0]:
                    heapq.heapreplace(best, (-dist, other))
                    heapq.heappush(todo, (dist, other))
        return sorted((-d, i) for d, i in best)

    def nearest(self, q: np.ndarray, k: int, ef: int, order: np.ndarray) -> list[tuple[float, int]]:
        """``k`` nearest nodes found as (distance, node), those at one distance by ``order``.

        All nodes at the k-th distance take part: where the search's list ends at that very distance, more of
        them may lie beyond it, and the shard is asked for all at exactly that distance. So it is where the
        search ends early, as vectors that all lie equally far apart have few links.
        """
        first = next(iter(self.layers[-1][0]))
        at = (float(((self.x[first] - q) ** 2).sum()), first)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._search(q, at, layer, 1)[0]
        nodes = np.array([i for _, i in self._search(q, at, 0, max(ef, k))])
        d = distances(self.x[nodes], q)
        if len(nodes) < min(max(ef, k), len(self.x)):  # the rest can't be reached
            nodes, d = np.arange(len(self.x)), distances(self.x, q)
        elif len(nodes) >= k and d.max() <= np.partition(d, k - 1)[k - 1]:
            every = distances(self.x, q)
            nodes = np.union1d(nodes, np.nonzero(every == d.max())[0])
            d = every[nodes]
        best = np.lexsort((order[nodes], d))[:k]
        return list(zip(d[best].tolist(), nodes[best].tolist()))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, each row summed alike."""
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding array<double>)``, without null ids and vectors that are null, zero or not finite."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())


def index(scratch: Scratch, nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of ``nodes(cid, least, embedding)``, one row a shard; ``least`` orders nodes at one distance.

    Vectors of one length share their shards. A shard's candidates are taken from exact distances within it,
    whose number a shard's size bounds, so the work grows with the number of shards only.
    """
    sized = nodes.withColumn("dim", F.size("embedding"))
    shards = scratch.save(sized.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order", kind="stable")
        x = np.stack(pdf["embedding"].to_numpy())
        g = build(x)
        row = {"dim": int(key[0]), "shard": int(key[1]), "cids": pdf["cid"].to_numpy(), "least": pdf["least"].to_numpy(), "x": x.reshape(-1), **g}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    dealt = sized.join(shards, "dim").withColumn("order", F.xxhash64("cid", F.lit("order")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int")).drop("shards")
    schema = "dim int, shard int, cids array<long>, least array<long>, x array<double>, sizes array<int>, nodes array<int>, links array<int>"
    return scratch.save(dealt.groupBy("dim", "shard").applyInPandas(run, schema))


def search(graphs: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH, block: int = BLOCK) -> DataFrame:
    """``(qid, cid, least, score)``: of each shard the ``k`` nearest nodes found to each of ``queries(qid, embedding)``."""
    blocks = max(1, -(-queries.count() // block))
    each = graphs.select(F.col("dim").alias("to_dim"), F.col("shard").alias("to"))
    asked = queries.join(each, F.size("embedding") == F.col("to_dim"))
    asked = asked.select("qid", "embedding", F.col("to_dim").alias("dim"), F.col("to").alias("shard"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"))
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, float]] = []
        if len(left) and len(right):
            g = left.iloc[0]
            x = np.asarray(g["x"], dtype=np.float64).reshape(len(g["cids"]), -1)
            graph = Graph(x, g["sizes"], g["nodes"], g["links"])
            for qid, q in zip(right["qid"], right["embedding"]):
                out += [(qid, g["cids"][i], g["least"][i], d) for d, i in graph.nearest(np.asarray(q), k, ef, g["least"])]
        return pd.DataFrame(out, columns=["qid", "cid", "least", "score"]).astype({"qid": "int64", "cid": "int64", "least": "int64", "score": "float64"})

    key = ["dim", "shard", "block"]
    return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "qid long, cid long, least long, score double")


def neighbours(vectors: DataFrame, is_query, k: int = NEIGHBOURS, ef: int = EF_SEARCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found to each row for which ``is_query`` holds.

    Smallest Euclidean distance first, ties to the smaller vec_id (however many there are, in one shard or
    in several), the query itself left out; all candidates if there are fewer. Vectors that are null, empty, zero or hold a null or a non-finite
    component, and rows without an id, take no part. Vectors of another length are no candidates. Of rows
    that share an id and a vector one takes part. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "hnsw")
    rows = usable(vectors).distinct()
    # A node for each distinct vector, with the k + 1 smallest ids that have it: no more can be in an answer.
    least = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    named = scratch.save(rows.withColumn("r", least).where(F.col("r") <= k + 1).select("embedding", "vec_id").groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    nodes = scratch.save(named.withColumn("least", F.get("ids", F.lit(0))).withColumn("cid", F.monotonically_increasing_id()))
    graphs = index(scratch, nodes.select("cid", "least", "embedding"))

    asked = scratch.save(rows.where(is_query).join(nodes.select("embedding", "cid"), "embedding").select("vec_id", "cid"))
    distinct = scratch.save(asked.select("cid").distinct().join(nodes.select("cid", "embedding"), "cid").select(F.col("cid").alias("qid"), "embedding"))
    found = search(graphs, distinct, k + 1, ef)
    # each of these nodes adds an id no greater than any of a node that is cut
    top = found.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("score", "least"))).where(F.col("r") <= k + 1)
    ids = top.join(nodes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    first = ids.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    lists = scratch.save(first.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best")))
    answers = asked.join(lists, asked["cid"] == lists["qid"]).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")), 1, k).alias("best"))
    flat = answers.select("query_id", F.posexplode("best").alias("at", "b"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
