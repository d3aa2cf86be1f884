"""What several operators share: written intermediate tables, id filters, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids are broadcast only up to this many rows (8 bytes each, some 100 MB as a hash table at most);
#: beyond it the same join shuffles.
BROADCAST_IDS = 1_000_000

#: The white space of ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> F.Column:
    """Words of a text as long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: the session's ``spark.checkpoint.dir``, or what its context was given.

    Where neither is set, a session in one process gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='courtside-')}")
        base = context.getCheckpointDir()
    return base.rstrip("/")


class Scratch:
    """Tables written to the cluster's shared folder, so that a lost executor costs one stage at most."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write and read again: cuts the lineage, keeps columnar pruning."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def without_ids(docs: DataFrame, ids: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose key is in ``ids`` (``n`` rows, counted by the caller)."""
    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_anti")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: ``edges(a, b)`` -> ``(node, root)``, root the least node.

    Alternating large-star and small-star steps. Each step is a grouped minimum (combined before the
    shuffle) and a join on the node, so a hub with many neighbours is never gathered in one place. It ends
    when every component is a star around its least node, which is told exactly.
    The two ids must be of one orderable type and not null; only nodes with an edge are returned.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        """links(u, v): point v at the least neighbour of u, for v on one side of u."""
        m = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        side = F.col("v") > F.col("u") if large else F.col("v") < F.col("u")
        hung = links.where(side).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:  # u itself hangs from the least of its smaller neighbours
            hung = hung.union(m.where("m < u").select("u", F.col("m").alias("v")))
        return hung.where("u <> v").distinct()

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def unsettled(e: DataFrame) -> int:
        """Nodes that hang from two others, or hang from one and carry others: none if all that is left are stars."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("carries")).union(e.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("carries").alias("carries")).where("hangs + carries > 1").limit(1).count()

    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while unsettled(now):
        big = star(both(now), True)  # v > u hangs from the least neighbour: edges (larger, smaller)
        new = scratch.save(star(big, False))
        scratch.drop(now)
        now = new
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
