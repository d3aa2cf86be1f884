"""Tables written in between to the cluster's shared folder, so that iterative operators keep no long lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fs_path(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop's classes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or what its context was given; a session in one process may have neither
    and gets a temporary folder, a cluster must name one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='courtside-')}")
        base = context.getCheckpointDir()
    return base.rstrip("/")


class Written:
    """Tables of one run: ``save`` writes and reads again, ``drop`` deletes those that no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written = path
        return out

    def drop(self, table: DataFrame) -> None:
        path, fs = fs_path(self.spark, table._written)
        fs.delete(path, True)
