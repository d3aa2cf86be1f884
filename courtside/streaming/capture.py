"""Structured Streaming forms of the polling worker and of the idempotent capture.

A stream reads landed files; each micro-batch is merged by key, so a batch that is delivered again, after a
failure, changes nothing: captured tables commit the batch's number with its rows, and folders of worked jobs are named
by it. ``state`` has the queue and the load as keyed state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from courtside.functions import scalars as S
from courtside.operators import jobs, store
from courtside.written import Written, fs_path

JOB_SCHEMA = "id long, team_id long, last_n int, created_at timestamp"


def landed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files: int = 1) -> DataFrame:
    """Landed files as a stream, ``files`` of them a batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def _stored(spark: SparkSession, table: str) -> DataFrame | None:
    """What is stored of a table of batch folders, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(table) if fs.exists(path) and len(fs.listStatus(path)) else None


def _state(spark: SparkSession, table: str) -> dict:
    return store.manifest(spark, table) if store.versions(spark, table) else {"version": 0, "batch": -1, "runs": {}, "gone": []}


def captured(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a captured table, as its newest version lists them."""
    m = _state(spark, table)
    return _runs(spark, table, m, list(m["runs"]))


def _runs(spark: SparkSession, table: str, m: dict, buckets: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(m["schema"]) if "schema" in m else T.StructType()
    folders = [f"{table}/{f}" for b in buckets for f in m["runs"].get(b, [])]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append_new(table: str, key: list[str], order: str, buckets: int = 64, runs: int = 8) -> Callable[[DataFrame, int], None]:
    """A batch function: rows whose key isn't stored yet are appended, of several in a batch the first by ``order``.

    Rows lie in buckets of their key's hash, a bucket in sorted runs; each batch adds a run to its own buckets, reading
    the keys of these only, and merges a bucket's runs into one where there would be more than ``runs``. So there are
    ``buckets * runs`` folders at most, however many batches have come, and a row is rewritten once in ``runs`` batches
    of its bucket. Which runs count is a version's manifest, committed by compare-and-set with the number of the batch:
    a batch that comes again after a failure finds itself committed, or commits now. Runs that a version replaced are
    deleted after the next one, so a reader of the version before finds its files.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        m = _state(spark, table)
        if batch_id <= m["batch"]:
            return
        written = Written(spark, "capture")
        first = batch.groupBy(*key).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        first = written.save(first.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        own = [str(r.bucket) for r in first.select("bucket").distinct().collect()]  # at most as many as there are buckets
        merged = [b for b in own if len(m["runs"].get(b, [])) >= runs]
        if "schema" not in m:
            m = m | {"schema": T.StructType([T.StructField(f.name, f.dataType, True) for f in batch.schema]).jsonValue()}
        known = _runs(spark, table, m, own).select(F.struct(*key).alias("known"))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"known.{c}")) for c in key])
        rows = first.join(known, same, "left_anti").select(*batch.columns)
        if merged:
            rows = rows.unionByName(_runs(spark, table, m, merged).select(*batch.columns))
        name = f"run={uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).repartition("bucket")
        dealt.sortWithinPartitions("bucket", *key).write.partitionBy("bucket").parquet(f"{table}/{name}")
        made = {n.removeprefix("bucket="): f"{name}/{n}" for n in store.names(spark, f"{table}/{name}") if n.startswith("bucket=")}
        now = m["runs"] | {b: ([] if b in merged else m["runs"].get(b, [])) + [f] for b, f in made.items()}
        gone = [f for b in merged for f in m["runs"][b]]
        store.commit(spark, table, m | {"version": m["version"] + 1, "batch": batch_id, "runs": now, "gone": gone})
        for f in m["gone"]:
            p, fs = fs_path(spark, f"{table}/{f}")
            fs.delete(p, True)
        store.forget(spark, table, last=2)
        written.drop(first)

    return run


def capture(stream: DataFrame, table: str, key: list[str], order: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Run ``append_new`` over a stream: over what is there, or on and on every three seconds."""
    writer = stream.writeStream.foreachBatch(append_new(table, key, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="3 seconds") if continuous else writer.trigger(availableNow=True)).start()


def work_jobs(stream: DataFrame, table: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Take requests as they come: none for a team that has one unfinished, one a team in a batch.

    ``work(jobs)`` returns ``(id, error, finished_at)`` of the batch's jobs; they are stored done or failed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        have = _stored(spark, table)
        known = have.where(F.col("batch") != batch_id) if have is not None else spark.createDataFrame([], JOB_SCHEMA + ", status string")
        queued = jobs.enqueue(known, batch).withColumns({"error": F.lit(None).cast("string"), "finished_at": F.lit(None).cast("timestamp")})
        jobs.finish(queued, work(queued)).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_load(stream: DataFrame, days: int = 14, late: str = "30 days") -> DataFrame:
    """Minutes of each player in sliding windows of ``days`` by day, over rows ``(ts, team_id, player_name, minutes)``.

    Rows later than the watermark are left out of closed windows.
    """
    rows = stream.withColumn("mins", S.parse_minutes(F.col("minutes"))).where("mins > 0").withWatermark("ts", late)
    window = F.window("ts", f"{days} days", "1 day")
    return rows.groupBy(window, "team_id", "player_name").agg(F.sum("mins").alias("load_minutes"), F.count("*").alias("games"))
