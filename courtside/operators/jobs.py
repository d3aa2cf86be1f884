"""The queue of scouting requests: a control table of jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from courtside.operators import store

ACTIVE = ["queued", "running"]


def latest(jobs: DataFrame) -> DataFrame:
    """The newest job of each team."""
    cols = [c for c in jobs.columns if c != "team_id"]
    pick = F.max_by(F.struct(*cols), F.struct("created_at", "id")).alias("j")
    return jobs.groupBy("team_id").agg(pick).select("team_id", "j.*")


def active(jobs: DataFrame) -> DataFrame:
    """The newest queued or running job of each team."""
    return latest(jobs.where(F.col("status").isin(ACTIVE)))


def claim(jobs: DataFrame) -> DataFrame:
    """The queued job that has waited longest: one row, or none."""
    oldest = F.min_by(F.struct(*jobs.columns), F.struct("created_at", "id")).alias("j")
    return jobs.where("status = 'queued'").agg(oldest).where("j is not null").select("j.*")


def claim_next(spark: SparkSession, path: str, now: datetime) -> Row | None:
    """Take the stored queue's oldest waiting job and mark it running, as one step: of workers that see the same job one
    commits, and the others look again. None if no job waits. ``path`` is a table of ``store``, small as open jobs are."""
    while True:
        version = store.manifest(spark, path)["version"]
        jobs = store.read(spark, path, version)
        job = claim(jobs).first()
        if job is None:
            return None
        own = F.col("id") == job["id"]
        taken = jobs.withColumns({"status": F.when(own, "running").otherwise(F.col("status")), "started_at": F.when(own, F.lit(now)).otherwise(F.col("started_at"))})
        try:
            store.replace(spark, path, taken, version)
        except store.Conflict:
            continue
        return job


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(id, team_id, last_n, created_at)`` that make new jobs: none for a team with an active job, one a team."""
    idle = requests.where(F.col("last_n").between(1, 15)).join(jobs.where(F.col("status").isin(ACTIVE)), "team_id", "left_anti")
    first = F.min_by(F.struct("id", "last_n", "created_at"), F.struct("created_at", "id")).alias("j")
    return idle.groupBy("team_id").agg(first).select("j.id", "team_id", "j.last_n", F.lit("queued").alias("status"), "j.created_at")


def finish(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs after ``results(id, error, finished_at)``: failed where there is an error, done else."""
    r = results.select("id", F.col("error").alias("__error"), F.col("finished_at").alias("__at"))
    out = jobs.join(r, "id", "left")
    status = F.when(F.col("__at").isNull(), F.col("status")).when(F.col("__error").isNotNull(), "failed").otherwise("done")
    return out.withColumn("status", status).withColumn("error", F.coalesce("__error", "error")).withColumn("finished_at", F.coalesce("__at", "finished_at")).drop("__error", "__at").select(*jobs.columns)
