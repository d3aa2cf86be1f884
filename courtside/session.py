"""Session factory and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings every query here assumes: ANSI, UTC, adaptive execution."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).appName("courtside").config(map=settings).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. The path goes to Spark's own reader only, so any store that Spark reads works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
