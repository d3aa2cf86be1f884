"""The operators over the driver's whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from courtside.llm import balls, hnsw, lattice, linedup, middle, mixing, packing, quality, simhash, tokens, urls, warc, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(_table(spark, sf_dir, "pages"), spark.createDataFrame(urls.RULES, urls.RULE_SCHEMA))


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.line_report(_table(spark, sf_dir, "documents"))


def op6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(_table(spark, sf_dir, "pages"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the box's tokenizer files; their path is a parameter of the operator

    # a cache that is kept between runs is named by the session; without one the counts start afresh
    cache = spark.conf.get("spark.courtside.tokenCache", None)
    return tokens.cached(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.report(_table(spark, sf_dir, "embeddings"))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_mixing": op2_mixing,
        "op3_hnsw": op3_hnsw,
        "op4_urls": op4_urls,
        "op5_line_runs": op5_line_runs,
        "op6_wrappers": op6_wrappers,
        "op7_tokens": op7_tokens,
        "op8_quality": op8_quality,
        "op9_lattice": op9_lattice,
        "op10_simhash": op10_simhash,
        "op11_balls": op11_balls,
        "op12_middle": op12_middle,
        "op13_warc": op13_warc,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.SQL,
        "op4_urls": urls.SQL,
        "op5_line_runs": linedup.SQL,
        "op9_lattice": lattice.SQL,
        "op11_balls": balls.SQL,
        "op12_middle": middle.SQL,
        "op13_warc": warc.SQL,
    }
