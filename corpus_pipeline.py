"""Documents to packed training sequences, in five stages, each written and read again.

A stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``docs``, whatever their names; columns besides doc_id, text and source are carried along.
Every stage takes an empty table and gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtside.llm import linedup, mixing, packing, quality, simhash
from courtside.llm.common import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the classifier rejects go.

    A null text is scored as an empty one, repeated rows alike, long texts whole. Without a usable label all stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: later copies of repeated line runs go, and documents that were nothing else.

    Null and empty texts stay as they are. Documents come in the order of their ids, those without one last; rows equal
    in id and text lose no line to each other."""
    return linedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of similar ones stays (shingles of five words, 0.8 and up).

    The smallest id of a group stays. Documents without an id stay. Repeated rows become one; null, empty and wordless
    texts are alike."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents as often as the mix reads them.

    Documents without a word are in no mix. A null source is a source. Rows are planned each, with or without an id;
    equal ones are read as often as all of them together."""
    return mixing.mixed(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: which words of which documents make up each training sequence.

    Long texts lie in several pieces; a text without a word is a piece of no word. Null ids are carried; a null source
    is a source."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_line_runs),
    ("simhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_bins),
]

#: The classifier, the fingerprint and the bins are not expressible in SQL; tests compare the stages with
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
