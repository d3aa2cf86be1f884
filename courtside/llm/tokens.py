"""Token counts through a digest cache (operator 7).

A count depends on the content and the tokenizer alone, so it is stored under the digests of both.
Documents are joined to the stored counts; of the digests without one, a single document each is encoded,
and the new counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import BROADCAST_IDS, Scratch

LIMIT = 4096
CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


@lru_cache(maxsize=4)
def counter(tokenizer: bytes, sentencepiece_model: bool):
    """texts -> token counts, by the library that the file's content is for: no special tokens are added."""
    if sentencepiece_model:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=tokenizer)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tokenizers

    model = tokenizers.Tokenizer.from_str(tokenizer.decode())
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def cached(docs: DataFrame, path: str, cache: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit`` for the tokenizer file at ``path``.

    The file is read by the driver and sent to the executors, some megabytes at most. ``cache`` is a folder of
    Parquet that all executors reach, a sub-folder for each version of a tokenizer's file; by default a new one
    beside the session's other shared tables. The normal form of a content is its UTF-8 bytes, null as empty:
    every other form could change a count. Texts are encoded whole, each distinct one that is not stored once,
    whatever rows repeat it. Repeated rows are counted each; a null doc_id is carried along. Other columns are
    not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    cache = cache or f"{scratch.root}/cache"
    with open(path, "rb") as f:
        content = f.read()
    tokenizer = hashlib.sha256(content).hexdigest()  # another version never meets the counts of this one
    text = F.coalesce("text", F.lit(""))
    sha = F.unhex(F.sha2(text.cast("binary"), 256))
    known = scratch.save(docs.select("doc_id", sha.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))

    stored = spark.read.schema(CACHE_SCHEMA)
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    have = stored.parquet(cache).where(F.col("tokenizer") == tokenizer).select("digest") if there else spark.createDataFrame([], "digest binary")

    # One document stands for each digest that is not stored: of those with its least id, if any has one. The texts
    # are read again without a shuffle, by joining the smaller of two lists of ids: those to encode, or the others.
    rows = known.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n")).alias("m"))
    misses = scratch.save(first.select("digest", F.col("m.doc_id").alias("doc_id"), (F.col("m.n") > 1).alias("again")).join(have, "digest", "left_anti"))
    mine = rows.select("digest", "doc_id").join(misses.select("digest", F.col("doc_id").alias("of"), F.lit(True).alias("miss")), "digest", "left")
    rest = scratch.save(mine.where(F.col("miss").isNull() | ~F.col("doc_id").eqNullSafe(F.col("of"))).select("digest", "doc_id"))
    wanted, again, other = misses.count(), misses.where("again").count(), rest.count()
    keyed = docs.select("doc_id", text.alias("text"), sha.alias("digest"))

    def picked(ids: DataFrame, n: int, how: str) -> DataFrame:
        ids = ids.select(F.col("digest").alias("d"), F.col("doc_id").alias("i"))
        ids = F.broadcast(ids) if n <= BROADCAST_IDS // 4 else ids.hint("shuffle_hash")
        return keyed.join(ids, keyed["doc_id"].eqNullSafe(ids["i"]) & (keyed["digest"] == ids["d"]), how).select("digest", "text")

    if not again:
        todo = picked(misses, wanted, "left_semi") if wanted <= other else picked(rest, other, "left_anti")
    else:  # ids that stand on several rows with one text: their texts are brought together, combined where they lie
        todo = picked(misses.where("not again"), wanted - again, "left_semi") if wanted - again <= other + again else picked(rest.union(misses.where("again").select("digest", "doc_id")), other + again, "left_anti")
        todo = todo.union(picked(misses.where("again"), again, "left_semi").groupBy("digest").agg(F.first("text").alias("text")))

    sent, is_model = spark.sparkContext.broadcast(content), path.endswith(".model")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(sent.value, is_model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                counts = pa.array(count(part.column(1).to_pylist()), pa.int64())
                yield pa.record_batch([part.column(0), counts], ["digest", "n_tokens"])

    new = todo.mapInArrow(encode, "digest binary, n_tokens long").select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens")
    new.write.mode("append").partitionBy("tokenizer").parquet(cache)

    # two runs may have stored one digest at once: its counts are the same
    counts = stored.parquet(cache).where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = scratch.save(counts)
    return known.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
