"""Stored tables in buckets, whose versions are manifests committed by compare-and-set.

A table lies in buckets by a hash of (part of) its natural key. A version is a small file that says in which folder
each bucket lies; a delivery reads and writes the buckets of its own keys, and the next version points to the old
folders of all others. A version's file is created only if it isn't there yet, so of two writers that started from
one version the second fails, and tries again from the version of the first.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.operators import upsert
from courtside.written import fs_path


class Conflict(Exception):
    """Another writer has committed this version."""


def bucket_of(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


# --- manifests ----------------------------------------------------------------------------------------


def _text(spark: SparkSession, path: str) -> str:
    p, fs = fs_path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A file that comes into being whole, and only if it isn't there: renamed without overwriting, on a local disk linked."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    p, fs = fs_path(spark, temporary)
    out = fs.create(p)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if urlparse(path).scheme in ("", "file"):
            os.link(urlparse(temporary).path, urlparse(path).path)
        else:
            jvm = spark._jvm
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(p, fs_path(spark, path)[0], none)
    except FileExistsError as there:
        raise Conflict(path) from there
    except Exception as failed:
        if fs.exists(fs_path(spark, path)[0]):
            raise Conflict(path) from failed
        raise
    finally:
        fs.delete(p, False)


def names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = fs_path(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the table's versions that are there."""
    return [int(n[:-5]) for n in names(spark, f"{path}/_versions") if n.endswith(".json")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version consists of: by default the newest's. Its number is the tag under which results may be cached."""
    number = max(versions(spark, path)) if version is None else version
    return json.loads(_text(spark, f"{path}/_versions/{number:012d}.json"))


def commit(spark: SparkSession, path: str, m: dict) -> int:
    _create(spark, f"{path}/_versions/{m['version']:012d}.json", json.dumps(m, sort_keys=True))
    return m["version"]


def _forget(spark: SparkSession, path: str, numbers: set[int]) -> None:
    for v in numbers:
        p, fs = fs_path(spark, f"{path}/_versions/{v:012d}.json")
        fs.delete(p, False)


def forget(spark: SparkSession, path: str, last: int) -> None:
    """Delete the manifests, not the data, of versions before the ``last`` ones."""
    _forget(spark, path, set(versions(spark, path)[:-last]))


# --- reading and writing ------------------------------------------------------------------------------


def read(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """A version's rows, of all buckets or of some."""
    return _rows(spark, path, manifest(spark, path, version), buckets)


def _rows(spark: SparkSession, path: str, m: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(m["schema"])
    wanted = m["folders"] if buckets is None else {str(b): m["folders"][str(b)] for b in buckets if str(b) in m["folders"]}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in sorted(wanted.values())])


def _write(df: DataFrame, path: str, by: list[str], buckets: int) -> dict[str, str]:
    """Write rows in buckets, and where each bucket lies."""
    return _write_dealt(df.withColumn("__bucket", bucket_of(by, buckets)).repartition("__bucket"), path)


def _write_dealt(df: DataFrame, path: str) -> dict[str, str]:
    """Write rows that are dealt by ``__bucket``."""
    folder = f"data/{uuid.uuid4().hex}"
    df.write.partitionBy("__bucket").parquet(f"{path}/{folder}")
    return {n.removeprefix("__bucket="): f"{folder}/{n}" for n in names(df.sparkSession, f"{path}/{folder}") if n.startswith("__bucket=")}


def create(df: DataFrame, path: str, by: list[str], buckets: int = 256, note: dict | None = None) -> int:
    """Store ``df`` as a new table, in ``buckets`` buckets by the columns ``by``, the first of its natural key."""
    most = df.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0] if "id" in df.columns else 0
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]).jsonValue()
    m = {"version": 1, "by": by, "buckets": buckets, "schema": schema, "first_id": most // buckets + 1, "ids": {}, "folders": _write(df, path, by, buckets), "note": note}
    return commit(df.sparkSession, path, m)


def merge(spark: SparkSession, path: str, new: DataFrame, how: upsert.Rules, *, order: str | None = None, zero_is_missing: bool = False, note: dict | None = None, attempts: int = 8, before_commit: Callable[[int], None] | None = None) -> int:
    """Upsert ``new`` into the stored table, and the number of the version that has it.

    Only the buckets of ``new``'s keys are read and written. Ids of inserted rows are numbers of their bucket's own
    row of them, ``n * buckets + bucket``, so writers of different buckets never give one id twice. Where another writer
    commits first, its version is the new base: what was written stays right if it touched none of these buckets, and is
    made again otherwise. Columns that only ``new`` has are not stored. ``note`` becomes part of the version's manifest.
    ``before_commit`` is called with each attempt's number, for tests.
    """
    done: tuple[dict, dict[str, str], dict[str, int]] | None = None
    touched: list[str] = []
    for attempt in range(attempts):
        base = manifest(spark, path)
        n, by = base["buckets"], base["by"]
        if done is None or any(base["folders"].get(b) != done[0]["folders"].get(b) for b in touched):
            touched = [str(r[0]) for r in new.select(bucket_of(by, n)).distinct().collect()]  # one a bucket at most
            old = _rows(spark, path, base, [int(b) for b in touched])
            first = [(int(b), base["ids"].get(b, base["first_id"])) for b in touched]

            def mint(rows: DataFrame, first=first, n=n, by=by) -> DataFrame:
                starts = F.broadcast(spark.createDataFrame(first, "__b int, __first long"))
                dealt = rows.withColumn("__b", bucket_of(by, n)).join(starts, "__b")
                within = F.row_number().over(W.partitionBy("__b").orderBy(*how.key)) - 1
                return dealt.withColumn("id", (F.col("__first") + within) * n + F.col("__b")).drop("__b", "__first")

            if "id" in old.columns:  # minted rows come from other tasks
                folders = _write(upsert.upsert(old, new, how, order=order, zero_is_missing=zero_is_missing, mint=mint).select(*old.columns), path, by, n)
            else:  # rows meet in their bucket's task, which writes it
                met = upsert.upsert(old, new, how, order=order, zero_is_missing=zero_is_missing, deal=bucket_of(by, n))
                folders = _write_dealt(met.select(*old.columns, F.col(upsert.DEALT).alias("__bucket")), path)
            ids = {}
            if "id" in old.columns:
                written = _rows(spark, path, base | {"folders": folders})
                last = written.groupBy(bucket_of(by, n).alias("b")).agg(F.max(F.floor(F.col("id") / n)).alias("m"))
                ids = {str(r["b"]): max(r["m"] + 1, base["ids"].get(str(r["b"]), base["first_id"])) for r in last.collect()}  # a number a bucket
            done = (base, folders, ids)
        if before_commit:
            before_commit(attempt)
        try:
            return commit(spark, path, base | {"version": base["version"] + 1, "folders": base["folders"] | done[1], "ids": base["ids"] | done[2]} | ({"note": note} if note else {}))
        except Conflict:
            continue
    raise Conflict(f"{path}: {attempts} attempts")


def replace(spark: SparkSession, path: str, rows: DataFrame, base_version: int | None = None) -> int:
    """Make ``rows`` the table's next version whole: for small tables whose keys may change, as teams' slugs do.

    ``base_version`` is the version that ``rows`` follow from, by default the newest. Fails with ``Conflict`` if another
    writer has committed after it."""
    base = manifest(spark, path, base_version)
    kept = rows.select(*[f["name"] for f in base["schema"]["fields"]])
    return commit(spark, path, base | {"version": base["version"] + 1, "folders": _write(kept, path, base["by"], base["buckets"])})


def changes(spark: SparkSession, path: str, since: int, until: int | None = None) -> DataFrame:
    """Rows that differ between two versions, with ``sign``: -1 as they were, 1 as they are. Only buckets that lie
    elsewhere in the two are read."""
    a, b = manifest(spark, path, since), manifest(spark, path, until)
    moved = [int(k) for k in a["folders"].keys() | b["folders"].keys() if a["folders"].get(k) != b["folders"].get(k)]
    was, now = _rows(spark, path, a, moved), _rows(spark, path, b, moved)
    return was.exceptAll(now).withColumn("sign", F.lit(-1)).union(now.exceptAll(was).withColumn("sign", F.lit(1)))


def snapshot(spark: SparkSession, path: str, stamp: str) -> int | None:
    """Keep the newest version under a stamp, whatever is cleaned later: no row is copied. None without a table."""
    if not versions(spark, path):
        return None
    number = manifest(spark, path)["version"]
    _create(spark, f"{path}/_kept/{stamp}", str(number))
    return number


def at(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    """The table as it was kept under a stamp."""
    return read(spark, path, int(_text(spark, f"{path}/_kept/{stamp}")))


def clean(spark: SparkSession, path: str, last: int = 2) -> int:
    """Delete versions before the ``last`` ones that no stamp keeps, and folders that no version left names; how many
    folders went. Folders of a writer that has not committed go too: clean when none is at work."""
    there = versions(spark, path)
    kept = set(there[-last:]) | {int(_text(spark, f"{path}/_kept/{s}")) for s in names(spark, f"{path}/_kept") if not s.endswith((".tmp", ".crc"))}
    named = {f for v in kept & set(there) for f in manifest(spark, path, v)["folders"].values()}
    _forget(spark, path, set(there) - kept)
    gone = 0
    for write in names(spark, f"{path}/data"):
        for name in names(spark, f"{path}/data/{write}"):
            if name.startswith("__bucket=") and f"data/{write}/{name}" not in named:
                p, fs = fs_path(spark, f"{path}/data/{write}/{name}")
                fs.delete(p, True)
                gone += 1
    return gone
