"""WARC archives by a deterministic sharded writer (operator 13).

Records are built and compressed where pages are read, dealt to shards by ranges of ``page_id`` that follow from the
exact sizes of all pages, sorted, and written one after another into files that roll by compressed size. A task
writes under temporary names; the rows that Spark commits for it form the manifest, whose files are then renamed, and
an archive counts once its manifest is written. Every byte follows from the pages, so a repeated task or run writes
the same files.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtside.llm.common import BROADCAST_IDS, Scratch, shared_folder

#: Payloads below this many bytes are never revisits.
SHORTEST = 100
#: A shard has this many bytes of payload, or more where there would be more than SHARDS of them.
SHARD_BYTES, SHARDS = 4 << 20, 1 << 16
#: A file rolls once it has this many compressed bytes; it holds one record more at most.
ROLL_BYTES = 16 << 20
#: Parts into which a digest that stands on many pages is dealt where the list of digests isn't broadcast.
SALTS = 32

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
MANIFEST = "shard int, roll int, temporary string, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


# --- records ----------------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}:{digest}')}>"


def _headers(*pairs: tuple[str, object]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode()


def _record(kind: str, block: bytes, date: str, *pairs: tuple[str, object]) -> bytes:
    """A record as a gzip member of its own."""
    digest = f"sha256:{hashlib.sha256(block).hexdigest()}"
    head = _headers(("WARC-Type", kind), *pairs, ("WARC-Date", date), ("WARC-Block-Digest", digest), ("Content-Length", len(block)))
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # no time stamp, no file name
    return z.compress(b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """The record of one page. What a header can't hold as it is, in a url, is percent-encoded, and spelled out beside it."""
    digest = hashlib.sha256(payload).hexdigest()
    uri = None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=~")
    http = b"HTTP/1.1 200 OK\r\n" + _headers(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))) + b"\r\n"
    return _record(
        "revisit" if revisit else "response",
        http if revisit else http + payload,
        date,
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Target-URI", uri),
        ("X-Target-URI", json.dumps(url) if uri != url else None),
        ("X-Page-Id", page_id),
        ("WARC-Profile", REVISIT if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("X-Refers-To-Page-Id", refers_to if revisit else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    )


def members(content: bytes) -> Iterator[bytes]:
    """The records of an archive file, one gzip member each."""
    view, at = memoryview(content), 0
    while at < len(content):
        z = zlib.decompressobj(31)
        out = [z.decompress(view[at : at + (1 << 16)])]
        taken = min(len(content), at + (1 << 16))
        while not z.eof:
            if taken >= len(content):
                raise ValueError("an archive file ends within a record")
            out.append(z.decompress(view[taken : taken + (1 << 20)]))
            taken = min(len(content), taken + (1 << 20))
        at = taken - len(z.unused_data)
        yield b"".join(out)


def _fields(block: bytes, start: int) -> tuple[dict[str, str], int]:
    """Header fields from ``start`` on, with lower-case names, and where the block behind them starts."""
    end = block.index(b"\r\n\r\n", start)
    lines = block[start:end].decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, end + 4


def parsed(record: bytes) -> dict | None:
    """A page's record in the columns of RECORDS, None for a record of another kind. Digests are made anew and must agree."""
    head, at = _fields(record, 0)
    block = record[at : at + int(head["content-length"])]
    if head["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or record[at + len(block) :] != b"\r\n\r\n":
        raise ValueError(f"a block differs from its digest or length: {head['warc-record-id']}")
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, start = _fields(block, 0)
    number = lambda name: int(head[name]) if name in head else None
    digest = head["warc-payload-digest"].removeprefix("sha256:")
    payload = block[start:] if kind == "response" else None
    if payload is not None and (len(payload) != int(http["content-length"]) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"a payload differs from its digest or length: {head['warc-record-id']}")
    url = json.loads(head["x-target-uri"]) if "x-target-uri" in head else head.get("warc-target-uri")
    return {"page_id": number("x-page-id"), "url": url, "record_type": kind, "refers_to": number("x-refers-to-page-id"), "payload": payload, "payload_bytes": int(http["content-length"]), "payload_digest": digest}


# --- shards -----------------------------------------------------------------------------------------


def _bounds(scratch: Scratch, sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """The least ``page_id`` of each shard but the first, from ``sizes(page_id, n)``: SHARDS of them at most.

    Pages are numbered by the exact sum of the sizes before them in the order of their ids, in two levels: sums of
    ranges that Spark draws, then sums within each. Where the ranges lie changes no result.
    """
    ranged = scratch.save(sizes.where("page_id is not null").repartitionByRange("page_id").select("page_id", "n", F.spark_partition_id().alias("range")))
    parts = ranged.groupBy("range").agg(F.sum("n").alias("s")).select("range", (F.sum("s").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("s")).alias("before"))
    total = ranged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    step = max(shard_bytes, -(-total // SHARDS))
    within = F.sum("n").over(W.partitionBy("range").orderBy("page_id").rangeBetween(W.unboundedPreceding, W.currentRow))
    at = ranged.withColumn("within", within).join(F.broadcast(parts), "range")  # a row a range
    last = F.floor((F.col("before") + F.col("within") - 1) / step)
    starts = at.where("before + within > 0").groupBy(last.alias("shard")).agg(F.min("page_id").alias("first")).where("shard > 0")
    return np.array(sorted(r["first"] for r in starts.collect()), dtype=np.int64)


def _revisits(scratch: Scratch, pages: DataFrame, keys: DataFrame) -> DataFrame:
    """``pages`` with ``refers_to``, the least page_id of those that share the digest, where another page is it."""
    groups = keys.where(F.col("n") >= SHORTEST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    groups = scratch.save(groups.select("digest", "first"))
    n = groups.count()
    if n <= BROADCAST_IDS // 4:
        joined = pages.join(F.broadcast(groups), "digest", "left")
    else:  # the copies of one payload are dealt to several tasks
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))


# --- writing ----------------------------------------------------------------------------------------


def _made(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI, from any task: file, hdfs, s3 or what else pyarrow reaches."""
    return fs.FileSystem.from_uri(uri if re.match(r"\w+://?", uri) else f"file://{uri}")


def write(pages: DataFrame, folder: str, date: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as WARC files into ``folder``, and return the manifest, a row a file.

    ``folder`` is the URI of a folder that driver and executors share. The payload is the html in UTF-8, a null html
    an empty payload. Of pages with one payload of at least 100 bytes, those with the least page_id are responses,
    and the others revisit it, also those without an id; where none has an id all are responses. Repeated rows are
    records each. A null url has no header; any other comes back as it is. ``date`` stands in every record: two runs
    with one date give the same files, byte by byte. Rows of one page_id share a shard, which is written as a stream,
    so memory is bounded by a batch and a single record. An empty table gives an empty manifest. Other columns are
    not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    body = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.unhex(F.sha2(body, 256)).alias("digest"))
    keys = scratch.save(keyed.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n")))
    bounds = spark.sparkContext.broadcast(_bounds(scratch, keys.select("page_id", "n"), shard_bytes))
    attempt = uuid.uuid4().hex

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, payloads, to = (b.column(c) for c in ("page_id", "url", "payload", "refers_to"))
            for at in range(0, b.num_rows, 256):  # so that what is made is passed on soon
                cut = slice(at, at + 256)
                own = ids[cut].to_pylist()
                made = [page_record(i, u.as_py(), p.as_py(), t, t is not None, date) for i, u, p, t in zip(own, urls[cut], payloads[cut], to[cut].to_pylist())]
                shard = [0 if i is None else int(np.searchsorted(bounds.value, i, side="right")) for i in own]
                yield pa.record_batch([pa.array(shard, pa.int32()), ids[cut], pa.array(made, pa.binary())], ["shard", "page_id", "record"])

    records = _revisits(scratch, keyed, keys).select("page_id", "url", "payload", "refers_to").mapInArrow(build, "shard int, page_id long, record binary")
    shards = len(bounds.value) + 1
    parts = min(shards, max(1, spark.sparkContext.defaultParallelism * 64))
    # a shard's rows follow each other in one task; equal ids by the bytes of their records
    ordered = records.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "record")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _made(folder)
        out = None

        def opened(shard: int, roll: int) -> dict:
            name = f"part-{shard:05d}-{roll:05d}.warc.gz"
            temporary = f"_temporary/{attempt}-{uuid.uuid4().hex}-{name}"
            system.create_dir(f"{root}/_temporary", recursive=True)
            one = {"shard": shard, "roll": roll, "temporary": temporary, "name": name, "records": 0, "bytes": 0, "hash": hashlib.sha256(), "file": system.open_output_stream(f"{root}/{temporary}", compression=None)}
            info = _headers(("software", "courtside"), ("format", "WARC File Format 1.1"))
            put(one, _record("warcinfo", info, date, ("WARC-Record-ID", record_id(None, name)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")))
            return one

        def put(one: dict, record: bytes) -> None:
            one["file"].write(record)
            one["hash"].update(record)
            one["bytes"] += len(record)

        def closed(one: dict) -> pa.RecordBatch:
            one.pop("file").close()
            one["sha256"] = one.pop("hash").hexdigest()
            return pa.RecordBatch.from_pylist([one], pa.schema([(c, kinds[t]) for c, t in (x.split() for x in MANIFEST.split(", "))]))

        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
        for b in batches:
            for shard, record in zip(b.column("shard").to_pylist(), b.column("record")):
                if out and (out["shard"] != shard or out["bytes"] >= roll_bytes):
                    roll = out["roll"] + 1 if out["shard"] == shard else 0
                    yield closed(out)
                    out = opened(shard, roll)
                out = out or opened(shard, 0)
                put(out, record.as_py())
                out["records"] += 1
        if out:
            yield closed(out)

    manifest = scratch.save(ordered.mapInArrow(store, MANIFEST))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _made(folder)
        for b in batches:
            for row in b.to_pylist():
                done = system.get_file_info(f"{root}/{row['name']}")
                if system.get_file_info(f"{root}/{row['temporary']}").type == fs.FileType.File:
                    system.move(f"{root}/{row['temporary']}", f"{root}/{row['name']}")
                elif done.type != fs.FileType.File or done.size != row["bytes"]:  # else an earlier attempt renamed it
                    raise FileNotFoundError(f"neither {row['temporary']} nor {row['name']} is there")
            yield b

    scratch.save(manifest.mapInArrow(rename, MANIFEST)).select("shard", "roll", "name", "records", "bytes", "sha256").write.mode("overwrite").parquet(f"{folder}/_manifest")
    system, root = _made(folder)
    if system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
        system.delete_dir(f"{root}/_temporary")  # what failed attempts left
    return spark.read.parquet(f"{folder}/_manifest")


# --- reading ----------------------------------------------------------------------------------------


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archive's files in its manifest, as RECORDS: a revisit's payload is null, its size and digest
    are those of the full payload. Files that no manifest names are not read; a file that differs from its digest, or a
    record from its own, raises an error."""
    manifest = spark.read.parquet(f"{folder}/_manifest")
    if not manifest.head(1):
        return spark.createDataFrame([], RECORDS)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    listed = content.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select("name", "sha256"), "name")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c, kinds[t]) for c, t in (x.split() for x in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, sha in zip(b.column("content"), b.column("sha256")):
                content = content.as_py()
                if hashlib.sha256(content).hexdigest() != sha.as_py():
                    raise ValueError("an archive file differs from its manifest")
                rows: list[dict] = []
                size = 0
                for record in members(content):
                    row = parsed(record)
                    if row:
                        rows.append(row if payloads else {**row, "payload": None})
                        size += len(row["payload"] or b"") if payloads else 0
                    if len(rows) >= 1024 or size >= 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return listed.select("content", "sha256").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of pages written and read back.

    The archive lies in a new folder of the session's shared one. Edge cases are those of ``write``.
    """
    folder = f"{shared_folder(pages.sparkSession)}/archive-{uuid.uuid4().hex}"
    write(pages, folder, date)
    return read(pages.sparkSession, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in DuckDB's SQL; ids that may be null are doubles there, as in a data frame.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN strlen(html) >= {SHORTEST} AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= {SHORTEST} AND first IS DISTINCT FROM page_id THEN first END::DOUBLE AS refers_to
FROM g
"""
