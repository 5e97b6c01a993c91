r"""A deterministic sharded WARC writer, and a reader.

Payload digests are computed in the JVM; for payloads of MIN_DEDUPE bytes or more, the smallest id of
equal payloads is the response and the others revisit it. Digest groups are combined before the
shuffle, only digests that occur twice or more go into the join, and the references it finds are
range-sorted together with the pages, each before its page.

Pages are dealt to shards by ranges of ids, whose bounds are quantiles of the ids with the smallest hashes: the rows
alone decide them, not how rows lie in partitions, so two writes of a table give the same files, byte for byte.
A shard is sorted and streamed by one task into gzip members, one per record, and
starts a new file when the current one has ROLL_BYTES compressed bytes; a file begins with a warcinfo record.
Headers are regenerated from the row alone: record ids are UUIDs derived from id and digest (and the number of the
repetition, where a row repeats), the date is a parameter, block and payload digests are SHA-256.

Commit: every attempt of a task writes under names of its own in ``_tmp``, and returns a manifest
row per file. The manifest is written as a table: from then on it names one attempt per task. A second
job renames its files to their final names (repeating it changes nothing), and the manifest takes its
final name last; a reader reads only what a manifest lists. Files of lost attempts go with ``_tmp``.

Defined results: a null html is an empty payload; a null url has no WARC-Target-URI; a null id sorts
first and is written as an empty header value, read back as null; repeated rows are written each under an id of its own, and
those that equal the smallest id are responses all; empty tables give a manifest without files. All rows of one id are
one shard's.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, remove, scratch, table, temporary

MIN_DEDUPE = 100
ROLL_BYTES = 64 << 20
#: Payload bytes to a shard, and the most shards there are: one task writes one shard.
SHARD_BYTES = 8 << 20
MAX_SHARDS = 20_000
#: Ids to a shard that its bounds are made of, at least, on average.
SAMPLE = 200
#: Compressed bytes to a task that reads.
READ_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _open(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def references(pages: DataFrame, min_dedupe: int = MIN_DEDUPE) -> DataFrame:
    """(page_id, digest, refers_to) of the rows of pages(page_id, html) that revisit another's payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.where(F.octet_length(payload) >= min_dedupe).select("page_id", F.sha2(payload, 256).alias("digest"))
    many = (
        rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    )
    return rows.join(many, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def record_id(page_id, digest: str, repeat: int = 0) -> str:
    name = f"{page_id}:{digest}" + (f":{repeat}" if repeat else "")
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"


def info(name: str, date: str) -> bytes:
    """The warcinfo record that opens a file."""
    block = b"software: textloom\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('', name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id, url, html, digest: str, refers_to, date: str, repeat: int = 0) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, repeat)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Page: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_MANIFEST = "task int, file int, tmp string, name string, records long, bytes long, sha256 string, first_id long, last_id long"


class _File:
    """An archive being written under a temporary name."""

    def __init__(self, fs, base: str, attempt: str, shard: int, number: int, first, date: str, level: int):
        self.key, self.name, self.level = (shard, number), f"part-{shard:05d}-{number:05d}.warc.gz", level
        self.tmp = f"_tmp/{attempt}-{self.name}"
        self.records, self.bytes, self.first, self.last, self.sha = 0, 0, first, first, hashlib.sha256()
        self.out = fs.open_output_stream(f"{base}/{self.tmp}", compression=None)
        self.put(self.packed(info(self.name, date)))

    def packed(self, raw: bytes) -> bytes:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        return z.compress(raw) + z.flush()

    def put(self, packed: bytes) -> None:
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)

    def close(self) -> tuple:
        self.out.close()
        return (*self.key, self.tmp, self.name, self.records, self.bytes, self.sha.hexdigest(), self.first, self.last)


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll: int, date: str, level: int) -> Iterator[pa.RecordBatch]:
    fs, base = _open(folder)
    attempt = uuid.uuid4().hex
    rows: list[tuple] = []
    file: _File | None = None
    revisits: dict[str, int] = {}  # of the id at hand, whose references come before its pages
    repeats: dict[str, int] = {}
    at = None
    for batch in batches:
        names = ("shard", "page_id", "url", "html", "digest", "refers_to")
        for values in zip(*(batch.column(n) for n in names), strict=True):
            shard, page_id, url, html, digest, refers_to = (v.as_py() for v in values)
            if (shard, page_id) != at:
                revisits, repeats, at = {}, {}, (shard, page_id)
            if refers_to is not None:
                revisits[digest] = refers_to
                continue
            raw = record(page_id, url, html, digest, revisits.get(digest), date, repeats.get(digest, 0))
            repeats[digest] = repeats.get(digest, 0) + 1
            if file is None or file.key[0] != shard:
                if file is not None:
                    rows.append(file.close())
                fs.create_dir(f"{base}/_tmp", recursive=True)
                file = _File(fs, base, attempt, shard, 0, page_id, date, level)
            packed = file.packed(raw)
            if file.records and file.bytes + len(packed) > roll:
                rows.append(file.close())
                file = _File(fs, base, attempt, shard, file.key[1] + 1, page_id, date, level)
            file.put(packed)
            file.records += 1
            file.last = page_id
    if file is not None:
        rows.append(file.close())
        types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _MANIFEST.split(", ")])


def _rename(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs as pafs

    fs, base = _open(folder)
    for batch in batches:
        for tmp, name in zip(batch.column("tmp").to_pylist(), batch.column("name").to_pylist(), strict=True):
            if fs.get_file_info(f"{base}/{tmp}").type == pafs.FileType.File:
                fs.move(f"{base}/{tmp}", f"{base}/{name}")
            elif fs.get_file_info(f"{base}/{name}").type != pafs.FileType.File:
                raise OSError(f"neither {tmp} nor {name} is there")
        yield batch


def bounds(pages: DataFrame, shards: int | None = None) -> np.ndarray:
    """The first ids of all shards but the first. By default a shard per SHARD_BYTES of payload, MAX_SHARDS at most.

    The driver gets SAMPLE ids a shard or somewhat more, whatever the number of pages: those whose hash is smallest.
    """
    about = pages.agg(F.count("page_id"), F.coalesce(F.sum(F.octet_length("html").cast("long")), F.lit(0))).first()
    shards = shards or int(min(MAX_SHARDS, about[1] // SHARD_BYTES + 1))
    if shards == 1 or not about[0]:
        return np.zeros(0, np.int64)
    every = max(1, about[0] // (2 * SAMPLE * shards))
    sample = pages.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)).select(F.col("page_id").cast("long").alias("page_id")).distinct()
    ids = np.sort(np.asarray(sample.toArrow().column("page_id"), np.int64))
    return np.unique(ids[np.arange(1, shards) * len(ids) // shards]) if len(ids) else ids


def write(pages: DataFrame, folder: str, shards: int | None = None, roll: int = ROLL_BYTES, date: str = DATE, level: int = LEVEL) -> DataFrame:
    """Write pages(page_id, url, html) to ``folder``; its manifest."""
    spark = pages.sparkSession
    first = bounds(pages, shards)
    known = spark.sparkContext.broadcast(first)  # MAX_SHARDS ids at most

    @F.arrow_udf(T.IntegerType())
    def shard(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(known.value, np.asarray(ids.cast(pa.int64()).fill_null(-(1 << 63))), side="right")
        return pa.array(at.astype(np.int32))

    with temporary(spark):
        refs = materialize(references(pages.select("page_id", "html")), "references").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
        digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
        # references travel with the pages: payloads are shuffled once
        both = pages.select("page_id", "url", "html", digest.alias("digest"), F.lit(None).cast("long").alias("refers_to")).unionByName(refs)
        dealt = both.withColumn("shard", shard("page_id")).repartitionById(len(first) + 1, F.col("shard"))
        rows = dealt.sortWithinPartitions("shard", "page_id", F.col("refers_to").isNull(), "digest", "url")
        rows.mapInArrow(lambda b: _write(b, folder, roll, date, level), _MANIFEST).write.parquet(f"{folder}/_manifest.tmp")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest.tmp")
    manifest.mapInArrow(lambda b: _rename(b, folder), _MANIFEST).write.parquet(f"{folder}/_manifest.done")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(path(f"{folder}/_manifest.done"), path(f"{folder}/manifest"))
    remove(spark, f"{folder}/_manifest.tmp")
    remove(spark, f"{folder}/_tmp")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


class _Members(io.RawIOBase):
    """A readable stream over the gzip members of a file, a chunk at a time."""

    def __init__(self, raw):
        self.raw, self.left, self.z = raw, b"", zlib.decompressobj(31)

    def readable(self):
        return True

    def readinto(self, into):
        while True:
            data = self.left or self.raw.read(1 << 16)
            if not data:
                return 0
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data, len(into))
            self.left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                into[: len(got)] = got
                return len(got)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(":")
            head[k.lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record's end is missing")
        yield head, block


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = _open(folder)

    def batch_of(rows):
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _PAGES.split(", ")])

    for batch in batches:
        for name in batch.column("name").to_pylist():
            rows = []
            with fs.open_input_stream(f"{base}/{name}", compression=None) as raw:
                for head, block in records(io.BufferedReader(_Members(raw), 1 << 16)):
                    if "sha256:" + hashlib.sha256(block).hexdigest() != head["warc-block-digest"]:
                        raise ValueError("a block's digest is wrong")
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    if head["warc-type"] == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError("a payload's digest or length is wrong")
                    number = lambda k: int(v) if (v := head.get(k)) else None
                    rows.append((number("warc-page"), length, digest, head["warc-type"], number("warc-refers-to-page")))
                    if len(rows) >= 8192:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives that a manifest lists, verified against its digests.

    A task reads about READ_BYTES: files go to as many tasks as these, the largest first, by turns.
    """
    n, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = int(max(1, min(n, size // READ_BYTES + 1)))
    # few rows: one a file
    turn = (F.row_number().over(W.orderBy(F.desc("bytes"), "name")) % tasks).cast("int")
    files = manifest.select("name", turn.alias("turn")).repartitionById(tasks, F.col("turn"))
    return files.mapInArrow(lambda b: _read(b, folder), _PAGES)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read(manifest, folder)


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {
    "op6_warc": """
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM m
"""
}
