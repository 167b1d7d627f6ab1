"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page id into shards of about equal payload; a shard is one task's files, rolled by compressed
size. Headers and digests are made anew from the payload, with a fixed date and ids derived from the content, so a task
that runs again writes the same bytes. Files are written under temporary names and renamed; those that count are listed in
a manifest table, which the driver commits last.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, parts_for, range_index, range_plan, scratch_path, small

DATE = "2020-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gridloom:warc")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload of a shard, about (more where there would be over common.MOST_RANGES of them), and the compressed size from which
#: a file is rolled. A shard is the part of one task and says nothing of the files' sizes.
SHARD_BYTES, ROLL_BYTES = 16 << 20, 4 << 20
#: Hex digits of the digest by which the records of one page id are dealt to shards.
TIE_DIGITS = 15
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 0
#: Records and payload that the reader hands on at once.
BATCH_RECORDS, BATCH_BYTES = 256, 8 << 20
_MANIFEST = "file string, shard int, seq int, records long, bytes long, sha256 string, least_id long, greatest_id long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record, before compression. copy: 0, 1, … of records with the same id and payload."""
    digest = payload_digest(payload)
    name = lambda page, k: uuid.uuid5(NAMESPACE, f"{page} {digest} {k}").urn
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<{name(page_id, copy)}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _header_value(url))] if url else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{name(refers_to, 0)}>")] if is_revisit else []),
        *([("X-Page-ID", str(page_id))] if page_id is not None else []),
        *([("X-Refers-To-Page-ID", str(refers_to))] if is_revisit and refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Writes the records of one shard to files of at least `roll` compressed bytes."""

    def __init__(self, folder: str, roll: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.roll, self.shard, self.seq, self.out = roll, -1, 0, None

    def add(self, shard: int, page_id: int | None, raw: bytes) -> Iterator[tuple]:
        if shard != self.shard:
            yield from self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:04d}.warc.gz"
            attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
            self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.temporary = f"{self.folder}/_temporary/{self.name}.{attempt}.{uuid.uuid4().hex[:8]}"
            self.out, self.size, self.records, self.sha, self.ids = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256(), []
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if page_id is not None:
            self.ids = [min([page_id, *self.ids]), max([page_id, *self.ids])]
        if self.size >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            yield self.name, self.shard, self.seq, self.records, self.size, self.sha.hexdigest(), *(self.ids or [None, None])
            self.out, self.seq = None, self.seq + 1


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) under folder; the manifest, one row per file.

    The payload is html in UTF-8 (null: empty). Of records with equal payloads of at least revisit_bytes, the one with the
    largest page_id is a response and the others are revisits of it; where rows repeat that id and payload, the first is
    the response. Null ids come first, and are responses only if no id has their payload; records of one id follow each
    other by digest, and many of them have several shards. No pages: no file and an empty manifest. A payload is held in
    memory whole, but only one at a time.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    meta = cut(rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("size")), "payloads")
    # who is revisited: summed by payload before the shuffle; only payloads that repeat are joined back
    counted = meta.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    # written, so that a payload that many pages share can be split over tasks in the join
    repeated = cut(counted.select("digest", "first_id"), "repeated-payloads")
    marks = cut(meta.join(small(repeated, repeated.count()), "digest").select("page_id", "digest", "first_id").distinct(), "revisits")
    tie = F.conv(F.substring("digest", 1, TIE_DIGITS), 16, 10).cast("long")
    ranges = range_plan(meta, "page_id", F.col("size") + 512, shard_bytes, tie, 16**TIE_DIGITS)
    shard = range_index(F.col("page_id"), ranges, tie).cast("int")
    dealt = (
        rows.withColumn("digest", F.sha1("html"))
        .select(shard.alias("shard"), "page_id", F.lit(1).alias("kind"), "digest", "url", "html", F.lit(None).cast("long").alias("first_id"))
        .unionByName(marks.select(shard.alias("shard"), "page_id", F.lit(0).alias("kind"), "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first_id"))
        .repartitionById(len(ranges), F.col("shard"))
        .sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, current, marked, first_id, k = _Roller(folder, roll_bytes), None, False, None, 0

        def told(files) -> Iterator[pa.RecordBatch]:
            for f in files:
                yield pa.RecordBatch.from_pylist([dict(zip(names, f))], schema)

        for b in batches:
            for at, page, kind, digest, url, html, first in zip(*(c.to_pylist() for c in b.columns)):
                if (at, page, digest) != current:
                    current, marked, first_id, k = (at, page, digest), False, None, -1
                if kind == 0:
                    marked, first_id = True, first
                    continue
                k += 1
                again = marked and (first_id != page or k > 0)
                yield from told(roller.add(at, page, record(page, k, url, html.encode(), first_id, again)))
        yield from told(roller.close())

    names = [x.split()[0] for x in _MANIFEST.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _MANIFEST.split(", ")])
    return cut(dealt.mapInArrow(run, _MANIFEST), "manifest")


def members(source: BinaryIO, step: int = 1 << 16) -> Iterator[bytes]:
    """What each gzip member of a stream unpacks to; read `step` bytes at a time, so a file costs no more than its largest record."""
    unpacker, found, left = zlib.decompressobj(31), [], source.read(step)
    while left:
        found.append(unpacker.decompress(left))
        left = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(found)
            unpacker, found = zlib.decompressobj(31), []
        # what is left over is at most one step, so handing it on costs little; then the stream goes on
        left = left or source.read(step)
    if found:
        raise ValueError("the archive ends within a record")


def parse(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    for raw in members(source):
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        block = rest[: int(fields["content-length"])]
        if rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha1:{payload_digest(block)}":
            raise ValueError(f"damaged record {fields.get('warc-record-id')}")
        yield fields, block


class _Hashed:
    """A stream that sums what is read from it."""

    def __init__(self, source: BinaryIO):
        self.source, self.sha = source, hashlib.sha256()

    def read(self, n: int) -> bytes:
        got = self.source.read(n)
        self.sha.update(got)
        return got


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, file) of every record of the manifest's files.

    payload is null for revisits; its size and digest are those of the full payload. A file with other bytes than the
    manifest says, or with a damaged record, is an error. Files are read as streams, a record at a time.
    """
    wanted = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "file": pa.string()}
    schema = pa.schema(list(wanted.items()))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), wanted.values())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
                with store.open_input_stream(path, compression=None) as f:
                    source, rows, held = _Hashed(f), [], 0
                    for fields, block in parse(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"damaged payload in {fields['warc-record-id']}")
                        number = lambda k: int(fields[k]) if k in fields else None
                        rows.append((number("x-page-id"), fields.get("warc-target-uri"), payload.decode() if kind == "response" else None, size, digest, kind, number("x-refers-to-page-id"), name))
                        held += len(payload)
                        if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                if source.sha.hexdigest() != sha:
                    raise ValueError(f"{name} has other bytes than its manifest says")
                if rows:
                    yield batch(rows)

    files = manifest.select("file", "sha256")
    return files.repartition(parts_for(spark, files.count(), 8)).mapInArrow(run, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read the records back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder)).drop("payload", "url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM r
"""
