"""Deterministic sharded WARC writer and reader.

Records are sorted within ranges of their ids, so the content of every file depends on the rows
alone and not on how a cluster splits them. Files roll by compressed size, each record is a gzip
member with regenerated headers and digests, a file gets its final name when it is complete, and
the manifest, written last, names the files that count.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import byte_length, fresh_path, rows_of

RANGE = 4096                    # ids of one range
SLOT_BYTES = 256 << 20          # payload of a range beyond which it is split by digest
READ_BYTES = 32 << 20           # compressed bytes that a task reads back
ROLL_BYTES = 16 << 20           # compressed size at which a file ends
LEAST_REVISIT = 100             # bytes of a payload that may be referred to
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, n_records bigint, n_bytes bigint, sha256 string"
RECORD = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to bigint, html string")


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, first`` of the payloads that revisit another record; no html is moved for it."""
    rows = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"),
                        byte_length("html").alias("size")).filter(F.col("size") >= LEAST_REVISIT)
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")) \
        .filter("n > 1").drop("n")
    return rows.join(first, "digest").filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))) \
        .select("page_id", "digest", "first").distinct()


def _range() -> Column:
    return F.coalesce(F.floor(F.col("page_id") / RANGE), F.lit(-1)).cast("long").alias("range")


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    name = hashlib.sha256(json.dumps([page_id, url, digest]).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def record_bytes(page_id, url, html, digest, size, record_type, refers_to) -> bytes:
    head = [("WARC-Type", record_type), ("WARC-Record-ID", _record_id(page_id, url, digest)),
            ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "urn:none", safe="%:/?#[]@!$&'()*+,;=~")),
            ("WARC-Payload-Digest", f"sha256:{digest}")]
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if record_type == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("X-Refers-To-Page", json.dumps(refers_to))]
        block = f"{status}\r\n".encode()
    else:
        payload = html.encode("utf-8", "surrogatepass")
        block = f"{status}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
             ("X-Page-Id", json.dumps(page_id)), ("X-Url", json.dumps(url)), ("X-Payload-Length", str(size))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("ascii") + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member; no time or name in it, so equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """Writes the files of one task: a temporary name first, the final one when a file is complete."""

    def __init__(self, path: str, roll_bytes: int):
        self.system, self.folder = fs.FileSystem.from_uri(path)
        self.roll_bytes, self.stream, self.group, self.number = roll_bytes, None, None, 0

    def add(self, group: tuple[int, int], data: bytes) -> Iterator[tuple]:
        if self.stream and (group != self.group or self.size >= self.roll_bytes):
            yield self.close()
        if group != self.group:
            self.group, self.number = group, 0
        if self.stream is None:
            self.name = f"range-{group[0]:+014d}-{group[1]:04d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.system.create_dir(self.folder, recursive=True)
            self.stream = self.system.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        packed = _member(data)
        self.stream.write(packed)
        self.digest.update(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> tuple:
        self.stream.close()
        self.system.move(self.temporary, f"{self.folder}/{self.name}")
        self.stream = None
        self.number += 1
        return self.name, self.records, self.size, self.digest.hexdigest()


def write_archives(pages: DataFrame, path: str | None = None, roll_bytes: int = ROLL_BYTES) -> str:
    """Writes one record per row of ``pages`` and the manifest; returns the folder.

    Null html is an empty payload; a null url or page id is kept as such in headers of its own. Of
    equal payloads of at least ``LEAST_REVISIT`` bytes the one of the smallest id is a response and the
    others revisit it; rows that repeat that id are responses as well, and payloads that only rows
    without an id have are responses. Very long payloads are one record; an empty table gives an
    empty manifest. Columns but ``page_id, url, html`` are not read.
    """
    path = path or fresh_path(pages.sparkSession, "archives")
    # A range counts here only beyond SLOT_BYTES, so this has at most a row per SLOT_BYTES of payload.
    slots = F.broadcast(pages.select(_range(), byte_length("html").alias("size")).groupBy("range")
                        .agg((F.sum("size") / SLOT_BYTES).cast("long").alias("n")).filter("n > 0"))
    slot = F.coalesce(F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.col("n") + 1), F.lit(0))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select("*", _range()).join(slots, "range", "left").withColumn("slot", slot.cast("int")).drop("n")

    text = F.coalesce("html", F.lit(""))
    rows = placed(pages.select("page_id", "url", text.alias("html"), F.sha2(text, 256).alias("digest"),
                               byte_length("html").alias("size"), F.lit(None).cast("long").alias("first")))
    order = ["range", "slot", "page_id", "digest", F.col("size").asc_nulls_first(), "url"]
    rows = rows.unionByName(placed(revisits(pages)), allowMissingColumns=True) \
        .select("range", "slot", "page_id", "url", "html", "digest", "size", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done, marked = _Files(path, roll_bytes), [], None
        for group, slot_, page_id, url, html, digest, size, first in rows_of(batches, 32):
            if size is None:                            # says what the records after it revisit
                marked = page_id, digest, first
                continue
            revisit = marked is not None and marked[:2] == (page_id, digest)
            done += files.add((group, slot_), record_bytes(
                page_id, url, html, digest, size, *(("revisit", marked[2]) if revisit else ("response", None))))
        if files.stream:
            done.append(files.close())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["path", "n_records", "n_bytes", "sha256"])

    rows.repartition("range", "slot").sortWithinPartitions(*order) \
        .mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return path


def _members(stream) -> Iterator[bytes]:
    """Gzip members of a stream, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a WARC file ends within a record")


def parsed(record: bytes) -> tuple:
    """The row of a record; digests of responses are computed anew and compared."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("ascii").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"wrong block digest in {fields['WARC-Record-ID']}")
    payload, kind = block.partition(b"\r\n\r\n")[2], fields["WARC-Type"]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if kind == "response":
        if (digest, size) != (hashlib.sha256(payload).hexdigest(), len(payload)):
            raise ValueError(f"wrong payload digest in {fields['WARC-Record-ID']}")
    return (json.loads(fields["X-Page-Id"]), json.loads(fields["X-Url"]), size, digest, kind,
            json.loads(fields.get("X-Refers-To-Page", "null")),
            payload.decode("utf-8", "surrogatepass") if kind == "response" else None)


def read_archives(spark: SparkSession, path: str, with_html: bool = True) -> DataFrame:
    """The records of the files in the manifest; revisits have no ``html`` of their own."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        for name, n_records in rows_of(batches):
            held, size, seen = [], 0, 0
            with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                for member in _members(stream):
                    row = parsed(member)
                    held.append(row if with_html else (*row[:-1], None))
                    size += len(member) if with_html else 100
                    seen += 1
                    if size >= 4 << 20:
                        yield _record_batch(held)
                        held, size = [], 0
            if seen != n_records:
                raise ValueError(f"{name} holds {seen} records, the manifest says {n_records}")
            if held:
                yield _record_batch(held)

    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    size = manifest.agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes")).first()
    # A stated number of partitions stays as it is; the manifest itself is far too small to be split.
    n = min(max(size.files, 1), max(4 * spark.sparkContext.defaultParallelism, (size.bytes or 0) // READ_BYTES + 1))
    return manifest.select("path", "n_records").repartitionByRange(n, "path").mapInArrow(read, RECORD)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)
