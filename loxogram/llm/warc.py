"""WARC archives as a Python data source: ``format("warc")`` reads and writes them.

Reading plans one partition for each archive file (the writer starts a new file at ``max_bytes``, so a
file is a bounded piece of work). Record headers are parsed first; filters on ``warc_type``,
``record_id``, ``target_uri``, ``payload_digest`` and the lengths are pushed down and judged on headers alone, and the payload of
a record that fails them, or any payload under option ``payload=false``, is passed over: in a plain
archive by a seek, in a compressed one by inflating without keeping.

Writing gives each task attempt a file of its own under a hidden name; the commit renames the files of the
attempts that won, so lost executors and repeated tasks leave no record twice. The folder must be one
that all executors reach.

Archives hold WARC/1.1 records of HTTP responses; a revisit carries the headers of its response,
with the full payload's length and digest, and no payload (profile identical-payload-digest).

Defined cases: a null payload is empty; a null uri or date is left out (and read as null); control
characters in header values are percent-encoded; an empty table writes an empty folder, which reads as no rows;
files that are neither .warc nor .warc.gz are ignored; a record cut short raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import scratch_path, table

SCHEMA = "warc_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
ARROW = pa.schema([*((n, pa.string()) for n in ("warc_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")), ("payload_length", pa.int64()), ("payload", pa.binary())])
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
BATCH_BYTES = 4 << 20


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def header_value(value: str) -> str:
    return re.sub("[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode(warc_type: str, record_id: str, uri: str | None, date: str | None, refers_to: str | None, digest: str, length: int, payload: bytes) -> bytes:
    """One record. ``digest`` is hex SHA-1 of the full payload, ``length`` its bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if warc_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {warc_type}", f"WARC-Record-ID: <{header_value(record_id)}>"]
    for name, value in (("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers_to and f"<{refers_to}>"), ("WARC-Profile", REVISIT if warc_type == "revisit" else None)):
        if value is not None:
            lines.append(f"{name}: {header_value(value)}")
    lines += [
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_headers(f) -> dict[str, str] | None:
    """Header fields up to the blank line, names in lower case; None at the end of the file."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := f.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a WARC record ends within its headers")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_http(f, left: int) -> tuple[int | None, int]:
    """(Content-Length of the HTTP headers, bytes of the block that they leave)."""
    length = None
    while left > 0:
        line = f.readline(left)
        if not line:
            raise ValueError("a WARC record is cut short")
        left -= len(line)
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            length = int(value)
    return length, left


def hex_digest(value: str | None) -> str | None:
    algorithm, _, digest = (value or "").partition(":")
    if algorithm != "sha1":
        return value
    return base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower()


def passes(f: Filter, value) -> bool:
    if isinstance(f, In):
        return value in f.value
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, GreaterThan):
        return value > f.value
    if isinstance(f, GreaterThanOrEqual):
        return value >= f.value
    return value < f.value if isinstance(f, LessThan) else value <= f.value


def read_records(f, filters: list[Filter], want_payload: bool, seekable: bool) -> Iterator[tuple]:
    """Rows of SCHEMA from an open archive."""
    trim = lambda s: s[1:-1] if s and s[0] == "<" else s
    while (h := read_headers(f)) is not None:
        left = int(h.get("content-length", 0))
        row = {
            "warc_type": h.get("warc-type"),
            "record_id": trim(h.get("warc-record-id")),
            "target_uri": trim(h.get("warc-target-uri")),
            "date": h.get("warc-date"),
            "refers_to": trim(h.get("warc-refers-to")),
            "payload_digest": hex_digest(h.get("warc-payload-digest")),
        }
        good = all(passes(x, row[x.attribute[0]]) for x in filters if x.attribute[0] in row)
        payload = None
        if good:
            length = None
            if h.get("content-type", "").startswith("application/http"):
                length, left = read_http(f, left)
            row["payload_length"] = left if length is None or row["warc_type"] != "revisit" else length
            good = all(passes(x, row["payload_length"]) for x in filters if x.attribute[0] == "payload_length")
            if good and want_payload and row["warc_type"] != "revisit":
                payload = f.read(left)
                if len(payload) < left:
                    raise ValueError("a WARC record is cut short")
                left = 0
        if seekable:
            f.seek(left, io.SEEK_CUR)
        else:
            while left > 0 and (gone := len(f.read(min(left, 1 << 20)))):
                left -= gone
        if good:
            yield (*row.values(), payload)


@dataclass
class ArchivePartition(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    PUSHED = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)
    HEADERS = frozenset(("warc_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload_length"))

    def __init__(self, options):
        self.path, self.want_payload = options["path"], options.get("payload", "true").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, self.PUSHED) and len(f.attribute) == 1 and f.attribute[0] in self.HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = open_folder(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        return [ArchivePartition(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and re.search(r"(^|/)[^_./][^/]*\.warc(\.gz)?$", x.path)]

    def read(self, partition: ArchivePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty plan
            return
        system, _ = open_folder(self.path)
        with system.open_input_file(partition.path) as raw:
            packed = partition.path.endswith(".gz")
            f = io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 18)
            rows, held = [], 0
            for row in read_records(f, self.filters, self.want_payload, not packed):
                rows.append(row)
                held += 200 + len(row[-1] or b"")
                if held > BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of SCHEMA, columns in any order; others are ignored."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level, self.max_bytes = int(options.get("level", 1)), int(options.get("max_bytes", 128 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        files, out, size, base = [], None, 0, uuid.uuid4().hex
        end = ".warc.gz" if self.level else ".warc"
        for batch in iterator:
            names = ("warc_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload_length", "payload")
            for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                record = encode(*row[:6], row[6] or 0, row[7] or b"")
                record = gzip.compress(record, self.level, mtime=0) if self.level else record
                if out is None or size + len(record) > self.max_bytes:
                    if out:
                        out.close()
                    files.append(f"{root}/_{base}-{len(files):05d}{end}")
                    out, size = system.open_output_stream(files[-1], compression=None), 0
                out.write(record)
                size += len(record)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_folder(self.path)
        system.create_dir(root, recursive=True)
        new = [f for m in messages if m for f in m.files]
        if self.overwrite:
            for x in system.get_file_info(pafs.FileSelector(root)):
                if x.is_file and x.path not in new:
                    system.delete_file(x.path)
        for f in new:
            folder, _, name = f.rpartition("/")
            system.move(f, f"{folder}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = open_folder(self.path)
        for f in (f for m in messages if m for f in m.files):
            system.delete_file(f)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes a record for each row of (page_id, url, html). Of equal payloads of ``min_bytes`` and more the
    one with the largest page_id is the response and the others revisit it; rows that also share that id are all responses.
    """
    register(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select(F.col("page_id"), F.col("url"), html.alias("payload"))
    hashed = hashed.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    shared = hashed.where(F.col("payload_length") >= min_bytes).groupBy("payload_digest", "payload_length").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1 and first is not null").drop("n")
    joined = hashed.join(shared, ["payload_digest", "payload_length"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    records = joined.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        name(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.when(again, name(F.col("first"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: of responses length and digest come from the payload itself, of revisits from headers."""
    register(spark)
    number = lambda c: F.regexp_extract(c, "([0-9-]+)$", 1).try_cast("long")
    full = spark.read.format("warc").load(path).where("warc_type = 'response'")
    full = full.withColumn("payload_length", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    bare = spark.read.format("warc").option("payload", "false").load(path).where("warc_type = 'revisit'")
    return full.unionByName(bare).select(
        number(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"),
    )


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT b, max(page_id) AS top, count(*) AS n FROM p GROUP BY b)
SELECT page_id, octet_length(p.b)::BIGINT AS payload_bytes, sha1(p.b) AS payload_digest,
  CASE WHEN n > 1 AND octet_length(p.b) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND octet_length(p.b) >= 1000 AND page_id <> top THEN top END AS refers_to
FROM p JOIN g ON p.b = g.b
"""
