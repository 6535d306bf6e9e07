"""WARC archives as a Spark data source, and pages written to and read from them.

The source plans one partition per archive. Predicates on record headers are pushed down to it: a
partition parses a record's header first and, where the record is not wanted or its payload is not asked
for, passes over the payload without inflating it. Each record is a gzip member of its own whose length
stands in the member's "sl" extra field.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull,
    StringContains, StringStartsWith, WriterCommitMessage,
)

from roomledger.llm.arrow import BATCH_BYTES, BATCH_ROWS, bounded_batches
from roomledger.session import work_dir

REVISIT_LEAST = 1000  # bytes; smaller payloads are always stored
ARCHIVE_BYTES = 128 << 20  # an archive is closed and another begun beyond this
HEAD_BYTES = 4096  # of a record that are inflated to parse its header
READ_BYTES = 1 << 20
SCHEMA = "record_type string, target_uri string, record_id string, refers_to string, payload_digest string, payload_bytes long, payload binary"
HEADERS = {  # column: header field
    "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, for a URI or a plain path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def clean_field(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_head(fields: dict[str, str], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {clean_field(v)}" for k, v in fields.items()), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and where the content begins; None when the header isn't complete yet."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    return {k: v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with its own length, and the record's, in the "sl" extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class _Archive(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of SCHEMA as records. Only archives that the manifest of a finished job names count.

    Attempts write under names of their own, so lost or repeated tasks leave nothing that is read.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*HEADERS, "payload"]), strict=True):
                if out is None or size > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                *values, payload = row
                fields = {h: str(v) for h, v in zip(HEADERS.values(), values, strict=True) if v is not None} | {"WARC-Date": date}
                if fields["WARC-Type"] == "revisit":
                    fields["WARC-Profile"] = REVISIT_PROFILE
                content = payload or b""
                data = member(record_head(fields, len(content)) + content + b"\r\n\r\n")
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        files = [name for m in messages if m is not None for name in m.files]
        with store.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        """Nothing to undo: without a manifest the archives aren't read."""


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.wanted = path, columns, []

    def pushFilters(self, filters):  # noqa: N802
        """Takes what a record's header answers; the rest goes back to Spark."""
        for f in filters:
            named = getattr(f, "attribute", (None,))
            if len(named) == 1 and named[0] in HEADERS and named[0] != "payload_bytes" and isinstance(
                f, (EqualTo, In, IsNull, IsNotNull, StringStartsWith, StringContains)
            ):
                self.wanted.append(f)
            else:
                yield f

    def partitions(self):
        store, root = open_store(self.path)
        files = []
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("manifest-"):
                with store.open_input_stream(info.path) as file:
                    files += json.loads(file.read())
        return [_Archive(name) for name in sorted(files)]

    def _keep(self, fields: dict[str, str]) -> bool:
        return all(_matches(f, fields.get(HEADERS[f.attribute[0]])) for f in self.wanted)

    def read(self, partition):
        if partition is None or not getattr(partition, "path", None):
            return
        store, root = open_store(self.path)
        rows, size = [], 0
        with store.open_input_file(f"{root}/{partition.path}") as file:
            for fields, content in records(file, self._keep, "payload" in self.columns):
                values = [fields.get(HEADERS[c]) if c in HEADERS else content for c in self.columns]
                rows.append([int(v) if c == "payload_bytes" and v is not None else v for c, v in zip(self.columns, values, strict=True)])
                size += 256 + len(content or b"")
                if len(rows) >= BATCH_ROWS or size > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        return pa.RecordBatch.from_arrays(
            [pa.array(v, kinds.get(c, pa.string())) for c, v in zip(self.columns, zip(*rows, strict=True), strict=True)], names=self.columns)


def _matches(f, value: str | None) -> bool:
    if isinstance(f, IsNull):
        return value is None
    if value is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, StringContains):
        return f.value in value
    return value == f.value


def records(file, keep, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers, and content where asked for, of an archive's wanted records.

    Only the first bytes of a member are inflated until its header is known. The member's own length
    then leads to the next one.
    """
    at, total = 0, file.size()
    buffer, base = b"", 0

    def span(start: int, length: int) -> bytes:
        nonlocal buffer, base
        if start < base or start + length > base + len(buffer):
            file.seek(start)
            buffer, base = file.read(max(length, READ_BYTES)), start
        return buffer[start - base : start - base + length]

    while at < total:
        head = span(at, 24)
        if len(head) < 24 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl":
            raise ValueError(f"no record with a length at byte {at}")
        length, whole = struct.unpack("<II", head[16:24])
        inflate = zlib.decompressobj(-15)
        body = at + 24
        data = b""
        parsed, taken = None, 0
        while parsed is None and taken < length - 32:
            step = span(body + taken, min(HEAD_BYTES, length - 32 - taken))
            data += inflate.decompress(inflate.unconsumed_tail + step, HEAD_BYTES) if not payload else inflate.decompress(step)
            taken += len(step)
            parsed = parse_head(data)
        if parsed is None:
            data += inflate.flush()
            parsed = parse_head(data)
            if parsed is None:
                raise ValueError(f"a record without a header's end at byte {at}")
        fields, start = parsed
        if keep(fields):
            content = None
            if payload:
                data += inflate.decompress(span(body + taken, length - 32 - taken)) + inflate.flush()
                if len(data) & 0xFFFFFFFF != whole:
                    raise ValueError(f"a damaged record at byte {at}")
                content = data[start : start + int(fields["Content-Length"])]
            yield fields, content
        at += length


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``, ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of a folder of archives; without the payload none is inflated beyond its header."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    if not payload:
        reader = reader.schema(", ".join(f for f in SCHEMA.split(", ") if not f.startswith("payload binary")))
    return reader.load(path)


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows of SCHEMA as records; appends to a folder's archives."""
    records.sparkSession.dataSource.register(WarcSource)
    bounded_batches(records.sparkSession)
    columns = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    records.select(*columns).write.format("warc").mode("append").save(path)


def page_records(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """A record per page; of equal payloads of REVISIT_LEAST bytes or more, the one with the largest id has it.

    A null page has an empty payload. Rows that repeat the largest id are all responses. A row without
    an id revisits nothing and is a response. Payloads that occur once are not joined to anything; a
    payload that a third of all pages share is one group on the right side, and its pages are split.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    long = F.octet_length("payload") >= REVISIT_LEAST
    shared = (
        rows.filter(long).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "last"))
    joined = rows.join(shared.hint("shuffle_hash"), "digest", "left")
    revisit = F.coalesce(long & (F.col("id") < F.col("last")), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        name(F.col("id")).alias("record_id"), F.when(revisit, name(F.col("last"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def _payload_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch.column("payload").to_pylist()
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("record_id", "payload_digest", "payload_bytes", "record_type", "refers_to")),
            pa.array([hashlib.sha1(p).hexdigest() for p in payloads], pa.string()), pa.array(map(len, payloads), pa.int64()),
        ], names=["record_id", "payload_digest", "payload_bytes", "record_type", "refers_to", "read_digest", "read_bytes"])


def round_trip(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, from archives written and read back.

    Responses are read with their payloads, whose length and digest are taken anew and must be those of
    the header. Revisits are read by a predicate on the record type, without payloads.
    """
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_warc(page_records(pages, id_col, url_col, html_col), path)
    bounded_batches(spark)
    fields = "record_id string, payload_digest string, payload_bytes long, record_type string, refers_to string"
    responses = read_warc(spark, path).filter("record_type = 'response'").mapInArrow(
        _payload_hashes, f"{fields}, read_digest string, read_bytes long")
    same = (F.col("payload_digest") == F.concat(F.lit("sha1:"), "read_digest")) & (F.col("payload_bytes") == F.col("read_bytes"))
    responses = responses.withColumn("payload_digest", F.when(same, F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("a payload differs from its header: "), "record_id")))).drop("read_digest", "read_bytes")
    revisits = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").select(*responses.columns)
    kind = pages.schema[id_col].dataType.simpleString()
    page = lambda c: F.regexp_extract(c, "<urn:page:(.*)>", 1).cast(kind)
    return responses.unionByName(revisits).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", F.substring("payload_digest", 6, 40).alias("payload_digest"),
        "record_type", F.when(F.col("refers_to").isNotNull(), page(F.col("refers_to"))).alias("refers_to"))
