"""WARC archives as a Python data source, for reading and writing, with revisit records for equal payloads.

Method. Reading plans one partition per archive file. Filters on record types and headers are pushed down: a record's headers
are parsed first, and the payload of a record that no filter wants, or of all records with the option payload=false, is never
inflated. Archives are gzip, a member per record, whose extra field "sl" holds the lengths; members of other writers without
it, and plain .warc files, are read too. Writing leaves one file per task and, per write, a manifest of those committed, so
files of lost or repeated tasks are not read. Mode append keeps what earlier writes committed; overwrite takes it away once the
new manifest stands; an aborted write takes its own files away.

Files are opened by pyarrow's file systems, so any shared store that they know will do; nothing is left on a machine's own disk.

Defined results: a null payload is empty. Line ends in a target URI are percent-encoded; a null one has no header. Rows that
share the largest id of equal payloads are all responses. A null id is less than any other. An empty table gives an archive
without records, which reads as an empty table. A folder without a manifest is read whole. An archive that ends within a record
is an error, which names the file, once a read comes to the cut; records that no filter wants are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from almanax.llm.scratch import new_path

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_NAMES = tuple(part.split()[0] for part in SCHEMA.split(", "))
_ARROW = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in _NAMES])
_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "_records-"  # and a write's own name
_BATCH_BYTES, _CHUNK = 8 << 20, 1 << 16


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _record(kind: str, record_id: str | None, uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind != "revisit":
        body += payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers_to)]
    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] * (kind == "revisit")
    head += [("WARC-Payload-Digest", "sha1:" + payload_digest(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    lines = [f"{k}: {v}" for k, v in head if v is not None]
    clean = [x.replace("\r", "%0D").replace("\n", "%0A") for x in lines]
    return "\r\n".join(["WARC/1.1", *clean, "", ""]).encode() + body + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """A gzip member whose extra field holds the lengths of its deflated data and of the record."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    data = deflate.compress(record) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(data), len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + struct.pack("<H", len(extra)) + extra + data + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    records: int


def _manifests(files: fs.FileSystem, root: str) -> dict[str, dict[str, int]]:
    """Records of each archive, by the manifest that names it."""
    found = [x.path for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith(MANIFEST)]
    out = {}
    for path in found:
        with files.open_input_stream(path, compression=None) as src:
            out[path] = json.loads(src.read())
    return out


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool = False) -> None:
        self.path, self.names, self.overwrite = path, names, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        name, n = f"{uuid.uuid4().hex}.warc.gz", 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                column = {k: batch.column(i) for i, k in enumerate(self.names)}
                empty = [None] * batch.num_rows
                texts = [column[k].to_pylist() if k in column else empty for k in _HEADERS]
                for kind, record_id, uri, refers_to, payload in zip(*texts, column["payload"], strict=True):
                    out.write(_member(_record(kind or "response", record_id, uri, refers_to, payload.as_py() or b"")))
                    n += 1
        return _Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        earlier = _manifests(files, root) if self.overwrite else {}
        with files.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps({m.name: m.records for m in messages if m}).encode())
        for path, names in earlier.items():
            files.delete_file(path)
            for name in names:
                files.delete_file(f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _filesystem(self.path)
        for m in messages:
            if m and files.get_file_info(f"{root}/{m.name}").type == fs.FileType.File:
                files.delete_file(f"{root}/{m.name}")


class _CutShort(ValueError):
    """An archive ends within a record."""


class _Stream:
    """A record's bytes, taken as they are asked for."""

    def __init__(self, read, inflate) -> None:
        self.read, self.inflate, self.raw, self.text = read, inflate, b"", b""

    def more(self) -> bool:
        data = self.read()
        if not data:
            return False
        self.text += self.inflate(data)
        return True

    def upto(self, mark: bytes) -> bytes:
        while (at := self.text.find(mark)) < 0:
            if not self.more():
                raise _CutShort("within headers")
        found, self.text = self.text[:at], self.text[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        parts, have = [self.text], len(self.text)
        while have < n:
            self.text = b""
            if not self.more():
                raise _CutShort("within a block")
            parts.append(self.text)
            have += len(self.text)
        whole = b"".join(parts)
        self.text = whole[n:]
        return whole[:n]


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        """Equality, lists and prefixes on header columns are ours; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in [(n,) for n in (*_HEADERS, "payload_digest")]:
                self.wanted.append((f.attribute[0], type(f).__name__, tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, root = _filesystem(self.path)
        if files.get_file_info(root).type == fs.FileType.File:
            return [_File(self.path)]
        base = self.path.rstrip("/")
        if manifests := _manifests(files, root):
            names = [k for m in manifests.values() for k, n in m.items() if n]
        else:
            names = [x.base_name for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.endswith((".warc", ".warc.gz"))]
        return [_File(f"{base}/{n}") for n in sorted(names)]

    def _fits(self, row: dict) -> bool:
        for name, kind, value in self.wanted:
            got = row[name]
            if got is None or (got != value if kind == "EqualTo" else got not in value if kind == "In" else not got.startswith(value)):
                return False
        return True

    def _row(self, stream: _Stream) -> tuple[dict, int, bool]:
        """A record's header columns, the bytes of its block, and whether its payload is wanted."""
        head = _headers(stream.upto(b"\r\n\r\n"))
        row = {n: head.get(h) for n, h in _HEADERS.items()}
        row["payload_digest"] = head["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in head else None
        return row, int(head.get("content-length", 0)), self._fits(row)

    def _body(self, stream: _Stream, row: dict, size: int) -> dict:
        """The row with its payload; a revisit has the length that its HTTP header names."""
        if row["record_type"] not in ("response", "revisit"):
            return row | {"payload_bytes": size, "payload": stream.take(size) if self.payload else None}
        raw = stream.upto(b"\r\n\r\n")
        rest = size - len(raw) - 4
        if row["record_type"] == "revisit":
            return row | {"payload_bytes": int(_headers(raw).get("content-length", 0)), "payload": None}
        return row | {"payload_bytes": rest, "payload": stream.take(rest) if self.payload else None}

    def _gzip(self, src: pa.NativeFile) -> Iterator[dict]:
        at, end = 0, src.size()
        while at < end:
            src.seek(at)
            head = src.read(24)
            inflate = zlib.decompressobj(31)
            after = at + 24 + struct.unpack("<I", head[16:20])[0] + 8 if head[3:4] == b"\x04" and head[12:14] == b"sl" else None
            src.seek(at)
            got = 0

            def read() -> bytes:
                nonlocal got
                data = b"" if inflate.eof else src.read(_CHUNK if after is None else min(_CHUNK, after - at - got))  # noqa: B023
                got += len(data)
                return data

            stream = _Stream(read, inflate.decompress)
            row, size, fits = self._row(stream)
            if fits:
                yield self._body(stream, row, size)
            if after is None:  # no lengths given: inflate to the member's end, keeping nothing
                while not inflate.eof and (data := read()):
                    inflate.decompress(data)
                after = at + got - len(inflate.unused_data)
            at = after

    def _plain(self, src: pa.NativeFile) -> Iterator[dict]:
        at, end = 0, src.size()
        while at < end:
            src.seek(at)
            got = 0

            def read() -> bytes:
                nonlocal got
                data = src.read(_CHUNK)
                got += len(data)
                return data

            stream = _Stream(read, lambda x: x)
            row, size, fits = self._row(stream)
            body = at + got - len(stream.text)
            if fits:
                yield self._body(stream, row, size)
            at = body + size + 4

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive has a record
            return
        files, name = _filesystem(partition.path)
        try:
            with files.open_input_file(name) as src:
                yield from self._batches(src)
        except (_CutShort, struct.error) as cut:
            raise ValueError(f"{partition.path} ends within a record") from cut

    def _batches(self, src: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        zipped = src.read(2) == b"\x1f\x8b"
        rows, held = [], 0
        for row in self._gzip(src) if zipped else self._plain(src):
            rows.append(row)
            held += 500 + len(row["payload"] or b"")
            if held > _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path); the option payload=false leaves the payload column null."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records of pages, ready to be written: of equal payloads of at least least_bytes, the largest id's is the response."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("target_uri"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.sha1("payload"))
    copies = rows.where(F.length("payload") >= least_bytes).groupBy("same").agg(F.max("id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "newest")
    told = rows.join(copies, "same", "left")
    revisit = F.col("newest").isNotNull() & ~F.col("id").eqNullSafe(F.col("newest"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return told.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("id").alias("record_id"), "target_uri", F.when(revisit, urn("newest")).alias("refers_to"), "payload")


def write_warc(records: DataFrame, path: str, mode: str = "append") -> None:
    """mode: append or overwrite."""
    register(records.sparkSession)
    records.write.format("warc").mode(mode).save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    # Spark plans a read anew if it has a filter to push, and else takes up the last one's filters; so there is always one
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path).where("payload_bytes is not null")


def page_number(urn: str):
    """The id in a record's URN, as a Column."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


@F.arrow_udf(StringType())
def digest_of(payloads: pa.Array) -> pa.Array:
    return pa.array([payload_digest(p.as_buffer()) if p.is_valid else None for p in payloads], pa.string())


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write pages as archives under the shared folder and read them back: the records, with digests of the payloads read.

    Revisits are read by their headers; no payload is inflated for them.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(with_revisits(pages, **columns), path)
    number = page_number("record_id").alias("page_id")
    whole = read_warc(spark, path).where("record_type = 'response'")
    whole = whole.select(number, F.length("payload").cast("long").alias("payload_bytes"), digest_of("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return whole.unionByName(again.select(number, "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to")))
