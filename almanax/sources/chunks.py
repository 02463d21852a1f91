"""Recorded chunks of byte streams as a source, for batches and for streams.

A mountpoint is a folder; a chunk is a file in it, NUMBER-ARRIVAL.chunk, with a number that counts up and the arrival in Unix
milliseconds. A stream's offset is the next number of each mountpoint. Chunks are admitted in order, as far as no number is missing;
with a limit, a batch takes that many of each mountpoint. For a limit the reader has to know where it is before Spark tells it, so it
keeps the end of each batch that it plans in the file `progress`: Spark logs a batch's end first and plans it then, so after a restart
it is the end of the last batch logged or is set as that batch is planned again. Nothing is lost or repeated.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from almanax.sources.files import filesystem

SCHEMA = "mountpoint string, seq long, arrival timestamp, data binary"
_ARROW = pa.schema([("mountpoint", pa.string()), ("seq", pa.int64()), ("arrival", pa.timestamp("us", "UTC")), ("data", pa.binary())])
#: Chunks of a mountpoint that a task reads at most, and bytes of them that it holds at a time.
TASK_CHUNKS, _HELD = 1000, 8 << 20
_SUFFIX = ".chunk"


def chunk_name(seq: int, arrival_ms: int) -> str:
    return f"{seq:012d}-{arrival_ms}{_SUFFIX}"


def record(path: str, mountpoint: str, seq: int, arrival_ms: int, data: bytes) -> None:
    """Write a chunk; it appears whole, as it is renamed when it is written."""
    _put(f"{path}/{mountpoint}/{chunk_name(seq, arrival_ms)}", data)


def _put(path: str, data: bytes) -> None:
    files, name, _ = filesystem(path)
    files.create_dir(name.rsplit("/", 1)[0])
    part = f"{name}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part, compression=None) as out:
        out.write(data)
    files.move(part, name)


def _listed(path: str) -> dict[str, dict[int, tuple[int, str]]]:
    """Per mountpoint the arrival and file of each number."""
    files, root, before = filesystem(path)
    out: dict[str, dict[int, tuple[int, str]]] = {}
    for x in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if x.type == fs.FileType.File and x.base_name.endswith(_SUFFIX):
            number, arrival = x.base_name.removesuffix(_SUFFIX).split("-", 1)
            out.setdefault(x.path.split("/")[-2], {})[int(number)] = (int(arrival), before + x.path)
    return out


@dataclass
class Chunks(InputPartition):
    mountpoint: str
    files: tuple[tuple[int, int, str], ...]


def _tasks(found: dict[str, dict[int, tuple[int, str]]], start: dict | None, end: dict | None) -> list[Chunks]:
    out = []
    for mountpoint, numbers in sorted(found.items()):
        low, high = (start or {}).get(mountpoint, 0), (end or {}).get(mountpoint, 0) if end is not None else max(numbers) + 1
        rows = [(n, *numbers[n]) for n in sorted(numbers) if low <= n < high]
        out += [Chunks(mountpoint, tuple(rows[k : k + TASK_CHUNKS])) for k in range(0, len(rows), TASK_CHUNKS)]
    return out


def _read(part: Chunks) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for number, arrival, path in part.files:
        files, name, _ = filesystem(path)
        with files.open_input_stream(name, compression=None) as src:
            data = src.read()
        rows.append((part.mountpoint, number, arrival * 1000, data))
        size += len(data)
        if size > _HELD:
            yield _batch(rows)
            rows, size = [], 0
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class ChunkReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return _tasks(_listed(self.path), None, None)

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        return _read(partition) if partition else iter([])


class ChunkStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int | None, progress: str | None, clean: bool) -> None:
        if most is not None and not progress:
            raise ValueError("a limit of chunks needs a file for the progress")
        self.path, self.most, self.progress, self.clean = path, most, progress, clean
        self.known: dict[str, int] = {}
        if progress:
            files, name, _ = filesystem(progress)
            if files.get_file_info(name).type == fs.FileType.File:
                with files.open_input_stream(name, compression=None) as src:
                    self.known = json.loads(src.read())

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        end = dict(self.known)
        for mountpoint, numbers in _listed(self.path).items():
            first = end.get(mountpoint, min(numbers))
            n = first
            while n in numbers and (self.most is None or n - first < self.most):
                n += 1
            if n > first or mountpoint in end:
                end[mountpoint] = n
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end != self.known:
            self.known = dict(end)
            if self.progress:
                _put(self.progress, json.dumps(end).encode())
        return _tasks(_listed(self.path), start, end) if start != end else []

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        return _read(partition) if partition else iter([])

    def commit(self, end: dict) -> None:
        """With `clean`, chunks of batches that are done are removed."""
        if self.clean:
            for mountpoint, numbers in _listed(self.path).items():
                for n, (_, path) in numbers.items():
                    if n < end.get(mountpoint, 0):
                        files, name, _ = filesystem(path)
                        files.delete_file(name)


class ChunkSource(DataSource):
    """spark.read or spark.readStream.format("recorded_chunks") with the options path, maxchunks, progress and clean."""

    @classmethod
    def name(cls) -> str:
        return "recorded_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        most = self.options.get("maxchunks")
        return ChunkStreamReader(self.options["path"], int(most) if most else None, self.options.get("progress"), self.options.get("clean", "false") == "true")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """mountpoint, seq, arrival and data of all chunks there are."""
    spark.dataSource.register(ChunkSource)
    return spark.read.format("recorded_chunks").option("path", path).load()


def stream_chunks(spark: SparkSession, path: str, max_chunks: int | None = None, progress: str | None = None, clean: bool = False) -> DataFrame:
    """The chunks as a stream, for streaming.live.framed. A limit of chunks of a mountpoint per batch needs a progress file of the query's own."""
    spark.dataSource.register(ChunkSource)
    reader = spark.readStream.format("recorded_chunks").option("path", path).option("clean", str(clean).lower())
    if progress:
        reader = reader.option("progress", progress)
    if max_chunks:
        reader = reader.option("maxchunks", max_chunks)
    return reader.load()
