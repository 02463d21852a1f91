"""Text files as streams of lines.

A logical file is a file, or the part files of an export, which follow one another by name. Nothing but the lines at hand is
held, so files may be larger than memory; .gz files are inflated as they are read. A file that isn't compressed can be read by
ranges of its bytes, and an export by .gz by ranges of its parts, each a partition.
"""

from __future__ import annotations

import fnmatch
import gzip
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_CHUNK = 1 << 20
#: Of compressed parts a place is the part's number and the place in its inflated bytes, of so many bits; and by how much they are taken to grow.
_PART_BITS, _INFLATED = 40, 8
LINES = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("line", pa.string()), ("head", pa.bool_())])


def filesystem(path: str) -> tuple[fs.FileSystem, str, str]:
    """A path's file system, its name there, and what to put before a name to get a path again."""
    if "://" in path and not path.startswith("file:"):
        files, name = fs.FileSystem.from_uri(path)
        return files, name, path[: len(path) - len(name)] if path.endswith(name) else ""
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path, ""


@dataclass
class LogicalFile(InputPartition):
    name: str
    parts: tuple[str, ...]

    def lines(self) -> Iterator[str]:
        rest = b""
        for data in (data for part in self.parts for data in _inflated(part)):
            *whole, rest = (rest + data).split(b"\n")
            yield from (x.rstrip(b"\r").decode("utf-8", "replace") for x in whole)
        if rest:
            yield rest.rstrip(b"\r").decode("utf-8", "replace")


def _inflated(part: str) -> Iterator[bytes]:
    files, name, _ = filesystem(part)
    with files.open_input_stream(name, compression=None) as raw:
        stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
        while data := stream.read(_CHUNK):
            yield data


@dataclass
class FileRange(LogicalFile):
    """The places [start, stop) of a logical file whose parts have the given sizes; no bounds at all for a compressed one in one range.

    Places are bytes; if parts are compressed, those of _PART_BITS.
    """

    sizes: tuple[int, ...] = ()
    start: int = 0
    stop: int | None = None

    def lines_from(self, start: int) -> Iterator[tuple[int, str]]:
        """Place and text of each line that begins at place start or later, to the end of the file."""
        if any(p.endswith(".gz") for p in self.parts):
            yield from self._lines_from_part(start >> _PART_BITS)
            return
        at = max(start - 1, 0)  # of the line that holds the byte before, the rest is skipped
        skip, rest, begin = start > 0, b"", at
        for part, size in zip(self.parts, self.sizes, strict=True):
            if at >= size:
                at -= size
                continue
            files, name, _ = filesystem(part)
            with files.open_input_file(name) as raw:
                raw.seek(at)
                at = 0
                while data := raw.read(_CHUNK):
                    *whole, rest = (rest + data).split(b"\n")
                    for x in whole:
                        if not skip:
                            yield begin, x.rstrip(b"\r").decode("utf-8", "replace")
                        skip = False
                        begin += len(x) + 1
        if rest and not skip:
            yield begin, rest.rstrip(b"\r").decode("utf-8", "replace")


    def _lines_from_part(self, first: int) -> Iterator[tuple[int, str]]:
        """lines_from the beginning of a part. If the one before ends within a line, the line's rest is skipped."""
        last = b"\n"
        for part in reversed(self.parts[:first]):
            last = b""
            for data in _inflated(part):
                last = data[-1:]
            if last:
                break
        skip, rest, begin = last not in (b"\n", b""), b"", 0
        for k in range(first, len(self.parts)):
            at = k << _PART_BITS
            begin = begin if rest or skip else at
            for data in _inflated(self.parts[k]):
                *whole, tail = data.split(b"\n")
                for x in whole:
                    if not skip:
                        yield begin, (rest + x).rstrip(b"\r").decode("utf-8", "replace")
                    skip, rest = False, b""
                    at += len(x) + 1
                    begin = at
                rest += tail
                at += len(tail)
        if rest and not skip:
            yield begin, rest.rstrip(b"\r").decode("utf-8", "replace")


def file_ranges(paths: str | list[str], most: int, least: int = 1 << 18, parallelism: int = 1) -> list[FileRange]:
    """Ranges of the files of paths of at most so many bytes, and of fewer if that keeps all executors busy."""
    found = []
    for f in logical_files(paths):
        sizes = []
        for part in f.parts:
            files, name, _ = filesystem(part)
            sizes.append(files.get_file_info(name).size or 0)
        found.append((f, tuple(sizes)))
    weight = lambda f, sizes: [n * _INFLATED if p.endswith(".gz") else n for p, n in zip(f.parts, sizes, strict=True)]
    size = max(1, min(most, max(least, -(-sum(sum(weight(*x)) for x in found) // max(parallelism, 1)))))
    out = []
    for f, sizes in found:
        total = sum(weight(f, sizes))
        if total <= size:
            out.append(FileRange(f.name, f.parts, sizes))
        elif any(p.endswith(".gz") for p in f.parts):
            firsts, held = [0], 0
            for k, n in enumerate(weight(f, sizes)):
                if held and held + n > size:
                    firsts.append(k)
                    held = 0
                held += n
            bounds = [k << _PART_BITS for k in (*firsts, len(f.parts))]
            out += [FileRange(f.name, f.parts, sizes, a, b) for a, b in pairwise(bounds)] if len(firsts) > 1 else [FileRange(f.name, f.parts, sizes)]
        else:
            n = -(-total // size)
            out += [FileRange(f.name, f.parts, sizes, total * k // n, total * (k + 1) // n) for k in range(n)]
    return out


def range_options(spark: SparkSession, range_bytes: int | None = None) -> dict[str, int]:
    """Sizes of ranges: at most range_bytes (spark.sql.files.maxPartitionBytes), fewer if that keeps all cores busy."""
    number, unit = re.fullmatch(r"(\d+) *([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").strip().lower()).groups()
    most = range_bytes or int(number) << 10 * " kmgtp".index(unit or " ")
    return {"most": most, "least": min(most, 1 << 18), "parallelism": spark.sparkContext.defaultParallelism}


def logical_files(paths: str | list[str]) -> list[LogicalFile]:
    """The files of paths, which may be files, folders, exports (folders of part files) or patterns."""
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        files, name, before = filesystem(path)
        if any(c in name for c in "*?["):
            base = posixpath.dirname(name[: min(name.index(c) for c in "*?[" if c in name)])
            found = [x.path for x in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and fnmatch.fnmatch(x.path, name)]
            out += [LogicalFile(before + p, (before + p,)) for p in sorted(found)]
        elif files.get_file_info(name).type == fs.FileType.Directory:
            shown = [x for x in files.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
            parts = tuple(before + p for p in sorted(x.path for x in shown))
            out += [LogicalFile(path, parts)] if shown and all(x.base_name.startswith("part-") for x in shown) else [LogicalFile(p, (p,)) for p in parts]
        else:
            out.append(LogicalFile(path, (path,)))
    return out


class LineReader(DataSourceReader):
    def __init__(self, paths: list[str], header_only: bool) -> None:
        self.paths, self.header_only = paths, header_only

    def partitions(self) -> list[InputPartition]:
        return logical_files(self.paths)

    def read(self, partition: LogicalFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        held: list[tuple[int, str, bool]] = []
        head = True
        for pos, line in enumerate(partition.lines()):
            held.append((pos, line, head))
            if len(held) == 20_000:
                yield _batch(partition.name, held)
                held = []
            if "END OF HEADER" in line[60:]:
                head = False
                if self.header_only:
                    break
        yield _batch(partition.name, held)


def _batch(name: str, rows: list[tuple[int, str, bool]]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *[pa.array(c, f.type) for c, f in zip(columns, list(LINES)[1:], strict=True)]], schema=LINES)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "station_lines"

    def schema(self) -> str:
        return "file string, pos long, line string, head boolean"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(json.loads(self.options["files"]), self.options.get("headeronly", "false") == "true")


def read_lines(spark: SparkSession, paths: str | list[str], header_only: bool = False) -> DataFrame:
    """file, pos, line and head of every line: head up to the end of a station file's header. header_only: those lines alone."""
    spark.dataSource.register(LineSource)
    names = json.dumps([paths] if isinstance(paths, str) else paths)
    return spark.read.format("station_lines").option("files", names).option("headeronly", str(header_only).lower()).load()
