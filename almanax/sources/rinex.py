"""Station observation and navigation files (versions 2 to 4, plain or difference-compressed) as DataFrames.

Observation files are a Python data source: a range of a file's bytes is a partition and is read as a stream of lines; filters on
satellites, systems, codes and times are pushed down and drop rows before they are made. Each range reads the header, and begins at
the first epoch line in it: one with ">" in version 3 and 4; of version 2, whose lines carry no marks, one with an epoch's fixed
columns. It ends where the next range begins. Compressed files (.gz, or by differences, which add up) are one partition each.
Headers, which are small, are lines that aggregates put together; navigation records have a source of their own (navigation.py).
"""

from __future__ import annotations

import json
import math
import re
from collections import deque
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.window import Window as W

from almanax.sources.fields import millis_of, number_of
from almanax.sources.files import FileRange, file_ranges, range_options, read_lines
from almanax.sources.navigation import ephemerides_of, navigation, read_navigation


class NotRinex(ValueError):
    """No valid RINEX header."""


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file and text of each file; .gz files are inflated by their suffix."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("text"))


def expand_lines(lines: Iterator[str]) -> Iterator[str]:
    """Lines of a difference-compressed observation file as those of a plain one; lines of other files pass.

    Values are integers in thousandths: "k&v" starts a difference of order k at v, a number adds to it, nothing means no value.
    Epoch lines (and flags) are differences of text: a blank keeps the character above, & turns it into a blank.
    """
    first = next(lines, None)
    if first is None:
        return
    if "COMPACT RINEX" not in first[:80]:
        yield first
        yield from lines
        return
    third, counts = not first.lstrip().startswith("1"), {}
    for line in lines:
        label = line[60:].strip()
        if label.startswith("CRINEX PROG"):
            continue
        yield line
        if label == "SYS / # / OBS TYPES" and line[:1].strip():
            counts[line[0]] = int(line[3:6])
        elif label == "# / TYPES OF OBSERV" and line[:6].strip():
            counts[""] = int(line[:6])
        elif label == "END OF HEADER":
            break
    epoch, state, flags = "", {}, {}
    for line in lines:
        if not line.strip():
            continue
        if line.startswith(">" if third else "&"):
            epoch, state, flags = line if third else " " + line[1:], {}, {}
        else:
            epoch = _patched(epoch, line)
        flag, n = (epoch[31:32], epoch[32:35]) if third else (epoch[28:29], epoch[29:32])
        count = int(n) if n.strip() else 0
        if flag.strip() not in ("", "0", "1"):
            yield epoch.rstrip()
            yield from islice(lines, count)
            continue
        names = epoch[41:] if third else epoch[32:]
        prns = [names[3 * k : 3 * k + 3].replace(" ", "0") for k in range(count)]
        next(lines, "")  # clock offset
        if third:
            yield epoch[:35].rstrip()
        else:
            yield epoch[:32] + "".join(prns[:12])
            yield from (" " * 32 + "".join(prns[k : k + 12]) for k in range(12, count, 12))
        for prn in prns:
            m = counts.get(prn[0], 0) if third else counts.get("", 0)
            parts = next(lines, "").split(" ", m)
            values = _values(state, prn, (parts + [""] * m)[:m])
            mark = _patched(flags.get(prn, ""), parts[m] if len(parts) > m else "")
            flags[prn] = mark
            cells = [(f"{v / 1000:14.3f}" if v is not None else " " * 14) + mark[2 * k : 2 * k + 2].ljust(2) for k, v in enumerate(values)]
            if third:
                yield (prn + "".join(cells)).rstrip()
            else:
                yield from ("".join(cells[k : k + 5]).rstrip() for k in range(0, max(m, 1), 5))
        for gone in set(state) - set(prns):
            del state[gone]
        flags = {k: v for k, v in flags.items() if k in prns}


def expand(text: str) -> str:
    """A difference-compressed observation file as a plain one."""
    return "\n".join(expand_lines(iter(text.split("\n")))) + "\n" if "COMPACT RINEX" in text[:80] else text


def _patched(old: str, new: str) -> str:
    wide = old.ljust(len(new))
    return "".join(" " if c == "&" else (wide[k] if c == " " else c) for k, c in enumerate(new)) + wide[len(new) :]


def _values(state: dict, prn: str, tokens: list[str]) -> list[int | None]:
    rows = state.setdefault(prn, {})
    out: list[int | None] = []
    for k, token in enumerate(tokens):
        if not token.strip():
            rows.pop(k, None)
            out.append(None)
        elif "&" in token:
            order, value = token.split("&")
            rows[k] = (int(order), [int(value)])
            out.append(int(value))
        elif k in rows:
            order, d = rows[k]
            if len(d) <= order:
                d.append(int(token))  # one difference more, until the order is reached
            else:
                d[-1] = int(token)
            for j in range(len(d) - 2, -1, -1):
                d[j] += d[j + 1]
            out.append(d[0])
        else:
            out.append(None)
    return out


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([expand(t) if t and "COMPACT RINEX" in t[:80] else t for t in batch.column(1).to_pylist()], pa.string())], names=["file", "text"])


def plain_texts(texts: DataFrame) -> DataFrame:
    """file and text with difference-compressed files expanded."""
    return texts.select("file", "text").mapInArrow(_expanded, "file string, text string")


def text_lines(texts: DataFrame) -> DataFrame:
    """file, pos, line and head (whether it belongs to the header) of every line of texts (file, text)."""
    end = F.size(F.split(F.substring_index("text", "END OF HEADER", 1), "\n")) - 1
    every = texts.select("file", F.when(F.instr("text", "END OF HEADER") > 0, end).alias("end"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return every.select("file", "pos", "line", (F.col("pos") <= F.col("end")).alias("head"))


def _cut(line: Column, start: int, size: int) -> Column:
    return F.trim(F.substring(line, start, size))


def headers(texts: DataFrame) -> DataFrame:
    """One row per file with the header's fields; obs_types is a map from system (or _v2) to codes."""
    return headers_of(text_lines(texts))


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The headers of files, of which no more is read."""
    return headers_of(read_lines(spark, paths, header_only=True))


def headers_of(lines: DataFrame) -> DataFrame:
    h = lines.where("head").withColumn("label", F.trim(F.substring("line", 61, 20)))
    pick = lambda label, c: F.min_by(c, F.when(F.col("label") == label, F.col("pos")))
    number = lambda c: c.try_cast("double")
    triple = F.transform(F.array(*[F.substring("line", k, 14) for k in (1, 15, 29)]), lambda x: F.trim(x).try_cast("double"))
    line = F.col("line")
    out = h.groupBy("file").agg(
        pick("RINEX VERSION / TYPE", number(_cut(line, 1, 9))).alias("version"), pick("RINEX VERSION / TYPE", F.substring("line", 21, 1)).alias("type"), pick("RINEX VERSION / TYPE", F.substring("line", 41, 1)).alias("system"),
        pick("MARKER NAME", _cut(line, 1, 60)).alias("marker_name"), pick("OBSERVER / AGENCY", _cut(line, 1, 20)).alias("observer"), pick("OBSERVER / AGENCY", _cut(line, 21, 40)).alias("agency"),
        pick("REC # / TYPE / VERS", _cut(line, 1, 20)).alias("receiver_number"), pick("REC # / TYPE / VERS", _cut(line, 21, 20)).alias("receiver_type"), pick("REC # / TYPE / VERS", _cut(line, 41, 20)).alias("receiver_version"),
        pick("ANT # / TYPE", _cut(line, 1, 20)).alias("antenna_number"), pick("ANT # / TYPE", _cut(line, 21, 20)).alias("antenna_type"), pick("APPROX POSITION XYZ", triple).alias("approx_position"),
        pick("ANTENNA: DELTA H/E/N", triple).alias("antenna_delta"), pick("INTERVAL", number(_cut(line, 1, 10))).alias("interval"), pick("LEAP SECONDS", _cut(line, 1, 6).try_cast("int")).alias("leap_seconds"),
    )
    types = _obs_types(h).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("sys", "codes"))).alias("obs_types"))
    return out.join(types, "file", "left")


def _obs_types(h: DataFrame) -> DataFrame:
    """file, sys and codes in the header's order; continuation lines have no system."""
    w = W.partitionBy("file").orderBy("pos")
    new = h.where("label = 'SYS / # / OBS TYPES'").withColumn("sys", F.last(F.when(F.substring("line", 1, 1) != " ", F.substring("line", 1, 1)), True).over(w)).withColumn("codes", F.filter(F.split(F.substring("line", 7, 54), " +"), lambda c: c != ""))
    old = h.where("label = '# / TYPES OF OBSERV'").withColumn("sys", F.lit("_v2")).withColumn("codes", F.filter(F.split(F.substring("line", 7, 54), " +"), lambda c: c != ""))
    rows = new.unionByName(old)
    return rows.groupBy("file", "sys").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "codes"))), lambda x: x["codes"])).alias("codes"))


_OBS = pa.schema([("file", pa.string()), ("t_ms", pa.int64()), ("sys", pa.string()), ("prn", pa.string()), ("code", pa.string()), ("value", pa.float64())])
_OBS_SCHEMA = "file string, t_ms long, sys string, prn string, code string, value double"
_SATELLITE = re.compile(r"[A-Z][ 0-9]{2}")


@dataclass
class Wanted:
    """Which rows a read is asked for: allowed values by column, and bounds of t_ms, both included."""

    values: dict[str, frozenset] = field(default_factory=dict)
    first: float = -math.inf
    last: float = math.inf

    def add(self, f: Filter) -> bool:
        """Take a pushed filter; False if it is none of ours."""
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if name in ("sys", "prn", "code") and isinstance(f, (EqualTo, In)):
            some = frozenset(f.value if isinstance(f, In) else [f.value])
            self.values[name] = self.values.get(name, some) & some
        elif name == "t_ms" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.first = max(self.first, f.value + isinstance(f, GreaterThan))
        elif name == "t_ms" and isinstance(f, (LessThan, LessThanOrEqual)):
            self.last = min(self.last, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def time(self, t: int | None) -> bool:
        return self.first <= t <= self.last if t is not None else self.first == -math.inf and self.last == math.inf

    def satellite(self, prn: str) -> bool:
        return ("prn" not in self.values or prn in self.values["prn"]) and ("sys" not in self.values or prn[0] in self.values["sys"])

    def codes(self, codes: list[str]) -> list[tuple[int, str]]:
        """Place and name of the wanted codes."""
        return [(i, c) for i, c in enumerate(codes) if "code" not in self.values or c in self.values["code"]]


def _header_codes(lines: Iterator[str]) -> dict[str, list[str]]:
    """Codes by system, of version 2 under ""; the lines of the header are taken off."""
    codes: dict[str, list[str]] = {}
    sys = ""
    for line in lines:
        label = line[60:80].strip()
        if label == "SYS / # / OBS TYPES":
            sys = line[0] if line[0] != " " else sys
            codes.setdefault(sys, []).extend(line[6:60].split())
        elif label == "# / TYPES OF OBSERV":
            codes.setdefault("", []).extend(line[6:60].split())
        elif "END OF HEADER" in line[60:]:
            return codes
    raise NotRinex("No valid RINEX header")


#: An epoch line of version 2 by its columns: date and time, flag, number of satellites, and their names up to the clock's offset.
_EPOCH_2 = re.compile(r" [ \d]\d(?: [ \d]\d){4}[ \d]{2}\d\.\d{7}  ([01 ])([ \d]{2}\d)((?:[ A-Z][ \d]\d)*) *(?:-?\d*\.\d*)? *$")


def begins_epoch(line: str, third: bool) -> bool:
    """Whether a range may begin at a line; all that yields rows begins at such a line."""
    if third:
        return line.startswith(">")
    m = _EPOCH_2.match(line)
    return m is not None and len(m[3]) == 3 * min(int(m[2]), 12)


def _in_range(numbered: Iterator[tuple[int, str]], stop: int, third: bool) -> Iterator[str]:
    """From the first epoch line on, lines up to the first epoch line at byte stop or later."""
    begun = False
    for place, line in numbered:
        if begins_epoch(line, third):
            if place >= stop:
                return
            begun = True
        if begun:
            yield line


def range_rows(part: FileRange, wanted: Wanted | None = None) -> Iterator[tuple[int | None, str, str, float | None]]:
    """observation_rows of a range of a file's bytes."""
    if part.stop is None:
        yield from observation_rows(part.lines(), wanted)
        return
    head, end = [], 0
    for end, line in part.lines_from(0):
        head.append(line)
        if "COMPACT RINEX" in head[0][:80]:
            # by differences: the first range is the whole file
            if part.start == 0:
                yield from observation_rows(part.lines(), wanted)
            return
        if "END OF HEADER" in line[60:]:
            break
    codes, wanted = _header_codes(iter(head)), wanted or Wanted()
    third = "" not in codes
    lines = _in_range(((place, line) for place, line in part.lines_from(part.start) if place > end), part.stop, third)
    if third:
        yield from _third_rows(lines, {s: wanted.codes(c) for s, c in codes.items()}, wanted)
    else:
        yield from _second_rows(lines, codes[""], wanted)


def observation_rows(lines: Iterator[str], wanted: Wanted | None = None) -> Iterator[tuple[int | None, str, str, float | None]]:
    """t_ms, prn, code and value of a file's lines. Epochs with a flag other than 0 are left out."""
    lines, wanted = expand_lines(lines), wanted or Wanted()
    codes = _header_codes(lines)
    return _second_rows(lines, codes[""], wanted) if "" in codes else _third_rows(lines, {s: wanted.codes(c) for s, c in codes.items()}, wanted)


def _third_rows(lines: Iterator[str], codes: dict[str, list[tuple[int, str]]], wanted: Wanted) -> Iterator[tuple[int | None, str, str, float | None]]:
    t, good = None, False
    for line in lines:
        if line.startswith(">"):
            t = millis_of(line[2:6], line[7:9], line[10:12], line[13:15], line[16:18], line[18:29])
            good = line[31:32].strip() in ("", "0") and wanted.time(t)
        elif good and _SATELLITE.match(line):
            prn = line[:3].replace(" ", "0")
            if wanted.satellite(prn):
                yield from ((t, prn, code, number_of(line[3 + 16 * i : 17 + 16 * i])) for i, code in codes.get(prn[0], ()))


def _second_rows(lines: Iterator[str], codes: list[str], wanted: Wanted) -> Iterator[tuple[int | None, str, str, float | None]]:
    """Satellites' lines of version 2 are told apart by counting alone."""
    per, some = max(1, -(-len(codes) // 5)), wanted.codes(codes)
    for line in lines:
        if not line.strip():
            continue
        flag, count = line[28:29].strip() or "0", int(line[29:32])
        if flag not in ("0", "1"):
            deque(islice(lines, count), maxlen=0)
            continue
        names = line[32:68].ljust(36)
        while len(names) < 3 * count:
            names += next(lines, "")[32:68].ljust(36)
        yy = line[1:3].strip()
        t = millis_of(str(int(yy) + (1900 if int(yy) >= 80 else 2000)) if yy.isdigit() else "", line[3:6], line[6:9], line[9:12], line[12:15], line[15:26])
        for k in range(count):
            row = "".join(x.ljust(80) for x in islice(lines, per))
            prn = (names[3 * k].strip() or "G") + names[3 * k + 1 : 3 * k + 3].replace(" ", "0")
            if flag == "0" and wanted.time(t) and wanted.satellite(prn):
                yield from ((t, prn, code, number_of(row[16 * i : 16 * i + 14])) for i, code in some)


def _batches_of(file: str, rows: Iterator[tuple[int | None, str, str, float | None]], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        t, prn, code, value = zip(*held, strict=True)
        columns = [[file] * len(held), t, [p[0] for p in prn], prn, code, value]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OBS, strict=True)], schema=_OBS)


class ObservationReader(DataSourceReader):
    def __init__(self, paths: list[str], permissive: bool, **split: int) -> None:
        self.paths, self.permissive, self.split, self.wanted = paths, permissive, split, Wanted()

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        yield from (f for f in filters if not self.wanted.add(f))

    def partitions(self) -> list[InputPartition]:
        return file_ranges(self.paths, **self.split)

    def read(self, partition: FileRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        try:
            yield from _batches_of(partition.name, range_rows(partition, self.wanted))
        except NotRinex as e:
            if not self.permissive:
                raise NotRinex(f"{e}: {partition.name}") from None


class ObservationSource(DataSource):
    """spark.read.format("station_observations") with the option files, a JSON list; most, least and parallelism size the ranges."""

    @classmethod
    def name(cls) -> str:
        return "station_observations"

    def schema(self) -> str:
        return _OBS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        split = {"most": 128 << 20} | {k: int(self.options[k]) for k in ("most", "least", "parallelism") if k in self.options}
        return ObservationReader(json.loads(self.options["files"]), self.options.get("permissive", "false") == "true", **split)


def observations(texts: DataFrame) -> DataFrame:
    """file, t_ms, sys, prn, code, value of texts (file, text) of any version; a text without a header has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with suppress(NotRinex):
                    yield from _batches_of(file, observation_rows(iter((text or "").split("\n"))))

    return texts.select("file", "text").mapInArrow(run, _OBS_SCHEMA)


def read_observations(spark: SparkSession, paths: str | list[str], permissive: bool = False, range_bytes: int | None = None) -> DataFrame:
    """Observations of files, folders, exports or patterns. A file without a header is an error as it is read, or left out if permissive.

    Files are read by ranges of at most range_bytes (spark.sql.files.maxPartitionBytes), smaller ones if that keeps all cores busy.
    """
    spark.dataSource.register(ObservationSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    names = json.dumps([paths] if isinstance(paths, str) else paths)
    reader = spark.read.format("station_observations").option("files", names).option("permissive", str(permissive).lower())
    rows = reader.options(**range_options(spark, range_bytes)).load()
    # Spark plans a read anew if it has a filter to push, and else takes up the last one's filters; so there is always one
    return rows.where("file is not null")


def ephemerides(texts: DataFrame) -> DataFrame:
    """file, prn, sys, toc_ms, ord, healthy, kepler and state of texts (file, text) of navigation files of versions 2 to 4."""
    return ephemerides_of(navigation(texts))


def read_ephemerides(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """ephemerides of files, read by ranges of bytes."""
    return ephemerides_of(read_navigation(spark, paths))
