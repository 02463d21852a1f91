"""Navigation files of versions 2 to 4 as one table of tagged records, read by ranges of bytes as streams of lines.

A record begins with a line that is known by itself: ">" in version 4, a satellite and a date in older ones. So a file that isn't
compressed is cut into ranges, each of which begins at its first record and ends where the next range's begins. The header's
ionospheric and time terms are records too, of the kind HEAD.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from almanax.sources.fields import millis_of, number_of
from almanax.sources.files import FileRange, file_ranges, range_options

#: Names of a legacy record's numbers, in order; fixed values of the format, as are those of the newer records below.
KEPLER = ("af0", "af1", "af2", "iode", "crs", "deltaN", "m0", "cuc", "e", "cus", "sqrtA", "toe", "cic", "omega0", "cis", "i0", "crc", "omega", "omegaDot", "idot", "codes", "week", "l2p", "accuracy", "svHealth", "tgd", "iodc", "sent", "fit")
STATE = ("tauN", "gammaN", "frame", "x", "vx", "ax", "health", "y", "vy", "ay", "freq", "z", "vz", "az", "age")
LEGACY = ("LNAV", "FDMA", "INAV", "FNAV", "IFNV", "D1", "D2", "D1D2", "SBAS")
_MODERN = ("af0", "af1", "af2", "aDot", "crs", "deltaN", "m0", "cuc", "e", "cus", "sqrtA", "toe", "cic", "omega0", "cis", "i0", "crc", "omega", "omegaDot", "idot", "deltaNDot")
_CNAV = (*_MODERN, "uraNed0", "uraNed1", "uraEd", "svHealth", "tgd", "uraNed2", "iscL1CA", "iscL2C", "iscL5I5", "iscL5Q5")
_BDS = (*_MODERN, "satType", "top", "sisaiOe", "sisaiOcb", "sisaiOc1", "sisaiOc2")
MODERN = {
    ("G", "CNAV"): (*_CNAV, "sent", "wnOp"),
    ("J", "CNAV"): (*_CNAV, "sent", "wnOp"),
    ("G", "CNV2"): (*_CNAV, "iscL1Cd", "iscL1Cp", "", "", "sent", "wnOp"),
    ("J", "CNV2"): (*_CNAV, "iscL1Cd", "iscL1Cp", "", "", "sent", "wnOp"),
    ("C", "CNV1"): (*_BDS, "iscB1Cd", "", "tgdB1Cp", "tgdB2ap", "sismai", "svHealth", "integrity", "iodc", "sent", "", "", "iode"),
    ("C", "CNV2"): (*_BDS, "", "iscB2ad", "tgdB1Cp", "tgdB2ap", "sismai", "svHealth", "integrity", "iodc", "sent", "", "", "iode"),
    ("C", "CNV3"): (*_BDS, "sismai", "svHealth", "integrity", "tgdB2bI", "sent"),
}
#: Of the other kinds: an offset of two time scales, the earth's orientation, and an ionosphere by its model.
OFFSET = ("sent", "a0", "a1", "a2")
ORIENTATION = ("xp", "xpDot", "xpDotDot", "", "yp", "ypDot", "ypDotDot", "sent", "dut1", "dut1Dot", "dut1DotDot")
KLOBUCHAR = ("alpha0", "alpha1", "alpha2", "alpha3", "beta0", "beta1", "beta2", "beta3", "region")
NEQUICK = ("ai0", "ai1", "ai2", "flags")
BDGIM = tuple(f"alpha{k}" for k in range(1, 10))

SCHEMA = "file string, ord long, kind string, prn string, message string, label string, t_ms long, numbers array<double>"
_ARROW = pa.schema([("file", pa.string()), ("ord", pa.int64()), *[(c, pa.string()) for c in ("kind", "prn", "message", "label")], ("t_ms", pa.int64()), ("numbers", pa.list_(pa.float64()))])
_BEGINS = {2: re.compile(r"[ \d]\d [ \d]\d [ \d]\d [ \d]\d [ \d]\d"), 3: re.compile(r"[A-Z][ \d]\d \d{4} [ \d]\d [ \d]\d")}
#: Labels of the header's terms.
_TERMS = ("ION ALPHA", "ION BETA", "IONOSPHERIC CORR", "TIME SYSTEM CORR", "DELTA-UTC: A0,A1,T,W", "CORR TO SYSTEM TIME", "LEAP SECONDS")


class NotNavigation(ValueError):
    """No valid header."""


def begins_record(line: str, version: int) -> bool:
    return line.startswith(">") if version >= 4 else bool(_BEGINS[3 if version >= 3 else 2].match(line))


def _cells(line: str, first: int, n: int) -> list[float | None]:
    line = line.replace("D", "E").replace("d", "e")
    return [number_of(line[at : at + 19]) for at in range(first, first + 19 * n, 19)]


def _head_rows(head: list[tuple[int, str]]) -> Iterator[tuple]:
    """The terms of a header: label and numbers, in order."""
    for place, line in head:
        label = line[60:80].strip()
        if label in ("ION ALPHA", "ION BETA"):
            yield place, "HEAD", None, None, label, None, [number_of(line[2 + 12 * k : 14 + 12 * k].replace("D", "E")) for k in range(4)]
        elif label == "IONOSPHERIC CORR":
            yield place, "HEAD", None, None, line[:4].strip(), None, [number_of(line[5 + 12 * k : 17 + 12 * k].replace("D", "E")) for k in range(4)]
        elif label == "TIME SYSTEM CORR":
            yield place, "HEAD", None, None, line[:4].strip(), None, [number_of(line[a:b].replace("D", "E")) for a, b in ((5, 22), (22, 38), (38, 45), (45, 50))]
        elif label == "LEAP SECONDS":
            yield place, "HEAD", None, None, label, None, [number_of(line[:6])]


def _record(place: int, mark: str | None, lines: list[str], version: int, letter: str) -> tuple | None:
    """Place, kind, satellite, message, label, time and numbers of a record's lines; null for one without lines."""
    if not lines:
        return None
    kind, message, prn, label, first = "EPH", None, None, None, lines[0]
    if mark is not None:
        kind, message = mark[2:5].strip(), mark[10:14].strip() or None
        prn = mark[6:9].rstrip().replace(" ", "0") or None
    if version < 3:
        prn = letter + first[:2].strip().rjust(2, "0")
        t = millis_of(*_century(first[3:5]), first[6:8], first[9:11], first[12:14], first[15:17], first[17:22])
        return place, kind, prn, message, label, t, _cells(first, 22, 3) + [x for line in lines[1:] for x in _cells(line, 3, 4)]
    if kind == "EPH":
        prn = first[:3].replace(" ", "0")
    t = millis_of(first[4:8], first[9:11], first[12:14], first[15:17], first[18:20], first[21:23])
    rest = [x for line in lines[1:] for x in _cells(line, 4, 4)]
    if kind == "STO":
        return place, kind, prn, message, first[24:42].strip() or None, t, rest
    return place, kind, prn, message, label, t, _cells(first, 23, 3) + rest


def _century(yy: str) -> tuple[str, ...]:
    return (str(int(yy) + (1900 if int(yy) >= 80 else 2000)) if yy.strip().isdigit() else "",)


def navigation_rows(numbered: Iterator[tuple[int, str]], head: list[tuple[int, str]], stop: int | None = None, with_head: bool = True) -> Iterator[tuple]:
    """Records that begin before byte stop, of lines behind the header `head`; lines ahead of the first record are skipped."""
    first = head[0][1] if head else ""
    if "RINEX VERSION" not in first[60:] or number_of(first[:9]) is None:
        raise NotNavigation("No valid RINEX header")
    version, letter = int(number_of(first[:9])), {"G": "R", "H": "S"}.get(first[20:21], "G")
    if with_head:
        yield from _head_rows(head)
    at, mark, lines = None, None, []
    for place, line in numbered:
        if begins_record(line, version):
            if at is not None and (row := _record(at, mark, lines, version, letter)):
                yield row
            at = None
            if stop is not None and place >= stop:
                return
            at, mark, lines = place, line if version >= 4 else None, [] if version >= 4 else [line]
        elif at is not None and line.strip():
            lines.append(line)
    if at is not None and (row := _record(at, mark, lines, version, letter)):
        yield row


def range_rows(part: FileRange) -> Iterator[tuple]:
    """The records of a range of a file's bytes."""
    whole = part.stop is None
    numbered = enumerate(part.lines()) if whole else part.lines_from(0)
    head = []
    for place, line in numbered:
        head.append((place, line))
        if "END OF HEADER" in line[60:] or len(head) > 1000:
            break
    if whole:
        yield from navigation_rows(numbered, head)
    else:
        end = head[-1][0] if head else 0
        yield from navigation_rows((x for x in part.lines_from(part.start) if x[0] > end), head, part.stop, part.start == 0)


def _batches(file: str, rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append((file, *row))
        if len(held) == size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class NavigationReader(DataSourceReader):
    def __init__(self, paths: list[str], split: dict[str, int]) -> None:
        self.paths, self.split = paths, split

    def partitions(self) -> list[InputPartition]:
        return file_ranges(self.paths, **self.split)

    def read(self, partition: FileRange | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _batches(partition.name, range_rows(partition))


class NavigationSource(DataSource):
    """spark.read.format("station_navigation") with the option files, a JSON list; most, least and parallelism size the ranges."""

    @classmethod
    def name(cls) -> str:
        return "station_navigation"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NavigationReader(json.loads(self.options["files"]), {"most": 128 << 20} | {k: int(self.options[k]) for k in ("most", "least", "parallelism") if k in self.options})


def read_navigation(spark: SparkSession, paths: str | list[str], range_bytes: int | None = None) -> DataFrame:
    """file, ord (place in the file), kind, prn, message, label, t_ms and numbers of every record of files, folders, exports or patterns."""
    spark.dataSource.register(NavigationSource)
    names = json.dumps([paths] if isinstance(paths, str) else paths)
    return spark.read.format("station_navigation").option("files", names).options(**range_options(spark, range_bytes)).load()


def navigation(texts: DataFrame) -> DataFrame:
    """The same of texts (file, text); a text without a header has no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                numbered = enumerate((text or "").split("\n"))
                head = []
                for place, line in numbered:
                    head.append((place, line))
                    if "END OF HEADER" in line[60:]:
                        break
                with suppress(NotNavigation):
                    yield from _batches(file, navigation_rows(numbered, head))

    return texts.select("file", "text").mapInArrow(run, SCHEMA)


def ephemerides_of(records: DataFrame) -> DataFrame:
    """file, prn, sys, toc_ms, ord, healthy, kepler and state of the ephemerides that have the layout of the older versions."""
    named = lambda names: F.struct(*[F.get("numbers", F.lit(i)).alias(n) for i, n in enumerate(names)])
    old = records.where((F.col("kind") == "EPH") & (F.col("message").isNull() | F.col("message").isin(*LEGACY)))
    sys = F.substring("prn", 1, 1)
    by_state = sys.isin("R", "S")
    out = old.select("file", "prn", sys.alias("sys"), F.col("t_ms").alias("toc_ms"), "ord", F.when(~by_state, named(KEPLER)).alias("kepler"), F.when(by_state, named(STATE)).alias("state"))
    return out.withColumn("healthy", F.coalesce(F.col("state.health"), F.col("kepler.svHealth")) == 0).select("file", "prn", "sys", "toc_ms", "ord", "healthy", "kepler", "state")


def named_numbers(records: DataFrame) -> DataFrame:
    """records with fields, a map from names to numbers, by kind, system and message; names without a number are left out."""

    def mapped(names: tuple[str, ...]) -> Column:
        pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.get("numbers", F.lit(i)).alias("v")) for i, n in enumerate(names) if n])
        return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))

    sys, kind, message = F.substring("prn", 1, 1), F.col("kind"), F.col("message")
    ion = F.when(sys == "E", mapped(NEQUICK)).when((sys == "C") & message.isin("CNVX", "CNV1", "CNV2", "CNV3"), mapped(BDGIM)).otherwise(mapped(KLOBUCHAR))
    fields = F.when(kind == "STO", mapped(OFFSET)).when(kind == "EOP", mapped(ORIENTATION)).when(kind == "ION", ion)
    for (s, m), names in MODERN.items():
        fields = fields.when((kind == "EPH") & (sys == s) & (message == m), mapped(names))
    fields = fields.when((kind == "EPH") & sys.isin("R", "S"), mapped(STATE)).when(kind == "EPH", mapped(KEPLER))
    return records.withColumn("fields", fields)


def merged_terms(records: DataFrame, files: list[str] | None = None) -> DataFrame:
    """label and numbers of the header's terms of several files: of each label the first that is known, by the order of files, else by name."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in files]), F.col("file")), F.lit(0)) if files else F.lit(0)
    terms = records.where("kind = 'HEAD'").where(F.exists("numbers", lambda x: x.isNotNull()))
    return terms.groupBy("label").agg(F.min_by("numbers", F.struct(place.alias("p"), F.col("file"), F.col("ord"))).alias("numbers"))
