"""Text exports of observations, navigation data, tracks and metadata.

Each writer gives a DataFrame with text and the columns that order it (ord first); write_text sorts by them in ranges, so that part
files follow one another and no task holds a whole export.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanax.model import system_rank
from almanax.session import cores
from almanax.sources.navigation import KEPLER, STATE

TYPES_PER_LINE, SLOTS_PER_LINE, OLD_TYPES_PER_LINE, OLD_SATS_PER_LINE, OLD_VALUES_PER_LINE = 13, 8, 9, 12, 5


def old_code(code: Column) -> Column:
    """Version 2 code of a version 3 code, NULL if it has none: precise codes become P1 and P2, all others keep type and band."""
    kind, band, attribute = F.substring(code, 1, 1), F.substring(code, 2, 1), F.substring(code, 3, 1)
    known = band.isin("1", "2") & attribute.isin("C", "S", "L", "X", "W", "P") | (band == "5") & attribute.isin("I", "Q", "X")
    precise = (kind == "C") & ((band == "1") & attribute.isin("W", "P") | (band == "2") & (attribute != "C"))
    return F.when(known & kind.isin("C", "L", "D", "S"), F.when(precise, F.concat(F.lit("P"), band)).otherwise(F.concat(kind, band)))


def header_line(content: Column | str, label: str) -> Column:
    c = F.lit(content) if isinstance(content, str) else content
    return F.concat(F.rpad(c, 60, " "), F.lit(label))


def fixed(value: Column, width: int, digits: int) -> Column:
    """A number right-justified with so many decimals; exact for data that has no more."""
    return F.lpad(value.cast(f"decimal(38,{digits})").cast("string"), width, " ")


def _calendar(ms: Column) -> Column:
    """yyyy mm dd hh mm ss.sssssss in the columns of the first and last epoch."""
    t = F.timestamp_millis(ms)
    part = lambda f, n: F.lpad(f.cast("string"), n, " ")
    second = (F.pmod(ms, F.lit(60_000)) / 1000).cast("decimal(12,7)").cast("string")
    return F.concat(part(F.year(t), 6), part(F.month(t), 6), part(F.day(t), 6), part(F.hour(t), 6), part(F.minute(t), 6), F.lpad(second, 13, " "))


def code_lists(obs: DataFrame, live_order: bool = False) -> DataFrame:
    """sys, place and codes: each system's codes by first use (or band, type, name for recordings)."""
    seen = obs.groupBy("sys", "code").agg(F.min("t_ms").alias("first"))
    order = F.struct(F.substring("code", 2, 1).alias("b"), F.substring("code", 1, 1).alias("k"), "code") if live_order else F.struct("first", "code")
    return seen.groupBy("sys").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["code"]).alias("codes")).withColumn("place", system_rank(F.col("sys")))


def observation_header(obs: DataFrame, version: str = "3.04", header: dict | None = None, slots: dict[int, int] | None = None, live_order: bool = False) -> DataFrame:
    """Header lines as (ord, text). header: marker_name, observer, agency, receiver and antenna fields, approx_position."""
    spark, h = obs.sparkSession, header or {}
    lists = code_lists(obs, live_order)
    sys = lists.agg(F.when(F.count(F.lit(1)) == 1, F.first("sys")).otherwise("M").alias("s"))
    span = obs.agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    fix = lambda values: "".join(f"{v:14.4f}" for v in (values or (0, 0, 0)))
    top = [
        ("", "PGM / RUN BY / DATE"), (h.get("marker_name") or "UNKNOWN", "MARKER NAME"), (f"{h.get('observer', ''):<20}{h.get('agency', ''):<40}", "OBSERVER / AGENCY"),
        (f"{h.get('receiver_number', ''):<20}{h.get('receiver_type', ''):<20}{h.get('receiver_version', ''):<20}", "REC # / TYPE / VERS"), (f"{h.get('antenna_number', ''):<20}{h.get('antenna_type', ''):<20}", "ANT # / TYPE"),
        (fix(h.get("approx_position")), "APPROX POSITION XYZ"), (fix(h.get("antenna_delta")), "ANTENNA: DELTA H/E/N"),
    ]
    fixed_rows = spark.createDataFrame([(i + 1, f"{c:<60.60}{label}") for i, (c, label) in enumerate(top)], "ord long, text string")
    first = sys.select(F.lit(0).cast("long").alias("ord"), header_line(F.concat(F.lit(f"     {version}           OBSERVATION DATA    "), "s"), "RINEX VERSION / TYPE").alias("text"))
    if version.startswith("2"):
        types = _old_types(obs)
    else:
        chunk = F.explode(F.sequence(F.lit(0), F.floor((F.size("codes") - 1) / TYPES_PER_LINE).cast("int")))
        rows = lists.select("sys", "place", "codes", chunk.alias("i"))
        some = F.slice("codes", F.col("i") * TYPES_PER_LINE + 1, F.lit(TYPES_PER_LINE))
        lead = F.when(F.col("i") == 0, F.concat("sys", F.lit("  "), F.lpad(F.size("codes").cast("string"), 3, " "))).otherwise("      ")
        types = rows.select((100 + F.col("place") * 100 + F.col("i")).cast("long").alias("ord"), header_line(F.concat(lead, F.array_join(F.transform(some, lambda c: F.concat(F.lit(" "), F.rpad(c, 3, " "))), "")), "SYS / # / OBS TYPES").alias("text"))
    scale = sys.select(F.when(F.col("s") == "R", "GLO").otherwise("GPS").alias("s"))
    ends = span.crossJoin(scale)  # one row each
    times = ends.select(F.lit(2000).cast("long").alias("ord"), header_line(F.concat(_calendar(F.col("a")), F.lit("     "), "s"), "TIME OF FIRST OBS").alias("text"))
    times = times.unionByName(ends.select(F.lit(2001).cast("long").alias("ord"), header_line(F.concat(_calendar(F.col("b")), F.lit("     "), "s"), "TIME OF LAST OBS").alias("text")))
    two = obs.select("t_ms").distinct().orderBy("t_ms").limit(2).agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b")).withColumn("d", (F.col("b") - F.col("a")) / 1000).where("d > 0 and d < 3600")
    gap = two.select(F.lit(2002).cast("long").alias("ord"), header_line(fixed(F.col("d"), 10, 3), "INTERVAL").alias("text"))
    ordered = sorted((slots or {}).items())
    lines = [("".join([f"{len(ordered):3d} " if i == 0 else "    ", *(f"R{s:02d} {f:2d} " for s, f in ordered[i : i + SLOTS_PER_LINE])]), i) for i in range(0, len(ordered), SLOTS_PER_LINE)]
    last = spark.createDataFrame([*[(2100 + i, f"{c:<60}GLONASS SLOT / FRQ #") for c, i in lines], (2999, f"{'':60}END OF HEADER")], "ord long, text string")
    out = first
    for more in (fixed_rows, types, times, gap, last):
        out = out.unionByName(more)
    return out


def _old_types(obs: DataFrame) -> DataFrame:
    codes = obs.where(F.col("sys").isin("G", "R")).select(old_code(F.col("code")).alias("c")).where("c is not null").distinct().agg(F.array_sort(F.collect_list("c")).alias("codes"))
    rows = codes.where(F.size("codes") > 0).select("codes", F.explode(F.sequence(F.lit(0), F.floor((F.size("codes") - 1) / OLD_TYPES_PER_LINE).cast("int"))).alias("i"))
    lead = F.when(F.col("i") == 0, F.lpad(F.size("codes").cast("string"), 6, " ")).otherwise("      ")
    some = F.slice("codes", F.col("i") * OLD_TYPES_PER_LINE + 1, F.lit(OLD_TYPES_PER_LINE))
    return rows.select((100 + F.col("i")).cast("long").alias("ord"), header_line(F.concat(lead, F.array_join(F.transform(some, lambda c: F.lpad(c, 6, " ")), "")), "# / TYPES OF OBSERV").alias("text"))


def observation_lines(obs: DataFrame, live_order: bool = False, satellites: DataFrame | None = None) -> DataFrame:
    """Epoch and satellite lines of versions 3 and 4 as (ord = t_ms, prn, text): an epoch's own line has an empty prn.

    obs may have lli and ssi columns; else both are blank. satellites: t_ms, sys and prn of those that have a line, with values or
    without (filters.satellite_epochs); else it is those of obs.
    """
    lists = code_lists(obs, live_order)
    marks = {"lli", "ssi"} <= set(obs.columns)
    mark = F.concat(*[F.coalesce(F.when(F.col(c) > 0, F.col(c).cast("string")), F.lit(" ")) for c in ("lli", "ssi")]) if marks else F.lit("  ")
    cell = F.when(F.col("value").isNotNull(), F.concat(fixed(F.col("value"), 14, 3), mark)).otherwise(" " * 16)
    sats = obs.groupBy("t_ms", "sys", "prn").agg(F.map_from_entries(F.collect_list(F.struct("code", cell.alias("cell")))).alias("have"))
    if satellites is not None:
        sats = satellites.select("t_ms", "sys", "prn").join(sats, ["t_ms", "sys", "prn"], "left")
    rows = sats.join(F.broadcast(lists), "sys")  # a row per system
    text = F.concat("prn", F.array_join(F.transform("codes", lambda c: F.coalesce(F.try_element_at("have", c), F.lit(" " * 16))), ""))
    body = rows.select(F.col("t_ms").alias("ord"), "prn", text.alias("text"))
    epochs = sats.groupBy("t_ms").agg(F.count(F.lit(1)).alias("n"))
    second = (F.pmod(F.col("t_ms"), F.lit(60_000)) / 1000).cast("decimal(12,7)").cast("string")
    line = F.concat(F.lit("> "), F.date_format(F.timestamp_millis("t_ms"), "yyyy MM dd HH mm"), F.lpad(second, 11, " "), F.lit("  0"), F.lpad(F.col("n").cast("string"), 3, " "))
    return body.unionByName(epochs.select(F.col("t_ms").alias("ord"), F.lit("").alias("prn"), line.alias("text")))


def old_observation_lines(obs: DataFrame) -> DataFrame:
    """Lines of version 2 as (ord, prn, text), GPS and GLONASS only; of several codes with one old name the last that has a value."""
    o = obs.where(F.col("sys").isin("G", "R")).withColumn("old", old_code(F.col("code")))
    codes = o.where("old is not null").select("old").distinct().agg(F.array_sort(F.collect_list("old")).alias("codes"))
    cells = o.where("old is not null").groupBy("t_ms", "prn", "old").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("code"))).alias("value"))
    have = cells.groupBy("t_ms", "prn").agg(F.map_from_entries(F.collect_list(F.struct("old", F.struct("value")))).alias("have"))
    present = o.select("t_ms", "prn").distinct().join(have, ["t_ms", "prn"], "left").crossJoin(F.broadcast(codes))  # one row
    cell = lambda c: F.coalesce(F.concat(fixed(F.try_element_at("have", c)["value"], 14, 3), F.lit("  ")), F.lit(" " * 16))
    chunk = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("codes") - 1) / OLD_VALUES_PER_LINE).cast("int"))), lambda i: F.array_join(F.transform(F.slice("codes", i * OLD_VALUES_PER_LINE + 1, F.lit(OLD_VALUES_PER_LINE)), cell), ""))
    body = present.select(F.col("t_ms").alias("ord"), "prn", F.array_join(chunk, "\n").alias("text"))
    epochs = present.groupBy("t_ms").agg(F.array_sort(F.collect_list("prn")).alias("prns"))
    second = (F.pmod(F.col("t_ms"), F.lit(60_000)) / 1000).cast("decimal(12,7)").cast("string")
    t = F.timestamp_millis("t_ms")
    head = F.concat(F.lit(" "), F.date_format(t, "yy"), *[F.concat(F.lit(" "), F.lpad(f(t).cast("string"), 2, " ")) for f in (F.month, F.day, F.hour, F.minute)], F.lpad(second, 11, " "), F.lit("  0"), F.lpad(F.size("prns").cast("string"), 3, " "))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("prns") - 1) / OLD_SATS_PER_LINE).cast("int")), lambda i: F.concat(F.when(i == 0, head).otherwise(" " * 32), F.array_join(F.slice("prns", i * OLD_SATS_PER_LINE + 1, F.lit(OLD_SATS_PER_LINE)), "")))
    return body.unionByName(epochs.select(F.col("t_ms").alias("ord"), F.lit("").alias("prn"), F.array_join(lines, "\n").alias("text")))


def rinex(obs: DataFrame, version: str = "3.04", satellites: DataFrame | None = None, **header) -> DataFrame:
    """A whole observation file as (part, ord, prn, text); versions 2.11, 3.04 and 4.01, the latter two with given satellites if any."""
    old = version.startswith("2")
    head = observation_header(obs, version, **header).select(F.lit(0).alias("part"), "ord", F.lit("").alias("prn"), "text")
    body = old_observation_lines(obs) if old else observation_lines(obs, header.get("live_order", False), satellites)
    return head.unionByName(body.select(F.lit(1).alias("part"), "ord", "prn", "text"))


def write_text(rows: DataFrame, path: str, gzip: bool = True, text: Column | None = None) -> None:
    """Write (part, ord, prn, text) in order over as many files as there are ranges; their names sort as their rows do.

    text: what makes a row's text of its other columns, which alone are then sampled for the ranges and shuffled.
    """
    keys = [c for c in ("part", "ord", "prn") if c in rows.columns]
    # texts that are made behind the shuffle are more work than its bytes tell
    dealt = rows.repartitionByRange(*keys) if text is None else rows.repartitionByRange(cores(rows.sparkSession), *keys)
    dealt.sortWithinPartitions(*keys).select(F.col("text") if text is None else text.alias("text")).write.option("compression", "gzip" if gzip else "none").text(path)


def table(obs: DataFrame, codes: list[str]) -> DataFrame:
    """epoch (ISO), prn and a column per code with 3 digits, empty where missing."""
    wide = obs.groupBy("t_ms", "prn").pivot("code", codes).agg(F.first("value", True))
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("decimal(20,3)").cast("string"), F.lit("")).alias(c)
    return wide.select(F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("epoch"), "prn", *[text(c) for c in codes])


def write_table(obs: DataFrame, codes: list[str], path: str) -> None:
    table(obs, codes).repartitionByRange("epoch", "prn").sortWithinPartitions("epoch", "prn").write.option("header", "true").option("emptyValue", "").csv(path)


def metadata(header: DataFrame, statistics: DataFrame, warnings: DataFrame) -> DataFrame:
    """One JSON text of a file's header, its statistics and its warnings. header and statistics are one row each."""
    level = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0).cast("long")).alias(f"{s}s" if s != "info" else s)
    found = warnings.agg(F.struct(level("error"), level("warning"), level("info"), F.collect_list(F.struct("code", "severity", "message", "count", *[c for c in warnings.columns if c == "examples"])).alias("items")).alias("validation"))
    one = header.select(F.struct(*header.columns).alias("header")).crossJoin(statistics.select(F.struct(*statistics.columns).alias("statistics"))).crossJoin(found)
    return one.select(F.to_json(F.struct("header", "statistics", "validation")).alias("text"))


def navigation_text(prn: Column, toc_ms: Column, numbers: list[Column]) -> Column:
    """A record of version 3 navigation files."""
    number = lambda x: F.lpad(F.format_string("%19.12e", F.coalesce(x, F.lit(0.0))), 19, " ")
    first = F.concat(prn, F.lit(" "), F.date_format(F.timestamp_millis(toc_ms), "yyyy MM dd HH mm ss"))
    v = [number(x) for x in numbers]
    rows = [F.concat(*v[:3]), *[F.concat(F.lit("    "), *v[i : i + 4]) for i in range(3, len(v), 4)]]
    return F.concat(first, F.translate(F.concat_ws("\n", *rows), "e", "D"))


def navigation_lines(eph: DataFrame) -> DataFrame:
    """Records of version 3 navigation files as (ord, prn, text)."""
    record = lambda payload, names: navigation_text(F.col("prn"), F.col("toc_ms"), [F.col(f"{payload}.{n}") for n in names])
    text = F.when(F.col("state").isNotNull(), record("state", STATE)).otherwise(record("kepler", KEPLER))
    return eph.select(F.col("toc_ms").alias("ord"), "prn", text.alias("text"))


def gpx(fixes: DataFrame, name: str = "track") -> DataFrame:
    """Lines of a GPX track as (part, ord, text)."""
    spark = fixes.sparkSession
    safe = name.replace("&", "&amp;").replace("<", "&lt;")
    top = f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="almanax" xmlns="http://www.topografix.com/GPX/1/1">\n<trk><name>{safe}</name><trkseg>'
    ends = spark.createDataFrame([(0, 0, top), (2, 0, "</trkseg></trk></gpx>")], "part int, ord long, text string")
    tag = lambda c, t: F.coalesce(F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>")), F.lit(""))
    at = lambda c: F.col(c).cast("decimal(20,8)").cast("string")
    point = F.concat(F.lit('<trkpt lat="'), at("lat"), F.lit('" lon="'), at("lon"), F.lit('">'), tag(F.col("alt").cast("decimal(20,1)").cast("string"), "ele"), tag(F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "time"), F.lit("</trkpt>"))
    return ends.unionByName(fixes.select(F.lit(1).alias("part"), F.col("t_ms").alias("ord"), point.alias("text")))


def edit_headers(texts: DataFrame, lines: dict[str, str]) -> DataFrame:
    """texts (file, text) with header lines replaced by label, or put before the header's end if they lack; the body stays as it is.

    lines: the 60 characters of content by label.
    """
    end = F.instr("text", "END OF HEADER")
    head = F.substring_index("text", "END OF HEADER", 1)
    rows = F.split(head, "\n")
    kept, last = F.slice(rows, F.lit(1), F.size(rows) - 1), F.element_at(rows, -1)
    label = lambda x: F.trim(F.regexp_replace(F.substring(x, 61, 20), "\r", ""))
    fresh = F.create_map(*[F.lit(v) for k, c in lines.items() for v in (k, f"{c:<60.60}{k}")])
    swapped = F.transform(kept, lambda x: F.coalesce(F.concat(F.try_element_at(fresh, label(x)), F.when(x.endswith("\r"), "\r").otherwise("")), x))
    have = F.transform(kept, label)
    missing = F.array_compact(F.array(*[F.when(~F.array_contains(have, k), F.lit(f"{c:<60.60}{k}")) for k, c in lines.items()]))
    new_head = F.concat(F.array_join(F.concat(swapped, missing, F.array(last)), "\n"), F.expr("substring(text, instr(text, 'END OF HEADER'))"))
    return texts.withColumn("text", F.when(end > 0, new_head).otherwise(F.col("text")))


def report_tables(statistics: DataFrame) -> DataFrame:
    """name and value of every figure of a one-row table."""
    pairs = F.explode(F.map_entries(F.create_map(*[x for c in statistics.columns for x in (F.lit(c), F.col(c).cast("string"))]))).alias("e")
    return statistics.select(pairs).select(F.col("e.key").alias("name"), F.col("e.value").alias("value"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """file and text of an export's parts put together, for small files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
