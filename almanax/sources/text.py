"""NMEA sentences, sourcetables and antenna calibrations as DataFrames, by Column functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def lines(texts: DataFrame) -> DataFrame:
    """file, pos and line of every line of texts (file, text)."""
    return texts.select("file", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))


def nmea_checksum_ok(line: Column) -> Column:
    """Whether a sentence's checksum is there and right: the exclusive or of the characters between $ and *."""
    body = F.regexp_extract(line, r"^[$!]([^*]*)\*[0-9A-Fa-f]{2}\s*$", 1)
    given = F.regexp_extract(line, r"\*([0-9A-Fa-f]{2})\s*$", 1)
    found = F.aggregate(F.transform(F.split(body, ""), lambda c: F.ascii(c)), F.lit(0), lambda acc, x: acc.bitwiseXOR(x))
    return F.when(given == "", False).otherwise(F.lpad(F.hex(found), 2, "0") == F.upper(given))


def nmea_degrees(value: Column, side: Column) -> Column:
    """Degrees of ddmm.mmmm and a hemisphere; NULL for an empty field."""
    raw = F.when(F.trim(value) != "", value.try_cast("double"))
    whole = F.floor(raw / 100)
    return (whole + (raw - whole * 100) / 60) * F.when(side.isin("S", "W"), -1).otherwise(1)


def nmea_fixes(sentences: DataFrame) -> DataFrame:
    """track (the file), t_ms (NULL without a date), tod_ms, lat, lon, alt, satellites, quality, speed and course of lines (file, pos, line).

    Sentences of one time of day that follow each other are one fix; a fix takes its date from the sentence about it or before it.
    """
    ok = sentences.where(F.col("line").startswith("$") & nmea_checksum_ok(F.col("line")))
    f = F.split(F.regexp_extract("line", r"^\$([^*]*)", 1), ",")
    at = lambda i: F.try_element_at("f", F.lit(i + 1))
    kind = F.substring(at(0), 3, 3)
    ok = ok.withColumn("f", f).withColumn("kind", kind).where((F.col("kind") == "GGA") & (at(6) != "0") & (at(6) != "") | (F.col("kind") == "RMC") & (at(2) == "A"))
    gga, num = F.col("kind") == "GGA", lambda i: F.when(F.trim(at(i)) != "", at(i).try_cast("double"))
    tod = at(1)
    tod_ms = F.round((F.substring(tod, 1, 2).try_cast("int") * 3600 + F.substring(tod, 3, 2).try_cast("int") * 60 + F.substring(tod, 5, 9).try_cast("double")) * 1000).cast("long")
    date = F.to_date(F.when(F.length(at(9)) == 6, F.concat(F.substring(at(9), 1, 4), F.lit("20"), F.substring(at(9), 5, 2))), "ddMMyyyy")
    rows = ok.select(
        "file", "pos", tod_ms.alias("tod_ms"), F.when(gga, nmea_degrees(at(2), at(3))).otherwise(nmea_degrees(at(3), at(4))).alias("lat"), F.when(gga, nmea_degrees(at(4), at(5))).otherwise(nmea_degrees(at(5), at(6))).alias("lon"),
        F.when(gga, num(9)).alias("alt"), F.when(gga, num(7).cast("int")).alias("satellites"), F.when(gga, num(6).cast("int")).alias("quality"), F.when(~gga, num(7)).alias("speed"), F.when(~gga, num(8)).alias("course"), F.when(~gga, date).alias("date"),
    ).where("lat is not null and lon is not null")
    w = W.partitionBy("file").orderBy("pos")
    rows = rows.withColumn("new", F.when(F.lag("tod_ms").over(w).eqNullSafe(F.col("tod_ms")), 0).otherwise(1)).withColumn("fix", F.sum("new").over(w))
    first = lambda c: F.first(c, True).alias(c)  # noqa: E731  a fix has one sentence of each kind
    fixes = rows.groupBy("file", "fix").agg(F.min("pos").alias("pos"), *[first(c) for c in ("tod_ms", "lat", "lon", "alt", "satellites", "quality", "speed", "course", "date")])
    dated = fixes.withColumn("date", F.coalesce("date", F.last("date", True).over(w)))
    t = F.unix_millis(F.col("date").cast("timestamp")) + F.col("tod_ms")
    return dated.select(F.col("file").alias("track"), t.alias("t_ms"), "tod_ms", "lat", "lon", "alt", "satellites", F.coalesce("quality", F.lit(1)).alias("quality"), "speed", "course")


def _records(rows: DataFrame, tag: str) -> DataFrame:
    w_end = F.min(F.when(F.col("line").startswith("ENDSOURCETABLE"), F.col("pos"))).over(W.partitionBy("file"))
    return rows.withColumn("stop", w_end).where(F.col("line").startswith(f"{tag};") & (F.col("stop").isNull() | (F.col("pos") < F.col("stop")))).withColumn("f", F.split("line", ";"))


def sourcetable(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Streams, casters and networks of a sourcetable's lines (file, pos, line)."""
    text = lambda i, n: F.try_element_at("f", F.lit(i + 1)).alias(n)
    number = lambda i, n, kind: F.try_element_at("f", F.lit(i + 1)).try_cast(kind).alias(n)
    streams = _records(rows, "STR").select(
        "file", "pos", text(1, "mountpoint"), text(2, "identifier"), text(3, "format"), text(4, "details"), number(5, "carrier", "int"), text(6, "nav_system"), text(7, "network"), text(8, "country"), number(9, "lat", "double"),
        number(10, "lon", "double"), number(11, "nmea", "int"), number(12, "solution", "int"), text(13, "generator"), text(14, "compression"), text(15, "authentication"), text(16, "fee"), number(17, "bitrate", "int"), text(18, "misc"),
    )
    casters = _records(rows, "CAS").select("file", "pos", text(1, "host"), number(2, "port", "int"), text(3, "identifier"), text(4, "operator"), number(5, "nmea", "int"), text(6, "country"), number(7, "lat", "double"), number(8, "lon", "double"))
    networks = _records(rows, "NET").select("file", "pos", text(1, "identifier"), text(2, "operator"), text(3, "authentication"), text(4, "fee"), text(5, "web"), text(6, "stream_web"), text(7, "registration"))
    return streams, casters, networks


def sourcetable_summary(streams: DataFrame) -> DataFrame:
    """One row: numbers of streams, countries, formats and navigation systems."""
    systems = streams.select(F.explode(F.split("nav_system", r"\+")).alias("s")).where("s <> ''").agg(F.count_distinct("s").alias("nav_systems"))
    return streams.agg(F.count(F.lit(1)).alias("streams"), F.count_distinct("country").alias("countries"), F.count_distinct("format").alias("formats")).crossJoin(systems)  # one row each


def antennas(rows: DataFrame) -> DataFrame:
    """One row per antenna of calibration lines (file, pos, line), with an array of frequencies and their patterns.

    Lines take the number of the antenna and of the frequency that began last in their file.
    """
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    label, line = F.trim(F.substring("line", 61, 20)), F.col("line")
    count = lambda name: F.sum((F.col("label") == name).cast("int")).over(w)
    r = rows.withColumn("label", label).withColumn("ant", count("START OF ANTENNA"))
    r = r.withColumn("open", F.col("ant") - count("END OF ANTENNA")).where("ant > 0 and open > 0 or label = 'END OF ANTENNA'")
    r = r.withColumn("freq", F.sum((F.col("label") == "START OF FREQUENCY").cast("int")).over(W.partitionBy("file", "ant").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    pick = lambda name, c, out: F.min_by(c, F.when(F.col("label") == name, F.col("pos"))).alias(out)
    field = lambda a, n: F.trim(F.substring(line, a, n))
    num = lambda a, n: field(a, n).try_cast("double")
    instant = F.regexp_replace(field(1, 43), " +", " ")
    head = r.where("freq = 0").groupBy("file", "ant").agg(
        pick("TYPE / SERIAL NO", field(1, 20), "type"), pick("TYPE / SERIAL NO", field(21, 20), "serial_no"), pick("TYPE / SERIAL NO", field(41, 10), "svn_code"), pick("TYPE / SERIAL NO", field(51, 10), "cospar_id"),
        pick("METH / BY / # / DATE", field(1, 20), "method"), pick("METH / BY / # / DATE", field(21, 20), "agency"), pick("METH / BY / # / DATE", field(41, 6).try_cast("int"), "n_calibrated"), pick("METH / BY / # / DATE", field(51, 10), "date"),
        pick("DAZI", num(3, 6), "dazi"), pick("ZEN1 / ZEN2 / DZEN", num(3, 6), "zen1"), pick("ZEN1 / ZEN2 / DZEN", num(9, 6), "zen2"), pick("ZEN1 / ZEN2 / DZEN", num(15, 6), "dzen"), pick("SINEX CODE", field(1, 10), "sinex_code"),
        pick("VALID FROM", instant, "valid_from"), pick("VALID UNTIL", instant, "valid_until"),
    )
    numbers = F.transform(F.filter(F.split(F.expr("substring(line, 9)"), " +"), lambda x: x != ""), lambda x: x.try_cast("double"))
    data = (F.col("label") != "START OF FREQUENCY") & (F.col("label") != "END OF FREQUENCY")
    bare, azimuth = F.col("line").startswith("   NOAZI"), F.substring("line", 1, 8).try_cast("double")
    north = F.transform(F.array(*[F.substring("line", k, 10) for k in (1, 11, 21)]), lambda x: F.trim(x).try_cast("double"))
    body = r.where(F.col("freq") > 0).groupBy("file", "ant", "freq").agg(
        pick("START OF FREQUENCY", field(4, 3), "frequency"), pick("NORTH / EAST / UP", north, "pco"), F.min_by(numbers, F.when(bare, F.col("pos"))).alias("pcv_noazi"),
        F.transform(F.array_sort(F.collect_list(F.when(~bare & azimuth.isNotNull() & data & (F.col("label") != "NORTH / EAST / UP"), F.struct(azimuth.alias("az"), numbers.alias("v"))))), lambda x: x["v"]).alias("pcv"),
    )
    all_ = body.groupBy("file", "ant").agg(F.array_sort(F.collect_list(F.struct("freq", "frequency", "pco", "pcv_noazi", "pcv"))).alias("frequencies"))
    out = head.join(all_, ["file", "ant"], "left")
    return out.withColumn("is_satellite", F.col("serial_no").rlike("^[A-Z][0-9]{2,3}$") & (F.col("cospar_id") != ""))


def antenna_summary(ants: DataFrame) -> DataFrame:
    """One row: antennas, receivers, satellites, and systems that frequencies name."""
    systems = ants.select(F.explode("frequencies").alias("f")).agg(F.count_distinct(F.substring("f.frequency", 1, 1)).alias("systems"))
    return ants.agg(F.count(F.lit(1)).alias("antennas"), F.count_if(~F.col("is_satellite")).alias("receivers"), F.count_if("is_satellite").alias("satellites")).crossJoin(systems)  # one row each
