"""Station files, sentences, sourcetables, antennas and RTCM frames against small literal fixtures."""

import gzip
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from almanax.sinks import exports
from almanax.sources import files, names, rinex, rtcm, text
from almanax.sources import navigation as nav

HEADER3 = """     3.03           OBSERVATION DATA    M                   RINEX VERSION / TYPE
nobody                                                      OBSERVER / AGENCY
ALMA                                                        MARKER NAME
 -2148744.1234  4426641.2345  4044655.9876                  APPROX POSITION XYZ
     1.000                                                  INTERVAL
G    4 C1C L1C S1C C2W                                      SYS / # / OBS TYPES
R    2 C1C S1C                                              SYS / # / OBS TYPES
                                                            END OF HEADER
"""


def cell(v):
    return f"{v:14.3f}  " if v is not None else " " * 16


def sat(prn, *values):
    return prn + "".join(cell(v) for v in values)


EPOCH1 = "\n".join(["> 2021  7  4  9 12 31.0000000  0  3", sat("G01", 21987654.321, 115544332.211, 44.6, 88888.777), sat("G03", 22876543.456, None, 39.7, 88888.776), sat("R01", 20123000.0, 33.9), ""])
EPOCH2 = "\n".join(["> 2021  7  4  9 12 32.0000000  0  2", sat("G01", 21987654.4, 115544332.3, 45.4, 88888.777), sat("R01", 20123001.0, 34.6), ""])
START = 1625389951000
EVENT = "> 2021  7  4  9 12 33.0000000  4  2\nSOME RECORD                                                 COMMENT\nANOTHER                                                     COMMENT\n"
FLAGGED = EPOCH2.replace("  0  2", "  1  2")


def parsed(spark, *bodies):
    texts = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "file string, text string")
    return {(r.file, r.t_ms, r.prn, r.code): r.value for r in rinex.observations(rinex.plain_texts(texts)).collect()}


def test_version_3(spark):
    got = parsed(spark, HEADER3 + EPOCH1 + EPOCH2)
    times = sorted({k[1] for k in got})
    assert len(times) == 2 and times[1] - times[0] == 1000 and times[0] == 1625389951000
    assert {k[2] for k in got if k[1] == times[0]} == {"G01", "G03", "R01"}
    assert got["0", times[0], "G01", "S1C"] == 44.6 and got["0", times[0], "G03", "L1C"] is None and got["0", times[1], "R01", "S1C"] == 34.6


def test_events_and_flags_are_left_out(spark):
    assert len({k[1] for k in parsed(spark, HEADER3 + EPOCH1 + FLAGGED)}) == 1
    assert len({k[1] for k in parsed(spark, HEADER3 + EPOCH1 + EVENT + EPOCH2)}) == 2


def test_header_fields(spark):
    h = rinex.headers(spark.createDataFrame([("a", HEADER3 + EPOCH1)], "file string, text string")).first()
    assert (h.version, h.type, h.marker_name, h.interval) == (3.03, "O", "ALMA", 1.0)
    assert h.approx_position == [-2148744.1234, 4426641.2345, 4044655.9876] and h.obs_types == {"G": ["C1C", "L1C", "S1C", "C2W"], "R": ["C1C", "S1C"]}


def test_invalid_file_and_gzip(spark, tmp_path):
    (tmp_path / "bad.rnx").write_text("not a rinex file")
    with pytest.raises(PySparkException, match="No valid RINEX header: .*bad.rnx"):
        rinex.read_observations(spark, str(tmp_path / "bad.rnx")).count()
    assert rinex.read_observations(spark, str(tmp_path / "bad.rnx"), permissive=True).count() == 0
    (tmp_path / "good.rnx.gz").write_bytes(gzip.compress((HEADER3 + EPOCH1).encode()))
    assert rinex.read_observations(spark, str(tmp_path / "good.rnx.gz")).where("value is not null").count() == 9


def test_reads_push_filters_down(spark, tmp_path):
    for name in ("a.rnx", "b.rnx"):
        (tmp_path / name).write_text(HEADER3 + EPOCH1 + EPOCH2)
    every = rinex.read_observations(spark, str(tmp_path))
    some = every.where("prn in ('G01', 'R01') and code = 'S1C' and t_ms > T".replace("T", str(START)))
    assert every.rdd.getNumPartitions() == 2 and every.count() == 2 * (10 + 6) and {(r.prn, r.value) for r in some.collect()} == {("G01", 45.4), ("R01", 34.6)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "prn" in plan and "= S1C" not in plan and "t_ms#" in plan and f"> {START}" not in plan
    assert rinex.read_observations(spark, str(tmp_path / "*.rnx")).count() == every.count() and rinex.read_headers(spark, str(tmp_path / "a*")).first().marker_name == "ALMA"


def test_parts_of_an_export_are_one_file(spark, tmp_path):
    lines = (HEADER3 + EPOCH1 + EPOCH2).splitlines(keepends=True)
    for i, (a, b) in enumerate([(0, 5), (5, 9), (9, 10), (10, len(lines))]):
        (tmp_path / f"part-{i:05d}.txt.gz").write_bytes(gzip.compress("".join(lines[a:b]).encode()))
    (tmp_path / "_SUCCESS").write_text("")
    assert rinex.read_observations(spark, str(tmp_path)).where("value is not null").count() == 9 + 6


def test_lines_longer_than_a_chunk(monkeypatch, tmp_path):
    monkeypatch.setattr(files, "_CHUNK", 7)
    (tmp_path / "x").write_text("first line\r\n\nthird\nlast")
    (one,) = files.logical_files(str(tmp_path / "x"))
    assert list(one.lines()) == ["first line", "", "third", "last"]


HEADER2 = """     2.11           OBSERVATION DATA    G (GPS)             RINEX VERSION / TYPE
MARK                                                        MARKER NAME
     5    C1    L1    S1    C2    S2                        # / TYPES OF OBSERV
                                                            END OF HEADER
"""


def test_version_2(spark):
    row = lambda *v: "".join(cell(x) for x in v)
    got = parsed(spark, HEADER2 + " 21  7  4  9 12 31.0000000  0  2G01G03\n" + row(1.0, 2.0, 40.7, 4.0, 38.3) + "\n" + row(1.5, None, 36.4, 4.5, 34.1) + "\n")
    assert got["0", 1625389951000, "G01", "S1"] == 40.7 and got["0", 1625389951000, "G03", "S2"] == 34.1 and got["0", 1625389951000, "G03", "L1"] is None


CRX3 = HEADER3.replace("G    4 C1C L1C S1C C2W", "G    3 C1C L1C S1C    ")
CRX3 = "3.0                 COMPACT RINEX FORMAT                    CRINEX VERS   / TYPE\n" + CRX3
CRX3_1 = "> 2021  7  4  9 12 31.0000000  0  3      G01G03R01\n\n3&21987654321 3&115544332211 3&44600\n3&22876543456 3&115599887456 3&39700\n3&20123000000 3&33900\n"
CRX3_2 = "                    2             2         R 1&&&\n\n100 200 800\n1000 700\n"


def test_compact_version_3(spark):
    got = parsed(spark, CRX3 + CRX3_1 + CRX3_2)
    t = sorted({k[1] for k in got})
    assert len(t) == 2 and {k[2] for k in got if k[1] == t[1]} == {"G01", "R01"}
    assert got["0", t[1], "G01", "S1C"] == 45.4 and got["0", t[1], "R01", "S1C"] == 34.6 and got["0", t[1], "G01", "C1C"] == 21987654.421


def test_compact_event_begins_anew(spark):
    again = "> 2021  7  4  9 12 32.0000000  0  2      G01R01\n\n3&21987654421 3&115544332411 3&45400\n3&20123001000 3&34600\n"
    got = parsed(spark, CRX3 + CRX3_1 + EVENT + again)
    assert len({k[1] for k in got}) == 2 and got["0", 1625389952000, "R01", "S1C"] == 34.6


def test_compact_version_1(spark):
    head = "1.0                 COMPACT RINEX FORMAT                    CRINEX VERS   / TYPE\n" + HEADER2.replace("     5    C1    L1    S1    C2    S2", "     3    C1    L1    S1            ")
    got = parsed(spark, head + "&25 11 23  4  5  0.0000000  0  2G01G03\n\n3&21987654321 3&115544332211 3&44600\n3&22876543456 3&115599887456 3&39700\n" + "                15\n\n100 200 800\n-100 300 -200\n")
    t = sorted({k[1] for k in got})
    assert t[1] - t[0] == 15000 and got["0", t[1], "G01", "S1"] == 45.4 and got["0", t[1], "G03", "S1"] == 39.5


def test_differences_of_every_order():
    values = [1000, 1300, 1900, 2850, 4200, 6000, 8300]
    rows = [values]
    for _ in range(3):
        rows.append([b - a for a, b in zip(rows[-1][:-1], rows[-1][1:], strict=True)])
    tokens = [f"3&{values[0]}", str(rows[1][0]), str(rows[2][0]), *[str(x) for x in rows[3]]]
    state = {}
    assert [rinex._values(state, "G01", [t])[0] for t in tokens] == values


def navigation(version):
    v = "    " if version >= 3 else "   "
    num = lambda *xs: "".join(f"{x:19.12E}".replace("E", "D") for x in xs)
    first = "G05 2024 01 01 02 00 00" if version >= 3 else " 5 24  1  1  2  0  0.0"
    k = [float(i) for i in range(1, 30)]
    lines = [first + num(*k[:3])] + [v + num(*k[i : i + 4]) for i in range(3, 29, 4)]
    kind = "N: GNSS NAV DATA" if version >= 3 else "N: GPS NAV DATA"
    mark = "> EPH G05 LNAV\n" if version >= 4 else ""
    return f"{version:9.2f}           {kind:<20}{'M':<20}RINEX VERSION / TYPE\n{'':60}END OF HEADER\n{mark}" + "\n".join(lines) + "\n"


def test_navigation_versions_agree(spark):
    texts = spark.createDataFrame([(str(v), navigation(v)) for v in (2.11, 3.04, 4.01)], "file string, text string")
    rows = rinex.ephemerides(texts).collect()
    assert len(rows) == 3 and len({tuple(r.kepler) for r in rows}) == 1 and {(r.prn, r.toc_ms) for r in rows} == {("G05", 1704074400000)}
    assert rows[0].kepler.sqrtA == 11.0 and rows[0].kepler.svHealth == 25.0 and rows[0].state is None


def test_names(spark):
    rows = spark.createDataFrame([("BRDC00IGS_R_20240010000_01D_MN.rnx.gz",), ("abmf0010.24g",), ("x_SN.rnx",), ("ABMF00GLP_R_20240010000_01D_30S_MO.crx.gz",)], "n string")
    got = rows.select(names.is_navigation_name(F.col("n")).alias("a"), names.navigation_system(F.col("n")).alias("b"), names.long_name_parts(F.col("n")).alias("c")).collect()
    assert [(r.a, r.b) for r in got] == [(True, "M"), (True, "R"), (False, "S"), (False, None)] and got[3].c.station == "ABMF" and got[3].c.country == "GLP"
    kinds = spark.createDataFrame([(HEADER3,), (navigation(3.04),), ("x",)], "t string").select(names.content_kind(F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["obs", "nav", "unknown"]
    made = spark.range(1).select(names.observation_name(F.lit("test"), F.lit(1704067200000), F.lit(86370.0), F.lit(30.0)).alias("a"), names.legacy_name(F.lit("test"), F.lit(1704067200000)).alias("b"), names.stream_name(F.lit("MNT"), F.lit(1704067200000), F.lit(7200), F.lit(0.2)).alias("c"), names.broadcast_name(F.lit(1704067200000)).alias("d")).first()
    assert tuple(made) == ("TEST00XXX_R_20240010000_01D_30S_MO.rnx", "TEST001a.24o", "MNT000000_S_20240010000_02H_05Z_MO.rnx", "BRDC00IGS_R_20240010000_01D_MN.rnx")


def sentence(body):
    code = 0
    for c in body:
        code ^= ord(c)
    return f"${body}*{code:02X}"


GGA = sentence("GPGGA,101530.250,4712.3456,N,00845.6789,E,1,9,0.95,431.5,M,48.0,M,,")
RMC = sentence("GPRMC,101530.250,A,4712.3456,N,00845.6789,E,1.25,87.50,140622,,,A")


def fixes(spark, *sentences):
    return text.nmea_fixes(text.lines(spark.createDataFrame([("f", "\n".join(sentences))], "file string, text string"))).collect()


def test_nmea(spark):
    (fix,) = fixes(spark, GGA, RMC)
    assert abs(fix.lat - 47.20576) < 1e-7 and abs(fix.lon - 8.761315) < 1e-7 and fix.alt == 431.5 and fix.satellites == 9 and fix.speed == 1.25 and fix.t_ms == 1655201730250
    assert len(fixes(spark, sentence("GNGGA,101530.250,4712.3456,N,00845.6789,E,1,11,0.70,431.5,M,48.0,M,,"))) == 1
    void = [sentence("GPGGA,101530.250,4712.3456,N,00845.6789,E,0,0,,,M,,M,,"), sentence("GPRMC,101530.250,V,,,,,,,140622,,,N")]
    for bad in (GGA[:-2] + "ZZ", RMC[:-2] + ("00" if RMC[-2:] != "00" else "11"), *void, "no sentence", "", GGA[:-3]):
        assert fixes(spark, bad) == []
    d = spark.createDataFrame([("4712.3456", "N"), ("1234.5000", "S"), ("10030.0000", "E"), ("00715.6000", "W"), ("", "N")], "v string, s string")
    got = [r[0] for r in d.select(text.nmea_degrees(F.col("v"), F.col("s"))).collect()]
    assert got[4] is None and max(abs(a - b) for a, b in zip(got, [47.20576, -12.575, 100.5, -7.26], strict=False)) < 1e-9


def test_sourcetable(spark):
    table = "CAS;host.example.org;2101;Ours;We;0;USA;40.0;-74.0;;0;\nNET;OurNet;OurOrg;B;N;http://example.com;none;t;none\nSTR;MOUNT1;S1;RTCM 3.2;1077(1);2;GPS+GLO;OurNet;USA;40.1;-74.1;1;0;Trimble;none;B;N;5000;Test\nSTR;MOUNT2;S2;RTCM 3.3;1077(1),1087(1);2;GPS+GLO+GAL;OurNet;USA;41.0;-73.5;1;1;Leica;none;B;N;8000;RTK\nENDSOURCETABLE\nSTR;late"
    streams, casters, networks = text.sourcetable(text.lines(spark.createDataFrame([("t", table)], "file string, text string")))
    assert [r.mountpoint for r in streams.orderBy("pos").collect()] == ["MOUNT1", "MOUNT2"] and casters.first().port == 2101 and networks.first().operator == "OurOrg"
    assert tuple(text.sourcetable_summary(streams).first()) == (2, 1, 2, 3)


def test_antennas(spark):
    label = lambda c, n: f"{c:<60}{n}"
    rows = [label("", "START OF ANTENNA"), label(f"{'AOAD/M_T        NONE':<20}", "TYPE / SERIAL NO"), label("     5.0", "DAZI"), label(f"  {0.0:6.1f}{10.0:6.1f}{5.0:6.1f}", "ZEN1 / ZEN2 / DZEN"), label("   G01", "START OF FREQUENCY"), label(f"{0.58:10.2f}{-0.37:10.2f}{91.85:10.2f}", "NORTH / EAST / UP"), "   NOAZI    0.00   -0.24   -0.92", "     0.0    0.01   -0.20   -0.90", "     5.0    0.02   -0.21   -0.91", label("   G01", "END OF FREQUENCY"), label("", "END OF ANTENNA")]
    a = text.antennas(text.lines(spark.createDataFrame([("a", "\n".join(rows))], "file string, text string")))
    r = a.first()
    f = r.frequencies[0]
    assert (r.type, r.dazi, r.zen2, r.is_satellite) == ("AOAD/M_T        NONE", 5.0, 10.0, False) and f.frequency == "G01" and f.pco == [0.58, -0.37, 91.85] and f.pcv_noazi == [0.0, -0.24, -0.92] and f.pcv == [[0.01, -0.2, -0.9], [0.02, -0.21, -0.91]]
    assert tuple(text.antenna_summary(a).first()) == (1, 1, 0, 1)


def frame(kind, size=50):
    payload = bytes([kind >> 4, (kind & 15) << 4]) + bytes(size - 2)
    head = bytes([0xD3, size >> 8, size & 255]) + payload
    return head + struct.pack(">I", rtcm.crc24q(head))[1:]


def test_frames():
    a, b = frame(1077, 30), frame(1087, 40)
    assert [rtcm.message_type(p) for p in rtcm.frames(a + b)[0]] == [1077, 1087]
    first, rest = rtcm.frames(a[:10])
    assert first == [] and [rtcm.message_type(p) for p in rtcm.frames(rest + a[10:])[0]] == [1077]
    assert len(rtcm.frames(b"\x00garbage" + a)[0]) == 1 and len(rtcm.frames(a[:-1] + b"\x00" + b)[0]) == 1


def msm4(satellites, places, cells, kind=1074):
    bits = f"{kind:012b}{0:012b}{100000:030b}{0:019b}" + "".join("1" if i + 1 in satellites else "0" for i in range(64)) + "".join("1" if i in places else "0" for i in range(32)) + "1" * (len(satellites) * len(places))
    bits += "".join(f"{80:08b}" for _ in satellites) + "".join(f"{512:010b}" for _ in satellites)
    for size, k in ((15, 0), (22, 1), (4, 2), (1, 3), (6, 4)):
        bits += "".join(f"{c[k] & (1 << size) - 1:0{size}b}" for c in cells)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))


def test_msm(spark):
    cell = (1000, 2000, 6, 0, 42)
    one = rtcm.decode_msm(msm4([1], [1], [cell]))
    (s,) = one["signals"]
    assert one["system"] == "G" and s["prn"] == "G01" and s["code"] == "1C" and s["cn0"] == 42 and abs(s["wavelength"] - 0.190294) < 1e-6 and s["lock_s"] == 1.024 and s["pseudorange"] > 2e7
    assert len(rtcm.decode_msm(msm4([1, 5, 20], [1], [cell] * 3))["signals"]) == 3
    assert rtcm.decode_msm(msm4([1], [1], [cell], 1094))["signals"][0]["prn"] == "E01" and rtcm.decode_msm(msm4([3], [1], [cell], 1124))["signals"][0]["code"] == "2I"
    assert rtcm.decode_msm(msm4([1], [0], [cell]))["signals"] == [] and rtcm.decode_msm(msm4([1], [1], [(1000, 2000, 6, 0, 0)]))["signals"][0]["cn0"] is None
    assert rtcm.decode_msm(frame(1073)[3:-3]) is None and rtcm.decode_msm(frame(1005)[3:-3]) is None
    got = spark.createDataFrame([(msm4([1], [1], [cell]),), (b"\x43\x20",), (None,)], "p binary").select(rtcm.msm("p").alias("m")).collect()
    assert got[0].m.epoch_ms == 100000 and got[1].m is None and got[2].m is None


def test_exports_read_back(spark, tmp_path):
    obs = rinex.observations(spark.createDataFrame([("0", HEADER3 + EPOCH1 + EPOCH2)], "file string, text string")).drop("file")
    for version in ("3.04", "4.01"):
        lines = exports.rinex(obs, version).orderBy("part", "ord", "prn").collect()
        again = parsed(spark, "\n".join(r.text for r in lines) + "\n")
        want = {(r.t_ms, r.prn, r.code): r.value for r in obs.collect()}
        assert {k[1:]: v for k, v in again.items() if v is not None} == {k: v for k, v in want.items() if v is not None}
    exports.write_text(exports.rinex(obs), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == len(lines)


def test_old_export_reads_back(spark):
    obs = rinex.observations(spark.createDataFrame([("0", HEADER3 + EPOCH1 + EPOCH2)], "file string, text string")).drop("file")
    body = "\n".join(r.text for r in exports.rinex(obs, "2.11").orderBy("part", "ord", "prn").collect()) + "\n"
    got = parsed(spark, body)
    assert got["0", 1625389951000, "G01", "P2"] == 88888.777 and got["0", 1625389951000, "R01", "S1"] == 33.9 and got["0", 1625389951000, "R01", "L1"] is None


def test_header_edit_keeps_body(spark):
    texts = spark.createDataFrame([("a", HEADER3 + EPOCH1), ("b", "no header")], "file string, text string")
    got = {r.file: r.text for r in exports.edit_headers(texts, {"MARKER NAME": "NEW", "MARKER TYPE": "GEODETIC"}).collect()}
    assert got["a"].endswith(EPOCH1) and "NEW".ljust(60) + "MARKER NAME" in got["a"] and got["a"].index("MARKER TYPE") < got["a"].index("END OF HEADER") and got["b"] == "no header"


def test_table_gpx_and_navigation(spark):
    obs = rinex.observations(spark.createDataFrame([("0", HEADER3 + EPOCH1)], "file string, text string"))
    first = exports.table(obs, ["C1C", "L1C"]).orderBy("prn").collect()
    assert tuple(first[0]) == ("2021-07-04T09:12:31.000Z", "G01", "21987654.321", "115544332.211") and first[1]["L1C"] == ""
    fix = spark.createDataFrame([(0, 48.1, 11.5, 500.04)], "t_ms long, lat double, lon double, alt double")
    assert '<trkpt lat="48.10000000" lon="11.50000000"><ele>500.0</ele>' in exports.gpx(fix).where("part = 1").first().text
    eph = rinex.ephemerides(spark.createDataFrame([("n", navigation(3.04))], "file string, text string"))
    head = navigation(3.04).split("G05")[0]
    body = exports.navigation_lines(eph).first().text
    again = rinex.ephemerides(spark.createDataFrame([("n", head + body + "\n")], "file string, text string")).first()
    assert again.kepler == eph.first().kepler


def ranged(path, size):
    """Rows of a file read by ranges of so many bytes, and the number of ranges."""
    parts = files.file_ranges(str(path), size, 1)
    return [row for part in parts for row in rinex.range_rows(part)], len(parts)


def test_ranges_at_every_byte_of_version_3(tmp_path):
    body = HEADER3 + EPOCH1 + EVENT + EPOCH2 + FLAGGED + EPOCH1.replace(" 9 12 31", " 9 12 35").replace("\n", "\r\n") + EPOCH2.replace(" 9 12 32", " 9 12 36").rstrip("\n")
    (tmp_path / "a.rnx").write_bytes(body.encode())
    whole = list(rinex.observation_rows(iter(body.replace("\r", "").split("\n"))))
    assert len(whole) == 2 * (10 + 6)
    for size in range(1, len(body) + 2):
        got, n = ranged(tmp_path / "a.rnx", size)
        assert got == whole and n == -(-len(body) // size)


def test_ranges_of_part_files(tmp_path, monkeypatch):
    """Parts end within lines, and chunks are shorter than lines."""
    monkeypatch.setattr(files, "_CHUNK", 11)
    body = HEADER3 + EPOCH1 + EPOCH2
    cuts = [0, 3, 700, 701, len(body)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / f"part-{i:05d}.txt").write_text(body[a:b])
    whole = list(rinex.observation_rows(iter(body.split("\n"))))
    for size in (1, 7, 64, 250, 10_000):
        assert ranged(tmp_path, size)[0] == whole


def test_ranges_at_every_byte_of_version_2(tmp_path):
    """Continued lists of satellites, several lines a satellite, comments within, and values that look like nothing else."""
    prns = [f"G{k:02d}" for k in range(1, 15)]

    def epoch(second, names, flag=0):
        lists = ["".join(names[k : k + 12]) for k in range(0, len(names), 12)]
        head = f" 21  7  4  9 12{second:11.7f}  {flag}{len(names):3d}" + lists[0].ljust(36) + ("   0.123456789" if second == 3 else "")
        rows = [f"{k + second * 100 + j:14.3f}  " for k in range(len(names)) for j in range(6)]
        lines = ["".join(rows[6 * k : 6 * k + 5]) + "\n" + rows[6 * k + 5] for k in range(len(names))]
        return "\n".join([head, *[" " * 32 + x for x in lists[1:]], *lines]) + "\n"

    event = " " * 28 + "4  2\n" + f"{' 21  7  4 a comment':60}COMMENT\n" + f"{'more':60}COMMENT\n"
    head = f"{'     2.11':20}{'OBSERVATION DATA':20}{'M':20}RINEX VERSION / TYPE\n{'     6    C1    L1    S1    C2    L2    S2':60}# / TYPES OF OBSERV\n{'':60}END OF HEADER\n"
    body = head + epoch(1, prns[:3]) + epoch(2, prns) + event + epoch(3, prns[:2]) + epoch(4, prns[:2], 1) + epoch(5, ["G07", "R 9"])
    (tmp_path / "b.21o").write_text(body)
    whole = list(rinex.observation_rows(iter(body.split("\n"))))
    assert len(whole) == 6 * (3 + 14 + 2 + 2)
    for size in [*range(1, 60), *range(60, len(body) + 2, 7)]:
        assert ranged(tmp_path / "b.21o", size)[0] == whole


def test_ranges_leave_compressed_files_whole(spark, tmp_path):
    (tmp_path / "c.rnx.gz").write_bytes(gzip.compress((HEADER3 + EPOCH1).encode()))
    (tmp_path / "d.rnx").write_text(HEADER3 + EPOCH1 + EPOCH2)
    (tmp_path / "e.txt").write_text("no header\n" * 50)
    parts = files.file_ranges(str(tmp_path), 100, 1)
    assert sum(p.name.endswith(".gz") for p in parts) == 1 and sum(p.name.endswith("d.rnx") for p in parts) > 5
    got = rinex.read_observations(spark, str(tmp_path), permissive=True, range_bytes=100)
    assert got.rdd.getNumPartitions() == len(parts) and got.count() == 10 + 10 + 6
    assert got.where("prn = 'G01' and t_ms > %d" % START).count() == 4
    with pytest.raises(PySparkException):
        rinex.read_observations(spark, str(tmp_path / "e.txt"), range_bytes=100).count()


def modern():
    num = lambda *xs: "".join(" " * 19 if x is None else f"{x:19.12E}".replace("E", "D") for x in xs)
    at = "2024 01 01 02 00 00"
    head = f"{4.01:9.2f}           {'NAVIGATION DATA':<20}{'M: Mixed':<20}RINEX VERSION / TYPE\n{18:6d}{'':54}LEAP SECONDS\n{'':60}END OF HEADER\n"
    n = list(range(1, 40))
    sto = f"> STO G05 LNAV\n    {at} {'GPUT':<18} {'':<18} {'UTC(USNO)':<18}\n    " + num(*n[:4])
    eop = f"> EOP J01 CNAV\n    {at}" + num(*n[:3]) + "\n    " + num(None, *n[3:6]) + "\n    " + num(*n[6:10])
    ion = f"> ION E11 IFNV\n    {at}" + num(*n[:3]) + "\n    " + num(n[3])
    bdgim = f"> ION C20 CNVX\n    {at}" + num(*n[:3]) + "\n    " + num(*n[3:7]) + "\n    " + num(*n[7:9])
    cnv1 = f"> EPH C20 CNV1\nC20 {at}" + num(*n[:3]) + "".join("\n    " + num(*n[a : a + 4]) for a in range(3, 39, 4))
    return head + "\n".join([sto, eop, navigation(4.01).split("HEADER\n")[1].rstrip(), ion, bdgim, cnv1]) + "\n"


def test_records_of_version_4(spark):
    texts = spark.createDataFrame([("m", modern()), ("none", "no header\n"), ("null", None)], "file string, text string")
    got = {(r.kind, r.prn): r for r in nav.named_numbers(nav.navigation(texts)).collect()}
    assert set(got) == {("HEAD", None), ("STO", "G05"), ("EOP", "J01"), ("EPH", "G05"), ("ION", "E11"), ("ION", "C20"), ("EPH", "C20")}
    assert got["STO", "G05"].label == "GPUT" and got["STO", "G05"].fields == {"sent": 1.0, "a0": 2.0, "a1": 3.0, "a2": 4.0} and got["STO", "G05"].t_ms == 1704074400000
    assert got["EOP", "J01"].fields == {"xp": 1, "xpDot": 2, "xpDotDot": 3, "yp": 4, "ypDot": 5, "ypDotDot": 6, "sent": 7, "dut1": 8, "dut1Dot": 9, "dut1DotDot": 10}
    assert got["ION", "E11"].fields == {"ai0": 1, "ai1": 2, "ai2": 3, "flags": 4} and got["ION", "C20"].fields["alpha9"] == 9 and got["EPH", "G05"].fields["sqrtA"] == 11
    assert (got["EPH", "C20"].fields["aDot"], got["EPH", "C20"].fields["svHealth"], got["EPH", "C20"].fields["iode"]) == (4, 33, 39) and got["HEAD", None].numbers == [18.0]
    assert [r.prn for r in rinex.ephemerides(texts).collect()] == ["G05"]  # the other ephemeris has a newer layout


@pytest.mark.parametrize("version", [2.11, 3.04, 4.01, "modern"])
def test_navigation_ranges_at_every_byte(tmp_path, version):
    body = modern() if version == "modern" else navigation(version) + 2 * (navigation(version).split("HEADER\n")[1].replace("02 00 00", "04 00 00").replace(" 2  0  0.0", " 4  0  0.0"))
    (tmp_path / "n.rnx").write_text(body)
    rows = lambda size: [r for part in files.file_ranges(str(tmp_path / "n.rnx"), size, 1) for r in nav.range_rows(part)]
    whole = rows(len(body) - 1)
    assert len(whole) == (7 if version == "modern" else 3) and whole == rows(len(body) // 2)
    for size in [*range(1, 90), *range(90, len(body), 13)]:
        assert rows(size) == whole
    one = [r[1:] for r in rows(len(body) + 1)]  # as a whole, where places are numbers of lines
    assert one == [r[1:] for r in whole]


def test_terms_of_several_headers(spark):
    line = lambda content, label: f"{content:60}{label}\n"
    first = line(f"{3.04:9.2f}           N", "RINEX VERSION / TYPE")
    a = first + line("GPSA   0.1000D-07  0.2000D-07", "IONOSPHERIC CORR") + line("", "LEAP SECONDS") + line("", "END OF HEADER")
    b = first + line("GPSA   0.9000D-07", "IONOSPHERIC CORR") + line("GAL    1.0000D+00", "IONOSPHERIC CORR") + line("    18", "LEAP SECONDS") + line(f"GPUT {1e-9:17.10E}{2e-15:16.9E}{405504:7d}{2295:5d}".replace("E-", "D-"), "TIME SYSTEM CORR") + line("", "END OF HEADER")
    records = nav.navigation(spark.createDataFrame([("b", b), ("a", a)], "file string, text string"))
    got = {r.label: r.numbers for r in nav.merged_terms(records).collect()}
    assert got["GPSA"] == [1e-8, 2e-8, None, None] and got["GAL"][0] == 1.0 and got["LEAP SECONDS"] == [18.0] and set(got) == {"GPSA", "GAL", "LEAP SECONDS", "GPUT"}
    assert got["GPUT"] == [1e-9, 2e-15, 405504.0, 2295.0]
    assert {r.label: r.numbers for r in nav.merged_terms(records, ["b", "a"]).collect()}["GPSA"][0] == 9e-8
