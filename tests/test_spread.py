"""Work that costs much per row is dealt over all cores, also where a table is one small file."""

import gzip
from itertools import pairwise

from pyspark.sql import functions as F

from almanax.functions import geodesy
from almanax.plans import files as files_plan
from almanax.plans import messages, registry
from almanax.sinks import exports
from almanax.sources import bits, files, navigation, rinex, rtcm
from almanax.streaming import live

SF_DIR = "/root/testdata/sf0.001"


def dealt(spark, name):
    """Tasks of the stage that gives a query's rows."""
    return registry.queries()[name](spark, SF_DIR).rdd.getNumPartitions()


def test_geodesics_are_dealt_out(spark):
    assert dealt(spark, "geodesics") >= 4


def test_vincenty_stays_small(spark):
    # each figure of a turn is named from those before, and not spelt out again in all that follow
    one = F.lit(0.1)
    assert geodesy.vincenty(one, one, one, one)._jc.toString().lower().count("sqrt") < 8


def test_great_circles_are_dealt_out_and_stay_small(spark):
    one = F.lit(0.1)
    assert dealt(spark, "great_circles") >= 4
    assert geodesy.great_circle_points(one, one, one, one)._jc.toString().lower().count("sqrt") < 8


def test_checks_name_their_bytes_once(spark):
    # a term that is named for each byte is made anew for each byte
    data, n = F.expr("unhex(hex(cast(id as string)))"), lambda c: c._jc.toString().lower().count("unhex(hex")
    assert n(bits.crc24q(data)) == 1 and n(bits.framed(data)) == 1


def test_descriptions_read_each_length_once(spark):
    # lengths that name all those before them made 1,500 terms of it
    assert rtcm.description(F.col("payload"))._jc.toString().lower().count("conv") < 20


def test_frames_are_dealt_out(spark):
    for name in ("frame_ephemerides", "frame_stations"):
        assert dealt(spark, name) >= 4


def test_frames_are_checked_once(spark):
    plan = messages._payloads(spark.createDataFrame([(1, b"x")], "k long, frame binary"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("iso-8859-1") == 1


def test_stations_are_decoded_once(spark):
    frames = spark.createDataFrame([("m", None, b"x")], "mountpoint string, arrival timestamp, payload binary")
    assert live.stations(frames)._jdf.queryExecution().optimizedPlan().toString().lower().count("= 1033") <= 1


def compressed_parts(tmp_path, text, cuts):
    folder = tmp_path / "export"
    folder.mkdir()
    for i, (a, b) in enumerate(pairwise([0, *cuts, len(text)])):
        (folder / f"part-{i:05d}.txt.gz").write_bytes(gzip.compress(text[a:b].encode()))
    return str(folder)


def test_compressed_exports_are_read_by_parts(tmp_path):
    # parts that end with a line, within one, within a record, and without a byte
    head = f"{3.04:9.2f}           {'N: GNSS NAV DATA':<20}{'G: GPS':<20}RINEX VERSION / TYPE\n{'':60}END OF HEADER\n"
    record = lambda k: f"G{k:02d} 2024 01 02 03 04 {k:02d}" + f"{k:19.12e}" * 3 + "\n" + f"    {k / 8:19.12e}{k / 4:19.12e}\n" * 2
    text = head + "".join(map(record, range(1, 30)))
    n = len(record(1))
    path = compressed_parts(tmp_path, text, [len(head) + n * 3, len(head) + n * 5 + 40, len(head) + n * 5 + 50, len(head) + n * 5 + 50, len(head) + n * 9 + 83, len(text) - 7])
    parts = files.file_ranges(path, 1, 1)
    rows = lambda parts: [r[1:] for part in parts for r in navigation.range_rows(part)]
    assert len(parts) > 4 and rows(parts) == rows(files.file_ranges(path, 1 << 30)) and len(rows(parts)) == 29
    assert [x for _, x in parts[0].lines_from(0)] == text.splitlines()


def test_compressed_observations_are_read_by_parts(spark, tmp_path):
    whole = files.file_ranges(files_plan._written(files_plan._station(spark, SF_DIR), "3.04"), 1 << 30)
    text = "\n".join(line for part in whole for line in part.lines()) + "\n"
    parts = files.file_ranges(compressed_parts(tmp_path, text, [len(text) // 5, len(text) // 3, len(text) // 2]), 1, 1)
    rows = lambda parts: [r for part in parts for r in rinex.range_rows(part)]
    assert len(parts) == 4 and rows(parts) == rows(whole)


def test_navigation_texts_are_made_behind_the_shuffle(spark, monkeypatch):
    made = []
    monkeypatch.setattr(exports, "write_text", lambda rows, path, **k: made.append((rows.columns, k)))
    monkeypatch.setattr(rinex, "read_ephemerides", lambda *a: spark.createDataFrame([], "prn string, sys string, toc_ms long, healthy boolean, kepler struct<af0:double,iode:double,sqrtA:double,toe:double,tgd:double,fit:double>"))
    registry.queries()["navigation_file"](spark, SF_DIR)
    assert made[0][1].get("text") is not None and "kepler" not in made[0][0]
