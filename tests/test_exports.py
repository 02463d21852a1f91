"""Exports that no query covers: flags, the order of live codes, tables of a report, slips of a signal, and the last ephemerides."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from almanax.operators import filters, quality
from almanax.sinks import exports
from almanax.sources import rtcm
from almanax.streaming import live


def test_flags_and_the_order_of_live_codes(spark):
    rows = [(0, "G", "G01", c, v, lli, ssi) for c, v, lli, ssi in (("L1C", 2.0, 1, 7), ("C1C", 1.0, 0, None), ("S1C", 3.0, None, None), ("D1C", 4.0, 0, 0), ("C2W", None, None, None))]
    obs = spark.createDataFrame(rows, "t_ms long, sys string, prn string, code string, value double, lli int, ssi int")
    for live_order in (False, True):
        (codes,) = [r.codes for r in exports.code_lists(obs, live_order).collect()]
        text = {r.prn: r.text for r in exports.observation_lines(obs, live_order).collect()}
        assert sorted(codes) == ["C1C", "C2W", "D1C", "L1C", "S1C"]
        cells = {c: text["G01"][3 + 16 * i : 19 + 16 * i] for i, c in enumerate(codes)}
        assert cells == {"C1C": "         1.000  ", "L1C": "         2.00017", "S1C": "         3.000  ", "D1C": "         4.000  ", "C2W": " " * 16}
        assert text[""].startswith("> 1970 01 01 00 00  0.0000000  0  1")
    assert [c[1] for c in exports.code_lists(obs, True).first().codes] == ["1", "1", "1", "1", "2"]  # band by band


def test_satellites_without_values_stay(spark):
    """A satellite goes only if its system has no code left; an epoch goes with its last satellite."""
    rows = [(0, "G", "G01", "C1C", 1.0), (0, "G", "G01", "L1C", 2.0), (0, "G", "G02", "C1C", 3.0), (0, "R", "R01", "C1C", 4.0), (30_000, "G", "G02", "C1C", 5.0), (60_000, "R", "R01", "C1C", 6.0), (90_000, "G", "G01", "L1C", None)]
    obs = spark.createDataFrame(rows, "t_ms long, sys string, prn string, code string, value double")
    kept = filters.apply_filters(obs, f := filters.FilterState(types=("C",)))
    left = filters.satellite_epochs(obs, f)
    assert {(r.t_ms, r.prn) for r in left.collect()} == {(0, "G01"), (0, "G02"), (30_000, "G02"), (90_000, "G01")}
    lines = {(r.ord, r.prn): r.text.rstrip() for r in exports.observation_lines(kept, satellites=left).collect()}
    assert lines[0, "G01"] == "G01         2.000" and lines[0, "G02"] == "G02" and lines[0, ""].endswith("  0  2") and lines[30_000, ""].endswith("  0  1") and (60_000, "") not in lines and lines[90_000, "G01"] == "G01"
    every = filters.satellite_epochs(obs, filters.FilterState(prns=("G02",), interval_s=60.0))
    assert {(r.t_ms, r.prn) for r in every.collect()} == {(0, "G01"), (0, "R01"), (60_000, "R01")}
    assert filters.satellite_epochs(obs, filters.FilterState(types=("C", "L"))).count() == 0


def test_tables_of_a_report(spark):
    one = spark.createDataFrame([(3, None, 1.5, "x")], "rows long, first long, mean double, name string")
    assert {r.name: r.value for r in exports.report_tables(one).collect()} == {"rows": "3", "first": None, "mean": "1.5", "name": "x"}
    assert exports.report_tables(one.limit(0)).count() == 0


def test_slips_of_a_signal(spark):
    slips = spark.createDataFrame([("SF 1",), ("GF 1-2",), ("MW 1-2",)], "signal string")
    assert [r.signal for r in quality.of_signal(slips, "GF 1-2 (metres)").collect()] == ["GF 1-2"] and quality.of_signal(slips.limit(0), "x").count() == 0


def test_last_ephemerides(spark):
    """One of each satellite, the last to arrive; messages of other types and broken ones are none."""
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, n, week) for i, (n, week) in enumerate([(5, 1), (5, 2), (7, 3), (5, 0)])], "i int, n int, week int")
    frames = rows.select((F.lit(t) + F.make_dt_interval(secs=F.when(F.col("i") == 3, -9).otherwise(F.col("i")))).alias("arrival"), rtcm.pack_ephemeris(1019, {"n": F.col("n"), "week": F.col("week")}).alias("payload"))
    frames = frames.unionByName(spark.createDataFrame([(t + timedelta(days=1), b"\x3f\xb0"), (t + timedelta(days=1), b""), (t, None)], "arrival timestamp, payload binary"))
    assert {(r.prn, r.week, r.message_type) for r in live.latest_ephemerides(frames).collect()} == {("G05", 2, 1019), ("G07", 3, 1019)}
