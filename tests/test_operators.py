"""Operators on small made-up observations."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from almanax.functions import geodesy, orbit, signals, timescales
from almanax.model import FREQUENCIES, SPEED_OF_LIGHT, js_round
from almanax.operators import asof, availability, filters, grid, quality, tracks

L1, L2 = SPEED_OF_LIGHT / FREQUENCIES["G"]["1"], SPEED_OF_LIGHT / FREQUENCIES["G"]["2"]
OBS = "t_ms long, sys string, prn string, code string, value double"


def smooth(n, prn="G01", start=0, jump=None, dual=True, bias=0.0):
    rows = []
    for i in range(start, start + n):
        reach = 2e7 + 800.0 * i * 30
        extra = jump[1] if jump and i >= jump[0] else 0
        values = {"C1C": reach + bias, "L1C": reach / L1 + 1e6 + extra} | ({"C2W": reach, "L2W": reach / L2 + 2e6} if dual else {})
        rows += [(i * 30_000, prn[0], prn, c, v) for c, v in values.items()]
    return rows


def test_statistics_and_grid(spark):
    rows = [(0, "G", "G01", "S1C", 42.3), (0, "G", "G03", "S1C", 38.1), (0, "R", "R01", "S1C", 35.5), (1000, "G", "G01", "S1C", 43.1), (1000, "R", "R01", "S1C", 36.2), (1000, "G", "G01", "C1C", None)]
    obs = spark.createDataFrame(rows, OBS)
    s = grid.statistics(obs).first()
    assert (s.epochs, s.duration, s.interval, s.unique_sats, s.per_system, s.mean_sats) == (2, 1.0, 1.0, 3, "G:2,R:1", 2.5)
    first = grid.grid_epochs(obs).where("t_ms = 0").first()
    assert abs(first.mean_snr - (42.3 + 38.1 + 35.5) / 3) < 1e-12 and first.total_sats == 3
    assert sum(r.n for r in grid.cn0_histogram(obs).collect()) == grid.satellite_snr(obs).count() == 5
    assert grid.statistics(obs.limit(0)).first().epochs == 0


def test_completeness(spark):
    rows = [(t, "G", "G01", "C1C", 1.0) for t in (0, 1, 2)] + [(0, "G", "G02", "C1C", 1.0), (1, "G", "G02", "C1C", 0.0), (2, "G", "G02", "C1C", None), (0, "G", "G03", "L1C", None), (1, "G", "G03", "L1C", 5.0), (2, "G", "G03", "L1C", 5.0)]
    cells = {(r.prn, r.code): (r.expected, r.present) for r in quality.completeness_cells(spark.createDataFrame(rows, OBS)).collect()}
    assert cells == {("G01", "C1C"): (3, 3), ("G02", "C1C"): (3, 1), ("G03", "L1C"): (2, 2)}
    assert quality.completeness_cells(spark.createDataFrame([], OBS)).count() == 0


def test_multipath(spark):
    mp = lambda rows, **k: quality.multipath(spark.createDataFrame(rows, OBS), 30_000, **k)
    assert mp(smooth(5)).count() == 0
    points = mp(smooth(15)).where("band = '1'").collect()
    assert len(points) == 15 and abs(sum(p.mp for p in points)) < 1e-6
    assert mp(smooth(15, dual=False)).count() == 0
    assert {r.arc for r in mp(smooth(12) + smooth(12, start=30)).collect()} == {0, 1}
    slip = spark.createDataFrame([("G01", 12 * 30_000)], "prn string, t_ms long")
    first = mp(smooth(24), slips=slip).where("band = '1'").groupBy("arc").count().collect()
    assert {r["count"] for r in first} == {12}
    assert mp([(t, s, p, c, None if c == "L2W" else v) for t, s, p, c, v in smooth(15)]).count() == 0


def test_cycle_slips(spark):
    slips = lambda rows: quality.cycle_slips(spark.createDataFrame(rows, OBS), 30_000).collect()
    assert slips(smooth(30)) == []
    assert len(slips(smooth(30, jump=(15, 100.0)))) >= 1
    (one,) = slips(smooth(10, dual=False, jump=(5, 50.0)))
    assert one.magnitude > 3 and one.t_ms == 150_000 and one.signal.startswith("SF")
    assert slips(smooth(10) + smooth(10, start=20)) == []
    obs = spark.createDataFrame(smooth(21, dual=False, jump=(20, 50.0)), OBS)
    stats = quality.slip_signals(quality.cycle_slips(obs, 30_000), obs).first()
    assert stats.slips == 1 and stats.epochs == 21 and abs(stats.rate - 1000 / 21) < 1e-9


def test_filters(spark):
    times = [0, 900, 1000, 1999, 2500, 3000, 3998, 5000]
    obs = spark.createDataFrame([(t, "G", "G01", "S1C", 1.0) for t in times], OBS)
    kept, last = [], None
    for t in times:
        if last is None or t - last >= 999:
            kept.append(t)
            last = t
    assert sorted(r.t_ms for r in filters.apply_filters(obs, filters.FilterState(interval_s=1.0)).collect()) == kept
    with pytest.raises(filters.AllDataExcluded):
        filters.require_rows(filters.apply_filters(obs, filters.FilterState(systems=("G",))))
    assert filters.FilterState(systems=("G",), prns=("R01", "R02"), start_ms=0, interval_s=1.0, signals={"G": ("1C",)}).active() == 6
    two = spark.createDataFrame([(t, "G", "G01", c, None if c == "L1C" and t else 1.0) for t in range(4) for c in ("C1C", "L1C")], OBS)
    assert {r.code for r in filters.apply_filters(two, filters.FilterState(sparse_percent=50)).collect()} == {"C1C"}


def test_nearest_ephemeris(spark):
    hour = 3_600_000
    eph = spark.createDataFrame([("G01", "G", h * hour, i, True) for i, h in enumerate((0, 2, 4))], "prn string, sys string, toc_ms long, ord long, healthy boolean")
    targets = spark.createDataFrame([("G01", int(1.5 * hour)), ("G02", 0), ("G01", 9 * hour), ("G01", 7 * hour), ("G01", hour)], "prn string, t_ms long")
    got = {(r.prn, r.t_ms / hour): r.best and r.best.toc_ms / hour for r in asof.nearest_ephemeris(targets, eph).collect()}
    assert got == {("G01", 1.5): 2, ("G02", 0): None, ("G01", 9): None, ("G01", 7): 4, ("G01", 1): 0}


def test_elevation_lookup_takes_the_later(spark):
    p = spark.createDataFrame([("G01", 0, 0.1), ("G01", 60_000, 0.2), ("G01", 120_000, 0.0)], "prn string, t_ms long, el double")
    points = spark.createDataFrame([("G01", 30_000), ("G01", 10_000), ("G01", 121_000)], "prn string, t_ms long")
    assert {r.t_ms: r.el for r in asof.elevation_lookup(points, p).collect()} == {30_000: 0.2, 10_000: 0.1, 121_000: None}


def test_availability_states(spark):
    eph = spark.createDataFrame([("G01", "G", 0, 0, True), ("G02", "G", 0, 1, False)], "prn string, sys string, toc_ms long, ord long, healthy boolean")
    nav = {r.prn: r.state for r in availability.availability(eph).where("bin = 120").collect()}
    seen = spark.createDataFrame([(30_000, "G01"), (30_000, "G03")], "t_ms long, prn string")
    both = {r.prn: r.state for r in availability.availability(eph, seen).where("bin = 120").collect()}
    assert nav == {"G01": 1, "G02": 2} and both == {"G01": 3, "G02": 2, "G03": 5}


KEPLER = {"sqrtA": 5153.6, "e": 0.01, "m0": 0.0, "deltaN": 0.0, "omega0": 0.0, "omegaDot": 0.0, "i0": 0.96, "idot": 0.0, "omega": 0.0, "cuc": 0.0, "cus": 0.0, "crc": 0.0, "crs": 0.0, "cic": 0.0, "cis": 0.0, "toe": 0.0}


def kepler(spark, tow, prn="G01", **change):
    eph = F.struct(*[F.lit(float(v)).alias(k) for k, v in {**KEPLER, **change}.items()])
    p = spark.range(1).select(orbit.kepler_position(eph, F.lit(prn[0]), F.lit(prn), F.lit(float(tow))).alias("p")).first().p
    return p.x, p.y, p.z


def test_kepler(spark):
    start = kepler(spark, 0)
    assert 25e6 < math.hypot(*start) < 28e6 and 10e6 < math.dist(start, kepler(spark, 3600)) < 20e6
    assert abs(math.hypot(*kepler(spark, 0, e=0.0)) - 5153.6**2) < 100 and math.hypot(*kepler(spark, 302500)) > 25e6
    assert math.dist(kepler(spark, 1000), kepler(spark, 1000, crs=10, crc=10, cus=1e-5, cuc=1e-5, cis=1e-5, cic=1e-5)) > 1
    assert abs(math.hypot(*kepler(spark, 1000, "C03")) - math.hypot(*kepler(spark, 1000, "C20"))) < 1e-6


def test_state_vectors(spark):
    base = {"x": 10_000.0, "y": 20_000.0, "z": 10_000.0, "vx": 1.0, "vy": -0.5, "vz": 0.3, "ax": 0.0, "ay": 0.0, "az": 0.0}
    rows = spark.createDataFrame([(0.0,), (600.0,), (-300.0,), (None,)], "dt double")
    got = [r.p for r in rows.select(orbit.state_vector_position(F.struct(*[F.lit(v).alias(k) for k, v in base.items()]), F.col("dt")).alias("p")).collect()]
    at = lambda p: (p.x, p.y, p.z)
    assert math.dist(at(got[0]), (1e7, 2e7, 1e7)) < 10 and 5e5 < math.dist(at(got[1]), at(got[0])) < 1e6 and math.hypot(*at(got[2])) > 1e7


def test_geodesy(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert abs(one(geodesy.geodetic_to_ecef(*lit(0, 0, 0))).x - 6378137) < 1e-6 and abs(one(geodesy.geodetic_to_ecef(*lit(math.pi / 2, 0, 0))).z - 6356752.314) < 1e-3
    e = one(geodesy.geodetic_to_ecef(*lit(0.7, -0.06, 500)))
    back = one(geodesy.ecef_to_geodetic(*lit(e.x, e.y, e.z)))
    assert abs(back.lat - 0.7) < 1e-11 and abs(back.lon + 0.06) < 1e-12 and abs(back.h - 500) < 1e-6
    up = one(geodesy.az_el(*lit(0, 0, 2e7, 0, 0)))
    assert abs(up.el - math.pi / 2) < 1e-9 and one(geodesy.az_el(*lit(0, 0, 0, 0, 1e6))).az < 1e-9
    v = one(geodesy.vincenty(*lit(*[math.radians(x) for x in (-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777)])))
    assert abs(v.distance - 54972.271) < 1e-3 and abs(v.initial - 306.86816) < 1e-4
    assert one(geodesy.vincenty(*lit(0.1, 0.2, 0.1, 0.2))).distance == 0 and one(geodesy.vincenty(*lit(0.0, 0.0, 0.0, math.pi - 1e-6))) is None
    assert one(geodesy.geohash(*lit(57.64911, 10.40744), 11)) == "u4pruydqqvj" and one(geodesy.maidenhead(*lit(48.14666, 11.60833))) == "JN58td"
    u = one(geodesy.utm(*lit(48.8582, 2.2945)))
    assert (u.zone, u.hemisphere) == (31, "N") and abs(u.easting - 448251.8) < 1 and abs(u.northing - 5411932.7) < 1
    assert one(geodesy.dms_text(F.lit(-0.99999999), True)) == "01°00'00.000\"S" and one(geodesy.parse_dms(F.lit("48°07'02.280\"N"), True)) == pytest.approx(48.1173) and one(geodesy.parse_dms(F.lit("98°07'02\"N"), True)) is None
    assert one(geodesy.ecef_problem(*lit(0, 0, 1))) == "x and y are both zero" and one(geodesy.ecef_problem(*lit(1, 2, 3))) is None
    assert len(one(geodesy.great_circle_points(*lit(0, 0, 0, 1)))) == 65 and len(one(geodesy.great_circle_points(*lit(0, 0, 0, 0)))) == 2


def test_times(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    ms = lambda s: int(datetime.fromisoformat(s + "+00:00").timestamp() * 1000)
    assert one(timescales.gps_week(F.lit(ms("2024-01-01T00:00:00")))) == 2295 and one(timescales.gps_utc(F.lit(ms("2024-01-01T00:00:00")))) == 18
    assert one(timescales.gps_utc(F.lit(ms("2017-01-01T00:00:17")))) == 17 and one(timescales.gps_utc(F.lit(ms("2017-01-01T00:00:18")))) == 18
    assert one(timescales.parse_date_time(F.lit("2024/02/30 1"))) is None and one(timescales.parse_date_time(F.lit("2024.03.01 12,30,15"))) == ms("2024-03-01T12:30:15")
    assert one(timescales.from_iso_week(F.lit(2020), F.lit(53), F.lit(5))) == ms("2021-01-01T00:00:00")
    d = one(timescales.difference(F.lit(90_061_000), F.lit(0)))
    assert (d.days, d.hours, d.minutes, d.seconds) == (-1, -1, -1, -1)
    near = ms("2024-03-10T12:00:00")
    for sys in "GCR":
        assert abs(one(timescales.msm_instant(F.lit(sys), F.lit(86_400_000), F.lit(near))) - near) < 7 * 86_400_000
    assert one(timescales.age_text(F.lit(125_000))) == "2m ago" and one(timescales.age_text(F.lit(5_400_000))) == "1.5h ago"
    assert one(js_round(F.lit(-2.5))) == -2


def test_dilution(spark):
    sky = lambda sats: spark.createDataFrame([(0, math.radians(a), math.radians(e)) for a, e in sats], "t_ms long, az double, el double")
    four = [(0, 30), (90, 60), (180, 20), (270, 70)]
    one = lambda s: orbit.dilution(sky(s)).first()
    assert one(four[:3]).gdop is None
    d = one(four)
    assert d.gdop >= d.pdop >= d.hdop > 0 and 1 < d.pdop < 5
    assert one(four + [(45, 40), (135, 35), (225, 50), (315, 25)]).gdop < d.gdop
    high = one([(0, 80), (90, 82), (180, 81), (270, 60)])
    assert high.vdop > high.hdop


def test_track(spark):
    rows = [("a", 0, 40.0, -3.0, 600.0, 10, 5.0, 1), ("a", 300_000, 41.0, -2.0, 800.0, 8, 10.0, 1)]
    f = spark.createDataFrame(rows, "track string, t_ms long, lat double, lon double, alt double, satellites int, speed double, quality int")
    s, p = tracks.statistics(f).first(), tracks.precision(f).first()
    assert s.fixes == 2 and s.duration == 300 and s.satellites == 9 and 1e5 < s.distance < 2e5 and abs(s.max_speed_kmh - 18.52) < 1e-9
    assert p.drms2 == pytest.approx(2 * p.h_rms) and p.v_rms > 0


def test_spectra(spark):
    db = {r.signal: r.db for r in signals.spectrum(spark, points=2001).where("abs(offset_hz) < 1").collect()}
    assert db["L1 C/A"] == pytest.approx(10 * math.log10(1 / 1.023), abs=1e-6) and db["L1 M"] == -60.0
    power = signals.spectrum(spark, 200e6, 40_000, -300.0).where("signal in ('L1 C/A', 'L1 M', 'E5', 'E1 PRS')").groupBy("signal").agg((F.sum(F.pow(10.0, F.col("db") / 10)) * (400e6 / 40_000) / 1e6).alias("p"))
    assert all(0.95 < r.p < 1.02 for r in power.collect()), power.collect()


def test_order_statistics(spark):
    values = [float(v % 97) for v in range(1000)]
    got = quality.order_statistics(spark.createDataFrame([(v,) for v in values], "mp double"), "mp", {"a": 0.005, "b": 0.5, "c": 0.995}).first()
    want = sorted(values)
    assert tuple(got) == (want[5], want[500], want[995])


def test_pages_by_collation(spark):
    names = ["zebra", "Ärger", "arger", "Arger", "ärger", "b", "B", "éclair", "eclair", "Éclair", None, "", "ab", "a c", "b"]
    frame = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r.name for k in range(5) for r in filters.page(frame, "name", k, 3, False, "i", collation="UNICODE").collect()]
    assert got == ["", "a c", "ab", "arger", "Arger", "ärger", "Ärger", "b", "b", "B", "eclair", "éclair", "Éclair", "zebra", None]
    down = [r.name for k in range(8) for r in filters.page(frame, "name", k, 2, True, "i", collation="UNICODE").collect()]
    assert down == [*got[-2::-1], None] and filters.page(frame, "name", 9, 3, collation="UNICODE").count() == 0
