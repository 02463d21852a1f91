"""Bit fields as Columns and messages both ways, against numbers cut by plain code."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from almanax.sources import bits, rtcm
from almanax.streaming import live


def cut(data, at, size, signed=0):
    raw = int.from_bytes(data) >> 8 * len(data) - at - size & (1 << size) - 1
    top = 1 << size - 1
    return (raw - 2 * top if raw >= top else raw) if signed == 1 else (top - raw if raw >= top else raw) if signed == 2 else raw


def test_fields_at_every_place(spark):
    rng = random.Random(1)
    rows = [(bytes(rng.randrange(256) for _ in range(12)),) for _ in range(20)] + [(b"\xff" * 12,), (bytes(12),)]
    places = [(at, size, signed) for at in (0, 1, 7, 8, 13, 40) for size in (1, 2, 6, 8, 13, 30, 38, 48) for signed in (0, 1, 2) if at + size <= 96]
    frame = spark.createDataFrame(rows, "data binary")
    got = frame.select("data", *[bits.bit_field(F.col("data"), *p).alias(f"c{i}") for i, p in enumerate(places)]).collect()
    for r in got:
        assert [r[f"c{i}"] for i in range(len(places))] == [cut(bytes(r.data), *p) for p in places]
    short = spark.createDataFrame([(b"\x01\x02",), (b"",), (None,)], "data binary").select(bits.bit_field(F.col("data"), 12, 5).alias("v"), bits.bit_field(F.col("data"), 0, 4).alias("w")).collect()
    assert [(r.v, r.w) for r in short] == [(None, 0), (None, None), (None, None)]


def test_checks_and_frames(spark):
    rng = random.Random(2)
    rows = [(bytes(rng.randrange(256) for _ in range(n)),) for n in (0, 1, 2, 50, 1023)]
    frame = spark.createDataFrame(rows, "data binary").select("data", bits.crc24q(F.col("data")).alias("crc"), bits.framed(F.col("data")).alias("frame"))
    got = frame.select("data", "crc", "frame", bits.payload(F.col("frame")).alias("back")).collect()
    for r in got:
        assert r.crc == rtcm.crc24q(bytes(r.data)) and r.back == r.data and rtcm.frames(bytes(r.frame)) == ([bytes(r.data)], b"")
    whole = bytes(got[3].frame)
    bad = [whole[:-1], whole + b"\x00", b"\xd2" + whole[1:], whole[:5] + b"\x01" + whole[6:], b"", b"\xd3", b"\xd3\xff\xff" + whole[3:]]
    assert all(r.p is None for r in spark.createDataFrame([(b,) for b in bad], "frame binary").select(bits.payload(F.col("frame")).alias("p")).collect())


@pytest.mark.parametrize("message", list(rtcm.LAYOUTS))
def test_ephemerides_as_columns(spark, message):
    system, layout = rtcm.LAYOUTS[message]
    rng = random.Random(message)
    size = 12 + bits.width(layout)
    rows = []
    for _ in range(15):
        body = f"{message:012b}" + "".join(rng.choice("01") for _ in range(size - 12))
        rows.append((int(body.ljust(-(-size // 8) * 8, "0"), 2).to_bytes(-(-size // 8)),))
    got = spark.createDataFrame([*rows, (rows[0][0][:-2],), (b"",), (None,)], "p binary").select("p", rtcm.ephemeris(F.col("p")).alias("e")).collect()
    assert [r.e for r in got[15:]] == [None] * 3
    for r in got[:15]:
        at, want = 12, {}
        for name, n, signed, scale in layout:
            if name:
                want[name] = cut(bytes(r.p), at, n, signed) * scale
            at += n
        n = want.pop("n") + (20 if message == 1043 else 0)
        if message == 1020:
            want["freq"] -= 7
        assert (r.e.prn, r.e.message_type, r.e.system) == (f"{system}{n:02d}", message, system)
        assert {k: r.e[k] for k in want} == want and all(r.e[k] is None for k in rtcm.EPHEMERIS_FIELDS if k not in want)


def test_packed_ephemerides(spark):
    layout = rtcm.LAYOUTS[1020][1]
    raw = {name: -5 if signed else 3 for name, _, signed, _ in layout if name}
    e = spark.range(1).select(rtcm.pack_ephemeris(1020, {k: F.lit(v) for k, v in raw.items()}).alias("p")).select(rtcm.ephemeris(F.col("p")).alias("e")).first().e
    assert e.prn == "R03" and e.freq == -4 and e.x == -5 * 2.0**-11 and e.health == 3 % 2


def test_stations(spark):
    one = spark.range(1).select(
        rtcm.pack_station(F.lit(4095), F.lit(20), F.lit(-2148744.1234), F.lit(4426641.2345), F.lit(-0.0001)).alias("a"),
        rtcm.pack_station(F.lit(7), F.lit(0), F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(1.5)).alias("b"),
        rtcm.pack_description(F.lit(7), {"antenna": F.lit("ANT ÜMLAUT"), "receiver": F.lit("RX"), "receiver_serial": F.lit("0012")}, 3).alias("c"),
    )
    r = one.select(rtcm.station(F.col("a")).alias("a"), rtcm.station(F.col("b")).alias("b"), rtcm.description(F.col("c")).alias("c"), rtcm.station(F.col("c")).alias("n"), rtcm.description(F.col("a")).alias("m"), F.length("a").alias("la"), F.length("b").alias("lb")).first()
    assert (r.a.message_type, r.a.station, r.a.itrf, r.a.height) == (1005, 4095, 20, None) and (r.a.x, r.a.y, r.a.z) == pytest.approx((-2148744.1234, 4426641.2345, -0.0001), abs=1e-9)
    assert (r.b.message_type, r.b.height, r.b.x) == (1006, 1.5, 1.0) and (r.la, r.lb) == (19, 21) and r.n is None and r.m is None
    assert (r.c.station, r.c.antenna, r.c.setup, r.c.antenna_serial, r.c.receiver, r.c.firmware, r.c.receiver_serial) == (7, "ANT ÜMLAUT", 3, "", "RX", "", "0012")
    early = one.select(F.substr("c", F.lit(1), F.length("c") - 1).alias("c"), F.substr("b", F.lit(1), F.lit(20)).alias("b")).select(rtcm.description(F.col("c")).alias("c"), rtcm.station(F.col("b")).alias("b")).first()
    assert early.c is None and early.b is None


def test_last_station_of_a_mountpoint(spark):
    t = datetime(2024, 1, 1)
    places = [(0, "M", 1.0), (1, "M", 2.0), (2, "N", 3.0)]
    rows = spark.createDataFrame(places, "i int, mountpoint string, x double").select("mountpoint", (F.lit(t) + F.make_dt_interval(secs=F.col("i"))).alias("arrival"), rtcm.pack_station(F.lit(5), F.lit(1), F.col("x"), F.col("x"), F.col("x")).alias("payload"))
    texts = spark.createDataFrame([("M", t - timedelta(days=1), "OLD"), ("M", t, "NEW")], "mountpoint string, arrival timestamp, a string").select("mountpoint", "arrival", rtcm.pack_description(F.lit(5), {"antenna": F.col("a")}).alias("payload"))
    got = {(r.mountpoint, r.station): (r.x, r.antenna) for r in live.stations(rows.unionByName(texts)).collect()}
    assert got == {("M", 5): (2.0, "NEW"), ("N", 5): (3.0, None)}
