"""Queries that pack rows of the driver's tables into binary messages and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanax.session import load, save_table, spread
from almanax.sources import bits, rtcm
from almanax.streaming import live

#: Fields of the ephemeris messages that the query returns, and the most by which a system numbers its satellites.
_SHOWN = ("af0", "sqrtA", "m0", "toe", "iode", "x", "vx", "az")
_WHOLE = ("health", "week", "tb")
_KINDS = tuple(rtcm.LAYOUTS)


def _raw(name: str, j: int, size: int, signed: int) -> tuple[int, int, int]:
    """factor, modulus and offset of a field's number: k * factor % modulus + offset."""
    if name == "n":
        return 1, 10, 1
    b = min(size, 30)
    return 7919 * (2 * j + 3), (1 << b) - (signed == 2), 1 - (1 << b - 1) if signed == 2 else -(1 << b - 1) if signed and b == size else 0


def _damaged(frame: Column, key: Column) -> Column:
    """Every eleventh frame with another last byte."""
    last = F.substr(frame, F.length(frame), F.lit(1))
    other = F.unhex(F.lpad(F.hex(bits.number(last, 1, 1).bitwiseXOR(F.lit(1))), 2, "0"))
    return F.when(key % 11 == 0, F.unhex(F.concat(F.hex(F.substr(frame, F.lit(1), F.length(frame) - 1)), F.hex(other)))).otherwise(frame)


def frame_ephemerides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's number packed into each field of one of the seven ephemeris messages, framed, and read; damaged frames go."""
    k = F.col("k")
    orders = spread(load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k")), "k")
    payload = F.lit(None).cast("binary")
    for i, message in enumerate(_KINDS):
        numbers = {}
        for j, (name, size, signed, _) in enumerate(rtcm.LAYOUTS[message][1]):
            factor, modulus, offset = _raw(name, j, size, signed)
            numbers[name] = k * factor % modulus + offset
        payload = F.when(k % len(_KINDS) == i, rtcm.pack_ephemeris(message, numbers)).otherwise(payload)
    frames = orders.select("k", payload.alias("payload")).select("k", bits.framed(F.col("payload")).alias("frame")).select("k", _damaged(F.col("frame"), k).alias("frame"))
    frames = save_table(frames, "frames")
    read = rtcm.expanded(frames.select("k", bits.payload(F.col("frame")).alias("payload")), rtcm.ephemeris(F.col("payload")), "k")
    return read.select("k", "prn", "message_type", "system", *_WHOLE, "freq", *_SHOWN)


def _station_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, mountpoint, arrival and frame of two messages per customer: where a station is, and what it has."""
    k = F.col("k")
    c = spread(load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), "c_name", "c_mktsegment"), "k")
    metres = lambda factor: (k * factor % 200_000_001 - 100_000_000) * F.lit(0.0001)
    at = [k % 4096, k % 64, metres(7919), metres(104_729), metres(15_485_863)]
    place = F.when(k % 3 == 0, rtcm.pack_station(*at)).otherwise(rtcm.pack_station(*at, (k % 65_536) * F.lit(0.0001)))
    texts = {"antenna": F.concat(F.lit("ANT "), "c_mktsegment"), "antenna_serial": k.cast("string"), "receiver": F.col("c_name"), "firmware": F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("1.0"))}
    each = F.explode(F.array(F.struct(F.lit(0).alias("i"), place.alias("payload")), F.struct(F.lit(1).alias("i"), rtcm.pack_description(k % 4096, texts, k % 256).alias("payload")))).alias("m")
    rows = c.select("k", F.concat(F.lit("M"), (k % 50).cast("string")).alias("mountpoint"), F.timestamp_millis(1_704_067_200_000 + k * 1000).alias("arrival"), each)
    frames = rows.select("k", "mountpoint", "arrival", "m.i", bits.framed(F.col("m.payload")).alias("frame"))
    return save_table(frames.select("k", "mountpoint", "arrival", _damaged(F.col("frame"), k + F.col("i")).alias("frame")), "frames")


def _payloads(frames: DataFrame) -> DataFrame:
    # a generator, as Spark else checks each frame once more for the filter
    rest = [c for c in frames.columns if c != "frame"]
    return frames.select(*rest, F.explode(F.filter(F.array(bits.payload(F.col("frame"))), lambda p: p.isNotNull())).alias("payload"))


def frame_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference points of messages 1005 and 1006, and descriptions of 1033, each as it is read."""
    read = _payloads(_station_frames(spark, sf_dir)).select("k", rtcm.kind(F.col("payload")).alias("message_type"), rtcm.station(F.col("payload")).alias("p"), rtcm.description(F.col("payload")).alias("d"))
    rest = [c for c in rtcm.DESCRIPTION if c != "receiver_serial"]
    return read.select("k", "message_type", F.coalesce("p.station", "d.station").alias("station"), *[f"p.{c}" for c in ("itrf", "x", "y", "z", "height")], *[f"d.{c}" for c in rest], "d.setup")


def station_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last reference point and description of each mountpoint's stations."""
    return live.stations(_payloads(_station_frames(spark, sf_dir))).drop("receiver_serial")


def frame_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, bytes and rate of each mountpoint and message type."""
    frames = _payloads(_station_frames(spark, sf_dir)).select("mountpoint", "arrival", rtcm.kind(F.col("payload")).alias("message_type"), F.length("payload").alias("length"))
    out = live.statistics(frames)
    return out.select("mountpoint", "message_type", "frames", "bytes", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), F.round("rate", 9).alias("rate"))


QUERIES = {f.__name__: f for f in (frame_ephemerides, frame_stations, station_metadata, frame_statistics)}


def _of_kind(message: int, name: str) -> str | None:
    for j, (field, size, signed, scale) in enumerate(rtcm.LAYOUTS[message][1]):
        if field == name:
            factor, modulus, offset = _raw(name, j, size, signed)
            return f"(k * {factor} % {modulus} + {offset})" + (f" * {float(scale)!r}::DOUBLE" if scale != 1 else "")
    return None


def _case(name: str, kind: str, more: str = "") -> str:
    found = [(i, _of_kind(m, name)) for i, m in enumerate(_KINDS)]
    return f"CAST(CASE k % {len(_KINDS)} " + " ".join(f"WHEN {i} THEN {x}{more}" for i, x in found if x) + f" END AS {kind})"


_PLACE = "(k * {f} % 200000001 - 100000000) * 0.0001::DOUBLE"
_STATIONS = f"""c AS (SELECT c_custkey::BIGINT AS k, c_name, c_mktsegment FROM customer),
p AS (SELECT k, CASE WHEN k % 3 = 0 THEN 1005 ELSE 1006 END AS message_type, CAST(k % 4096 AS INT) AS station, CAST(k % 64 AS INT) AS itrf, {_PLACE.format(f=7919)} AS x, {_PLACE.format(f=104729)} AS y, {_PLACE.format(f=15485863)} AS z,
             CASE WHEN k % 3 <> 0 THEN (k % 65536) * 0.0001::DOUBLE END AS height FROM c WHERE k % 11 <> 0),
d AS (SELECT k, 1033 AS message_type, CAST(k % 4096 AS INT) AS station, 'ANT ' || c_mktsegment AS antenna, k::VARCHAR AS antenna_serial, c_name AS receiver, CASE WHEN k % 5 = 0 THEN '' ELSE '1.0' END AS firmware, CAST(k % 256 AS INT) AS setup FROM c WHERE (k + 1) % 11 <> 0)"""
#: Bytes of a frame: header and check, and of a description its texts.
_SIZES = "z AS (SELECT k, message_type, CASE message_type WHEN 1005 THEN 25 ELSE 27 END AS n FROM p UNION ALL SELECT k, 1033, 6 + 3 + 6 + strlen(antenna) + strlen(antenna_serial) + strlen(receiver) + strlen(firmware) FROM d)"

ORACLE_SQL = {
    "frame_ephemerides": f"""WITH o AS (SELECT o_orderkey::BIGINT AS k FROM orders WHERE o_orderkey % 11 <> 0),
s AS (SELECT k, substr('{"".join(s for s, _ in rtcm.LAYOUTS.values())}', CAST(k % {len(_KINDS)} + 1 AS INT), 1) AS system FROM o)
SELECT k, system || lpad((k % 10 + 1 + CASE system WHEN 'S' THEN 20 ELSE 0 END)::VARCHAR, 2, '0') AS prn, CASE k % {len(_KINDS)} {" ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(_KINDS))} END AS message_type, system,
  {", ".join(f"{_case(c, 'INT')} AS {c}" for c in _WHOLE)}, {_case("freq", "INT", " - 7")} AS freq,
  {", ".join(f'{_case(c, "DOUBLE")} AS "{c}"' for c in _SHOWN)} FROM s""",
    "frame_stations": f"""WITH {_STATIONS}
SELECT k, message_type, station, itrf, x, y, z, height, NULL AS antenna, NULL AS antenna_serial, NULL AS receiver, NULL AS firmware, NULL AS setup FROM p
UNION ALL SELECT k, message_type, station, NULL, NULL, NULL, NULL, NULL, antenna, antenna_serial, receiver, firmware, setup FROM d""",
    "station_metadata": f"""WITH {_STATIONS}, pp AS (SELECT 'M' || (k % 50) AS mountpoint, station, max_by(struct_pack(itrf := itrf, x := x, y := y, z := z, height := height), k) AS p FROM p GROUP BY ALL),
dd AS (SELECT 'M' || (k % 50) AS mountpoint, station, max_by(struct_pack(antenna := antenna, antenna_serial := antenna_serial, receiver := receiver, firmware := firmware, setup := setup), k) AS d FROM d GROUP BY ALL)
SELECT mountpoint, station, p.itrf AS itrf, p.x AS x, p.y AS y, p.z AS z, p.height AS height, d.antenna AS antenna, d.antenna_serial AS antenna_serial, d.receiver AS receiver, d.firmware AS firmware, d.setup AS setup
FROM pp FULL JOIN dd USING (mountpoint, station)""",
    "frame_statistics": f"""WITH {_STATIONS}, {_SIZES}
SELECT 'M' || (k % 50) AS mountpoint, message_type, count(*) AS frames, CAST(sum(n) AS BIGINT) AS bytes, min(1704067200000 + k * 1000) AS first_ms, max(1704067200000 + k * 1000) AS last_ms,
  round(CASE WHEN max(k) > min(k) THEN count(*) / (max(k) - min(k))::DOUBLE END, 9) AS rate FROM z GROUP BY ALL""",
}
