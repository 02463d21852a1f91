"""RTCM 3 frames of byte streams, and their messages: ephemerides and stations as Columns of bit fields, observations in Arrow batches.

The signals of an observation message lie where its masks put them, so these are read in Python; all else is at places that a layout
fixes (see bits.py), both ways.
"""

from __future__ import annotations

import math
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanax.model import FREQUENCIES, GLONASS_STEP, SPEED_OF_LIGHT
from almanax.sources import bits

PREAMBLE, POLYNOMIAL = 0xD3, 0x1864CFB
LIGHT_MS = SPEED_OF_LIGHT / 1000
#: First message type of each system's multiple signal messages, less one; fixed values.
MSM = {1070: "G", 1080: "R", 1090: "E", 1100: "S", 1110: "J", 1120: "C", 1130: "I"}
#: Codes of the signals in a message's 32-bit mask, by place from 0; fixed values of the standard.
MSM_SIGNALS = {
    "G": {1: "1C", 2: "1P", 3: "1W", 7: "2C", 8: "2P", 9: "2W", 14: "2S", 15: "2L", 16: "2X", 21: "5I", 22: "5Q", 23: "5X", 29: "1S", 30: "1L", 31: "1X"},
    "R": {1: "1C", 2: "1P", 7: "2C", 8: "2P"},
    "E": {1: "1C", 2: "1A", 3: "1B", 4: "1X", 5: "1Z", 7: "6C", 8: "6A", 9: "6B", 10: "6X", 11: "6Z", 13: "7I", 14: "7Q", 15: "7X", 17: "8I", 18: "8Q", 19: "8X", 21: "5I", 22: "5Q", 23: "5X"},
    "S": {1: "1C", 21: "5I", 22: "5Q", 23: "5X"},
    "J": {1: "1C", 8: "6S", 9: "6L", 10: "6X", 14: "2S", 15: "2L", 16: "2X", 21: "5I", 22: "5Q", 23: "5X", 29: "1S", 30: "1L", 31: "1X"},
    "C": {1: "2I", 2: "2Q", 3: "2X", 7: "6I", 8: "6Q", 9: "6X", 13: "7I", 14: "7Q", 15: "7X", 21: "5D", 22: "5P", 23: "5X", 24: "7D", 29: "1D", 30: "1P", 31: "1X"},
    "I": {21: "5A"},
}


@cache
def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 16
        for _ in range(8):
            crc = crc << 1 ^ (POLYNOMIAL if crc & 0x800000 else 0)
        out.append(crc & 0xFFFFFF)
    return out


def crc24q(data: bytes) -> int:
    crc, table = 0, _crc_table()
    for b in data:
        crc = (crc << 8 & 0xFFFFFF) ^ table[crc >> 16 ^ b]
    return crc


def frames(data: bytes) -> tuple[list[bytes], bytes]:
    """Payloads of the whole frames, and the bytes that may begin another. Bytes between frames, and frames with a wrong check, are skipped."""
    out, at = [], data.find(PREAMBLE)
    while 0 <= at and at + 3 <= len(data):
        end = at + 6 + ((data[at + 1] & 3) << 8 | data[at + 2])
        if end > len(data):
            return out, data[at:]
        good = data[at + 1] & 0xFC == 0 and crc24q(data[at : end - 3]) == int.from_bytes(data[end - 3 : end])
        if good:
            out.append(data[at + 3 : end - 3])
        at = data.find(PREAMBLE, end if good else at + 1)
    return out, data[at:] if at >= 0 else b""


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data), 8 * len(data)

    def u(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise EOFError("a message ends early")
        return self.value >> self.left & (1 << n) - 1

    def s(self, n: int) -> int:
        x = self.u(n)
        return x - (1 << n) if x >> n - 1 else x

    def m(self, n: int) -> int:
        """Sign and magnitude."""
        sign = self.u(1)
        return -self.u(n - 1) if sign else self.u(n - 1)


def message_type(payload: bytes) -> int | None:
    return payload[0] << 4 | payload[1] >> 4 if len(payload) >= 2 else None


def lock_ms(kind: int, indicator: int) -> int:
    """Least lock time in ms of a 4-bit indicator (kinds 4 and 5) or a 10-bit one (6 and 7)."""
    if kind < 6:
        return 0 if indicator == 0 else 1 << indicator + 4
    if indicator < 64:
        return indicator
    step = min(21, indicator // 32 - 1)
    return (indicator << step) - (1 << step + 5) * (step)


def decode_msm(payload: bytes) -> dict | None:
    """System, epoch and signals of an MSM 4 to 7; None for other messages."""
    kind = message_type(payload)
    system = MSM.get(kind // 10 * 10) if kind else None
    level = kind % 10 if system else 0
    if not 4 <= level <= 7:
        return None
    b = _Bits(payload)
    b.u(12), b.u(12)
    epoch = b.u(30)
    b.u(19)
    sats = _places(b.u(64), 64, 1)
    sigs = _places(b.u(32), 32, 0)
    cells = [(s, g) for s in sats for g in sigs if b.u(1)]
    wide, n = level in (5, 7), len(sats)
    whole = [b.u(8) for _ in range(n)]
    extra = [b.u(4) for _ in range(n)] if wide else [0] * n
    part = [b.u(10) for _ in range(n)]
    rate = [b.s(14) for _ in range(n)] if wide else [0] * n
    rough = {s: ((w + p / 1024) * LIGHT_MS if w != 255 else None, r if r != -8192 else None, x) for s, w, p, r, x in zip(sats, whole, part, rate, extra, strict=True)}
    fine = level >= 6
    m = range(len(cells))
    ranges = [(b.s(20) if fine else b.s(15)) for _ in m]
    phases = [(b.s(24) if fine else b.s(22)) for _ in m]
    locks = [(b.u(10) if fine else b.u(4)) for _ in m]
    halves = [b.u(1) for _ in m]
    cn0s = [(b.u(10) / 16 if fine else float(b.u(6))) for _ in m]
    rates = [b.s(15) for _ in m] if wide else [None] * len(cells)
    out = []
    for k, (s, g) in enumerate(cells):
        code, (base, speed, info) = MSM_SIGNALS[system].get(g), rough[s]
        if code is None:
            continue
        hz = FREQUENCIES[system].get(code[0])
        if system == "R" and hz and wide and info < 14:
            hz += (info - 7) * GLONASS_STEP.get(code[0], 0.0)
        wave = SPEED_OF_LIGHT / hz if hz else None
        p = base + ranges[k] * 2.0 ** (-29 if fine else -24) * LIGHT_MS if base is not None and ranges[k] != -(1 << (19 if fine else 14)) else None
        c = (base + phases[k] * 2.0 ** (-31 if fine else -29) * LIGHT_MS) / wave if base is not None and wave and phases[k] != -(1 << (23 if fine else 21)) else None
        d = -(speed + rates[k] * 1e-4) / wave if wide and speed is not None and wave and rates[k] != -16384 else None
        number = s + (119 if system == "S" else 0)
        out.append({"prn": f"{system}{number:02d}", "code": code, "pseudorange": p, "phase": c, "doppler": d, "cn0": cn0s[k] or None, "lock_s": lock_ms(level, locks[k]) / 1000, "half_cycle": bool(halves[k]), "wavelength": wave})
    return {"message_type": kind, "system": system, "epoch_ms": epoch, "signals": out}


def _places(mask: int, width: int, first: int) -> list[int]:
    return [i + first for i in range(width) if mask >> width - 1 - i & 1]


_PI, _HALF = math.pi, lambda e: 2.0**e
#: Fields of the ephemeris messages in order: name, bits, signed, scale; "" is skipped. Fixed values of the standard.
_GPS = (
    ("n", 6, 0, 1), ("week", 10, 0, 1), ("ura", 4, 0, 1), ("", 2, 0, 1), ("idot", 14, 1, _HALF(-43) * _PI), ("iode", 8, 0, 1), ("toc", 16, 0, 16), ("af2", 8, 1, _HALF(-55)), ("af1", 16, 1, _HALF(-43)), ("af0", 22, 1, _HALF(-31)),
    ("iodc", 10, 0, 1), ("crs", 16, 1, _HALF(-5)), ("deltaN", 16, 1, _HALF(-43) * _PI), ("m0", 32, 1, _HALF(-31) * _PI), ("cuc", 16, 1, _HALF(-29)), ("e", 32, 0, _HALF(-33)), ("cus", 16, 1, _HALF(-29)), ("sqrtA", 32, 0, _HALF(-19)),
    ("toe", 16, 0, 16), ("cic", 16, 1, _HALF(-29)), ("omega0", 32, 1, _HALF(-31) * _PI), ("cis", 16, 1, _HALF(-29)), ("i0", 32, 1, _HALF(-31) * _PI), ("crc", 16, 1, _HALF(-5)), ("omega", 32, 1, _HALF(-31) * _PI),
    ("omegaDot", 24, 1, _HALF(-43) * _PI), ("tgd", 8, 1, _HALF(-31)), ("health", 6, 0, 1),
)
_GALILEO = (
    ("n", 6, 0, 1), ("week", 12, 0, 1), ("iode", 10, 0, 1), ("ura", 8, 0, 1), ("idot", 14, 1, _HALF(-43) * _PI), ("toc", 14, 0, 60), ("af2", 6, 1, _HALF(-59)), ("af1", 21, 1, _HALF(-46)), ("af0", 31, 1, _HALF(-34)),
    ("crs", 16, 1, _HALF(-5)), ("deltaN", 16, 1, _HALF(-43) * _PI), ("m0", 32, 1, _HALF(-31) * _PI), ("cuc", 16, 1, _HALF(-29)), ("e", 32, 0, _HALF(-33)), ("cus", 16, 1, _HALF(-29)), ("sqrtA", 32, 0, _HALF(-19)),
    ("toe", 14, 0, 60), ("cic", 16, 1, _HALF(-29)), ("omega0", 32, 1, _HALF(-31) * _PI), ("cis", 16, 1, _HALF(-29)), ("i0", 32, 1, _HALF(-31) * _PI), ("crc", 16, 1, _HALF(-5)), ("omega", 32, 1, _HALF(-31) * _PI),
    ("omegaDot", 24, 1, _HALF(-43) * _PI), ("tgd", 10, 1, _HALF(-32)),
)
_BEIDOU = (
    ("n", 6, 0, 1), ("week", 13, 0, 1), ("ura", 4, 0, 1), ("idot", 14, 1, _HALF(-43) * _PI), ("iode", 5, 0, 1), ("toc", 17, 0, 8), ("af2", 11, 1, _HALF(-66)), ("af1", 22, 1, _HALF(-50)), ("af0", 24, 1, _HALF(-33)), ("iodc", 5, 0, 1),
    ("crs", 18, 1, _HALF(-6)), ("deltaN", 16, 1, _HALF(-43) * _PI), ("m0", 32, 1, _HALF(-31) * _PI), ("cuc", 18, 1, _HALF(-31)), ("e", 32, 0, _HALF(-33)), ("cus", 18, 1, _HALF(-31)), ("sqrtA", 32, 0, _HALF(-19)),
    ("toe", 17, 0, 8), ("cic", 18, 1, _HALF(-31)), ("omega0", 32, 1, _HALF(-31) * _PI), ("cis", 18, 1, _HALF(-31)), ("i0", 32, 1, _HALF(-31) * _PI), ("crc", 18, 1, _HALF(-6)), ("omega", 32, 1, _HALF(-31) * _PI),
    ("omegaDot", 24, 1, _HALF(-43) * _PI), ("tgd", 10, 1, 1e-10), ("", 10, 0, 1), ("health", 1, 0, 1),
)
_QZSS = (
    ("n", 4, 0, 1), ("toc", 16, 0, 16), ("af2", 8, 1, _HALF(-55)), ("af1", 16, 1, _HALF(-43)), ("af0", 22, 1, _HALF(-31)), ("iode", 8, 0, 1), ("crs", 16, 1, _HALF(-5)), ("deltaN", 16, 1, _HALF(-43) * _PI), ("m0", 32, 1, _HALF(-31) * _PI),
    ("cuc", 16, 1, _HALF(-29)), ("e", 32, 0, _HALF(-33)), ("cus", 16, 1, _HALF(-29)), ("sqrtA", 32, 0, _HALF(-19)), ("toe", 16, 0, 16), ("cic", 16, 1, _HALF(-29)), ("omega0", 32, 1, _HALF(-31) * _PI), ("cis", 16, 1, _HALF(-29)),
    ("i0", 32, 1, _HALF(-31) * _PI), ("crc", 16, 1, _HALF(-5)), ("omega", 32, 1, _HALF(-31) * _PI), ("omegaDot", 24, 1, _HALF(-43) * _PI), ("idot", 14, 1, _HALF(-43) * _PI), ("", 2, 0, 1), ("week", 10, 0, 1), ("ura", 4, 0, 1), ("health", 6, 0, 1),
)
#: GLONASS: 2 stands for sign and magnitude.
_GLONASS = (
    ("n", 6, 0, 1), ("freq", 5, 0, 1), ("", 2, 0, 1), ("", 2, 0, 1), ("", 12, 0, 1), ("health", 1, 0, 1), ("", 1, 0, 1), ("tb", 7, 0, 15), ("vx", 24, 2, _HALF(-20)), ("x", 27, 2, _HALF(-11)), ("ax", 5, 2, _HALF(-30)), ("vy", 24, 2, _HALF(-20)),
    ("y", 27, 2, _HALF(-11)), ("ay", 5, 2, _HALF(-30)), ("vz", 24, 2, _HALF(-20)), ("z", 27, 2, _HALF(-11)), ("az", 5, 2, _HALF(-30)),
)
#: The fields of a geostationary satellite's message type 9.
_SBAS = (
    ("n", 6, 0, 1), ("iode", 8, 0, 1), ("toc", 13, 0, 16), ("ura", 4, 0, 1), ("x", 30, 1, 0.08), ("y", 30, 1, 0.08), ("z", 25, 1, 0.4), ("vx", 17, 1, 0.000625), ("vy", 17, 1, 0.000625), ("vz", 18, 1, 0.004),
    ("ax", 10, 1, 0.0000125), ("ay", 10, 1, 0.0000125), ("az", 10, 1, 0.0000625), ("af0", 12, 1, _HALF(-31)), ("af1", 8, 1, _HALF(-40)),
)
#: What follows a Galileo ephemeris: signal health and data validity, of E5a (1045) or E1-B (1046).
_TAILS = {1045: (("health", 2, 0, 1), ("", 1, 0, 1), ("", 7, 0, 1)), 1046: (("", 10, 0, 1), ("", 2, 0, 1), ("", 1, 0, 1), ("health", 2, 0, 1), ("", 1, 0, 1))}
LAYOUTS = {1019: ("G", _GPS), 1020: ("R", _GLONASS), 1042: ("C", _BEIDOU), 1043: ("S", _SBAS), 1044: ("J", _QZSS), 1045: ("E", (*_GALILEO, *_TAILS[1045])), 1046: ("E", (*_GALILEO, *_TAILS[1046]))}
#: A station's reference point; 1006 has the antenna's height as well.
_POINT = (("station", 12, 0, 1), ("itrf", 6, 0, 1), ("", 4, 0, 1), ("x", 38, 1, 0.0001), ("", 2, 0, 1), ("y", 38, 1, 0.0001), ("", 2, 0, 1), ("z", 38, 1, 0.0001))
STATIONS = {1005: _POINT, 1006: (*_POINT, ("height", 16, 0, 0.0001))}
#: Texts of a receiver and antenna description (1033), each behind its length; the antenna's set-up number stands between the first two.
DESCRIPTION = ("antenna", "antenna_serial", "receiver", "firmware", "receiver_serial")
_WHOLE = ("health", "week", "tb", "freq")
EPHEMERIS_FIELDS = sorted({name for _, layout in LAYOUTS.values() for name, *_ in layout if name not in ("", "n", *_WHOLE)})


def kind(payload: Column) -> Column:
    """A payload's message type."""
    return bits.bit_field(payload, 0, 12).cast("int")


def ephemeris(payload: Column) -> Column:
    """prn, message_type, system, health, week, tb, freq and numbers of an ephemeris message; null for others and for ones that end early."""
    out = F.lit(None)
    for message, (system, layout) in LAYOUTS.items():
        found = bits.fields(payload, layout, 12)
        found["freq"] = found["freq"] - 7 if message == 1020 else F.lit(None)
        n = found["n"] + 20 if message == 1043 else found["n"]
        numbers = [found.get(c, F.lit(None)).cast("int").alias(c) for c in _WHOLE] + [found.get(c, F.lit(None)).cast("double").alias(c) for c in EPHEMERIS_FIELDS]
        whole = F.struct(F.concat(F.lit(system), F.lpad(n.cast("string"), 2, "0")).alias("prn"), F.lit(message).alias("message_type"), F.lit(system).alias("system"), *numbers)
        out = F.when((kind(payload) == message) & (8 * F.length(payload) >= 12 + bits.width(layout)), whole).otherwise(out)
    return out


def expanded(rows: DataFrame, message: Column, *keep: str) -> DataFrame:
    """The columns keep, and the fields of a message's struct where it isn't null. A generator, as Spark else decodes it for each field."""
    return rows.select(*keep, F.inline(F.filter(F.array(message), lambda m: m.isNotNull())))


def pack_ephemeris(message: int, numbers: dict[str, Column]) -> Column:
    """The payload of an ephemeris message of the raw numbers of its fields; those not given are 0."""
    return bits.packed([(message, 12, 0), *[(numbers.get(name, 0), size, signed) for name, size, signed, _ in LAYOUTS[message][1]]])


def station(payload: Column) -> Column:
    """message_type, station, itrf, x, y, z and height (m) of 1005 and 1006; null for others and for ones that end early."""
    found = bits.fields(payload, STATIONS[1006], 12)
    enough = ((kind(payload) == 1005) & (F.length(payload) >= 19)) | ((kind(payload) == 1006) & (F.length(payload) >= 21))
    height = F.when(kind(payload) == 1006, found["height"])
    return F.when(enough, F.struct(kind(payload).alias("message_type"), *[found[c].cast("int").alias(c) for c in ("station", "itrf")], *[found[c].alias(c) for c in "xyz"], height.alias("height")))


def pack_station(station: Column, itrf: Column, x: Column, y: Column, z: Column, height: Column | None = None) -> Column:
    """The payload of a 1005, or with a height of a 1006, of metres."""
    raw = {"station": station, "itrf": itrf} | {k: F.round(v / 0.0001) for k, v in (("x", x), ("y", y), ("z", z), ("height", height)) if v is not None}
    message = 1005 if height is None else 1006
    return bits.packed([(message, 12, 0), *[(raw.get(name, 0), size, signed) for name, size, signed, _ in STATIONS[message]]])


def description(payload: Column) -> Column:
    """station, setup and the texts of DESCRIPTION of a 1033; null for others and for ones that end early."""

    def told(p: Column, k: int, at: Column, out: Column, columns: list[Column]) -> Column:
        """Each length is read once, and those before it are known."""
        if k == len(DESCRIPTION):
            return F.when((kind(p) == 1033) & F.coalesce(out, F.lit(False)), F.struct(*columns))

        def behind(size: Column) -> Column:
            text, end = F.substr(p, at + 1, size).cast("string").alias(DESCRIPTION[k]), at + size
            setup = [bits.number(p, end + 1, 1).cast("int").alias("setup")] if k == 0 else []
            return told(p, k + 1, end + (2 if k == 0 else 1), out & (F.length(p) >= end), [*columns, text, *setup])

        return bits.once(bits.number(p, at, 1).cast("int"), behind)

    return bits.once(payload, lambda p: told(p, 0, F.lit(4), F.lit(True), [bits.bit_field(p, 12, 12).cast("int").alias("station")]))


def pack_description(station: Column, texts: dict[str, Column], setup: Column | int = 0) -> Column:
    """The payload of a 1033 of texts of up to 31 bytes each."""
    hexes = [F.hex(bits.packed([(1033, 12, 0), (station, 12, 0)]))]
    for k, name in enumerate(DESCRIPTION):
        text = texts.get(name, F.lit("")).cast("binary")
        hexes += [F.lpad(F.hex(F.length(text)), 2, "0"), F.hex(text)] + ([F.hex(bits.packed([(setup, 8, 0)]))] if k == 0 else [])
    return F.unhex(F.concat(*hexes))


_SIGNAL = T.StructType([T.StructField("prn", T.StringType()), T.StructField("code", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("pseudorange", "phase", "doppler", "cn0", "lock_s")], T.StructField("half_cycle", T.BooleanType()), T.StructField("wavelength", T.DoubleType())])
MSM_TYPE = T.StructType([T.StructField("message_type", T.IntegerType()), T.StructField("system", T.StringType()), T.StructField("epoch_ms", T.LongType()), T.StructField("signals", T.ArrayType(_SIGNAL))])

def _safely(decode, payload: bytes) -> dict | None:
    """A message that ends early gives NULL, as one that can't be read."""
    try:
        return decode(payload)
    except EOFError:
        return None


@F.arrow_udf(MSM_TYPE)
def msm(payloads: pa.Array) -> pa.Array:
    signal = pa.struct([("prn", pa.string()), ("code", pa.string()), *[(n, pa.float64()) for n in ("pseudorange", "phase", "doppler", "cn0", "lock_s")], ("half_cycle", pa.bool_()), ("wavelength", pa.float64())])
    kind = pa.struct([("message_type", pa.int32()), ("system", pa.string()), ("epoch_ms", pa.int64()), ("signals", pa.list_(signal))])
    return pa.array([_safely(decode_msm, p.as_py()) if p.is_valid else None for p in payloads], kind)
