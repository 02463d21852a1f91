"""The tables that operators share, and the fixed dimensions of the constellations.

obs        file_id?, t_ms BIGINT, sys, prn, code, value DOUBLE: one row per epoch, satellite and code; missing is NULL.
sat_epoch  t_ms, sys, prn: satellites present at an epoch, with or without values.
eph        prn, sys, toc_ms, ord, healthy and a payload: one row per broadcast ephemeris.
positions  t_ms, prn, lat, lon, az, el in radians; no row means no position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBS = T.StructType([T.StructField("t_ms", T.LongType()), T.StructField("sys", T.StringType()), T.StructField("prn", T.StringType()), T.StructField("code", T.StringType()), T.StructField("value", T.DoubleType())])

#: Display orders of the systems; fixed values.
SYSTEM_ORDER = "GRECJIS"
CHART_ORDER = "GRECIJS"
STATUS_ORDER = "GERCJS"
SYSTEM_NAMES = {"G": "GPS", "R": "GLONASS", "E": "Galileo", "C": "BeiDou", "J": "QZSS", "I": "NavIC", "S": "SBAS"}

SPEED_OF_LIGHT = 299792458.0
#: Carrier frequencies in Hz by system and band, from the public interface documents; fixed values.
FREQUENCIES = {
    "G": {"1": 1575.42e6, "2": 1227.60e6, "5": 1176.45e6},
    "R": {"1": 1602.0e6, "2": 1246.0e6, "3": 1202.025e6, "4": 1600.995e6, "6": 1248.06e6},
    "E": {"1": 1575.42e6, "5": 1176.45e6, "6": 1278.75e6, "7": 1207.14e6, "8": 1191.795e6},
    "C": {"1": 1575.42e6, "2": 1561.098e6, "5": 1176.45e6, "6": 1268.52e6, "7": 1207.14e6, "8": 1191.795e6},
    "J": {"1": 1575.42e6, "2": 1227.60e6, "5": 1176.45e6, "6": 1278.75e6},
    "I": {"5": 1176.45e6, "9": 2492.028e6},
    "S": {"1": 1575.42e6, "5": 1176.45e6},
}
#: Steps of the GLONASS channels in Hz by band.
GLONASS_STEP = {"1": 562.5e3, "2": 437.5e3}


def lookup(key: Column, table: dict, default=None) -> Column:
    """A CASE over a fixed table."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def system_rank(sys: Column, order: str = SYSTEM_ORDER) -> Column:
    """Place of a system in a display order, from 0; unknown ones last."""
    place = F.call_function('instr', F.lit(order), sys)
    return F.when(place > 0, place - 1).otherwise(len(order))


def frequency(sys: Column, band: Column, channel: Column | None = None) -> Column:
    """Carrier frequency in Hz, NULL for unknown signals; GLONASS bands 1 and 2 take their channel if given."""
    base = lookup(F.concat(sys, band), {s + b: f for s, bands in FREQUENCIES.items() for b, f in bands.items()})
    if channel is None:
        return base
    step = lookup(band, GLONASS_STEP, 0.0)
    return F.when(sys == "R", base + F.coalesce(channel, F.lit(0)) * step).otherwise(base)


def present(value: Column) -> Column:
    """Missing, zero and NaN all count as absent in quality figures."""
    return value.isNotNull() & ~F.isnan(value) & (value != 0)


def js_round(x: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)
