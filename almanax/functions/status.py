"""Health, groups and slots of satellites as Columns. The tables are fixed values of public interface documents and notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanax.model import lookup

#: First and last number, and digits, of each constellation's slots.
SLOTS = {"G": (1, 32, 2), "E": (1, 36, 2), "R": (1, 28, 2), "C": (1, 63, 2), "J": (1, 10, 2), "S": (120, 158, 3)}
#: Satellite block of each GPS number; fixed values.
GPS_BLOCKS = {
    1: "III", 2: "IIR", 3: "IIF", 4: "III", 5: "IIR-M", 6: "IIF", 7: "IIR-M", 8: "IIF", 9: "IIF", 10: "IIF", 11: "III", 12: "IIR-M", 13: "IIR", 14: "III", 15: "IIR-M", 16: "IIR",
    17: "IIR-M", 18: "III", 19: "IIR", 20: "IIR", 21: "III", 22: "IIR", 23: "III", 24: "IIF", 25: "IIF", 26: "IIF", 27: "IIF", 28: "III", 29: "IIR-M", 30: "IIF", 31: "IIR-M", 32: "IIF",
}
SBAS_SYSTEMS = {"EGNOS": (120, 121, 123, 124, 126, 136), "WAAS": (131, 133, 135, 138), "GAGAN": (127, 128, 140), "MSAS": (129, 137), "SDCM": (125, 141), "BDSBAS": (130, 143, 144), "KASS": (147, 148), "SPAN": (122,)}
QZSS_NAMES = {1: "QZS-1 (Block I)", 2: "QZS-2R (Block II)", 3: "QZS-3 (GEO)", 4: "QZS-4 (Block II)", 7: "QZS-1R (Block II)"}
#: Order in which a constellation's groups are listed.
GROUPS = {
    "G": ("IIR", "IIR-M", "IIF", "III"), "E": ("IOV", "FOC", "FOC (eccentric)"), "R": ("GLONASS", "GLONASS-M"), "C": ("GEO", "IGSO", "IGSO (BDS-3)", "MEO (BDS-2)", "MEO (BDS-3)", "BDS-3"), "J": ("QZO", "GEO"),
    "S": ("EGNOS", "WAAS", "GAGAN", "MSAS", "SDCM", "BDSBAS", "KASS", "SPAN"),
}
#: Meaning of the five-bit signal health of GPS, from 0; fixed values.
GPS_HEALTH = (
    "All Signals OK",
    "All Signals Weak",
    "All Signals Dead",
    "All Signals — No Data Modulation",
    "L1 P Signal Weak",
    "L1 P Signal Dead",
    "L1 P Signal — No Data Modulation",
    "L2 P Signal Weak",
    "L2 P Signal Dead",
    "L2 P Signal — No Data Modulation",
    "L1C Signal Weak",
    "L1C Signal Dead",
    "L1C Signal — No Data Modulation",
    "L2C Signal Weak",
    "L2C Signal Dead",
    "L2C Signal — No Data Modulation",
    "L1 & L2 P Signal Weak",
    "L1 & L2 P Signal Dead",
    "L1 & L2 P Signal — No Data Modulation",
    "L1 & L2C Signal Weak",
    "L1 & L2C Signal Dead",
    "L1 & L2C Signal — No Data Modulation",
    "L1 Signal Weak",
    "L1 Signal Dead",
    "L1 Signal — No Data Modulation",
    "L2 Signal Weak",
    "L2 Signal Dead",
    "L2 Signal — No Data Modulation",
    "SV Temporarily Out",
    "SV Will Be Temporarily Out",
    "Signals Deformed (URA valid)",
    "Multiple Anomalies",
)
GALILEO_HEALTH = ("Signal OK", "Signal Out of Service", "Extended Operations Mode", "Signal in Test")
QZSS_BITS = ("L1 (MSB)", "L1C/A", "L2C", "L5", "L1C", "L1C/B")


def number(prn: Column) -> Column:
    return F.substring(prn, 2, 9).try_cast("int")


def gps_block(n: Column) -> Column:
    return lookup(n, GPS_BLOCKS)


def sbas_system(n: Column) -> Column:
    out = F.lit("Other")
    for name, numbers in SBAS_SYSTEMS.items():
        out = F.when(n.isin(*numbers), name).otherwise(out)
    return out


def beidou_group(n: Column) -> Column:
    igso = n.between(6, 10) | (n == 16)
    third = n.between(19, 37) | n.between(41, 46)
    return F.when(n.between(1, 5), "GEO").when(igso, "IGSO").when(n.between(11, 14), "MEO (BDS-2)").when(n.between(38, 40), "IGSO (BDS-3)").when(third, "MEO (BDS-3)").when(n.between(56, 63), "BDS-3").otherwise("Other")


def beidou_generation(n: Column) -> Column:
    third = n.between(19, 37) | n.between(41, 46)
    second = F.when(n.between(1, 5), "BDS-2 GEO").when(n.between(6, 10) | (n == 16), "BDS-2 IGSO").when(n.between(11, 14), "BDS-2 MEO")
    return second.when(third, "BDS-3 MEO").when(n.between(38, 40), "BDS-3 IGSO").when(n.between(56, 63), "BDS-3").otherwise("—")


def galileo_group(n: Column) -> Column:
    return F.when(n.isin(14, 18), "FOC (eccentric)").when(n.isin(11, 12, 19, 20), "IOV").otherwise("FOC")


def glonass_group(sat_type: Column) -> Column:
    return F.when(sat_type == 1, "GLONASS-M").when(sat_type == 0, "GLONASS").otherwise("Unknown")


def group(prn: Column, sat_type: Column) -> Column:
    """Filter group of a satellite; NULL for systems without groups."""
    sys, n = F.substring(prn, 1, 1), number(prn)
    named = F.when(sys == "G", F.coalesce(gps_block(n), F.lit("Unknown"))).when(sys == "E", galileo_group(n)).when(sys == "R", glonass_group(sat_type)).when(sys == "C", beidou_group(n))
    return named.when(sys == "J", F.when(n == 3, "GEO").otherwise("QZO")).when(sys == "S", sbas_system(n))


def group_rank(sys: Column, name: Column) -> Column:
    """Place in the fixed order, NULL for groups that aren't listed."""
    places = F.create_map(*[F.lit(x) for s, names in GROUPS.items() for i, g in enumerate(names) for x in (s + g, i)])
    return F.try_element_at(places, F.concat(sys, name))


def healthy(prn: Column, health: Column) -> Column:
    """QZSS by its top bit, all others by 0."""
    return F.when(prn.startswith("J"), health.bitwiseAND(32) == 0).otherwise(health == 0)


def health_text(prn: Column, health: Column) -> Column:
    sys = F.substring(prn, 1, 1)
    code = health.bitwiseAND(31)
    gps = F.concat(F.when(F.shiftright(health, 5) == 0, "OK").otherwise("Bad"), F.lit(": "), lookup(code, dict(enumerate(GPS_HEALTH))))
    galileo = F.coalesce(lookup(health, dict(enumerate(GALILEO_HEALTH))), F.lit("Unknown"))
    return F.when(sys.isin("G", "J"), gps).when(sys == "E", galileo).otherwise(F.when(health == 0, "OK").otherwise("Unhealthy"))


def qzss_bits(health: Column) -> Column:
    """The signals that a QZSS satellite marks unhealthy, comma-joined."""
    return F.concat_ws(",", *[F.when(health.bitwiseAND(32 >> i) != 0, name) for i, name in enumerate(QZSS_BITS)])
