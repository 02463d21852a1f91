"""Power spectra of navigation signals, C/N0 indicators and antenna patterns as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reference chip rate in Hz.
F0 = 1.023e6
#: Signals by their public definitions: system, band, form, subcarrier and chip rates in units of F0, centre in Hz; fixed values.
CATALOGUE = (
    ("G", "L1 C/A", "bpsk", 0, 1, 1575.42e6), ("G", "L1 P(Y)", "bpsk", 0, 10, 1575.42e6), ("G", "L1 M", "bocs", 10, 5, 1575.42e6), ("G", "L1C", "mboc", 1, 1, 1575.42e6), ("G", "L2C", "bpsk", 0, 1, 1227.60e6),
    ("G", "L2 P(Y)", "bpsk", 0, 10, 1227.60e6), ("G", "L5", "bpsk", 0, 10, 1176.45e6), ("R", "G1 C/A", "bpsk", 0, 0.5, 1602.0e6), ("R", "G2 C/A", "bpsk", 0, 0.5, 1246.0e6), ("E", "E1 OS", "mboc", 1, 1, 1575.42e6),
    ("E", "E1 PRS", "bocc", 15, 2.5, 1575.42e6), ("E", "E5", "altboc", 15, 10, 1191.795e6), ("E", "E6 CS", "bpsk", 0, 5, 1278.75e6), ("C", "B1I", "bpsk", 0, 2, 1561.098e6), ("C", "B1C", "mboc", 1, 1, 1575.42e6),
    ("C", "B2", "altboc", 15, 10, 1191.795e6), ("C", "B3I", "bpsk", 0, 10, 1268.52e6),
)


def _sinc2(x: Column) -> Column:
    a = math.pi * x
    return F.when(F.abs(x) < 1e-12, F.lit(1.0)).otherwise(F.pow(F.sin(a) / a, 2))


def bpsk(f: Column, chip: float) -> Column:
    return _sinc2(f / chip) / chip


def boc(f: Column, sub: float, chip: float, cosine: bool = False) -> Column:
    """Sine- or cosine-phased binary offset carrier."""
    even = round(2 * sub / chip) % 2 == 0
    top = F.sin(math.pi * f / chip) if even else F.cos(math.pi * f / chip)
    half = math.pi * f / (2 * sub)
    wave = 2 * F.pow(F.sin(half / 2), 2) / F.cos(half) if cosine else F.tan(half)
    value = chip * F.pow(top * wave / (math.pi * f), 2)
    return F.when(F.abs(f) < 1e-6, F.lit(0.0)).when(F.abs(F.cos(half)) < 1e-9, F.lit(None)).otherwise(value)


def altboc(f: Column, sub: float, chip: float) -> Column:
    """Constant-envelope alternating BOC with an odd ratio of 2 sub / chip."""
    h, q = math.pi * f / (2 * sub), math.pi * f / (4 * sub)
    top = F.pow(F.cos(math.pi * f / chip) / F.cos(h), 2)
    value = chip / (2 * math.pi**2 * f * f) * top * (F.pow(F.cos(h), 2) - F.cos(h) - 2 * F.cos(h) * F.cos(q) + 2)
    return F.when(F.abs(f) < 1e-6, F.lit(0.0)).when(F.abs(F.cos(h)) < 1e-9, F.lit(None)).otherwise(value)


def density(f: Column, form: str, sub: float, chip: float) -> Column:
    """Power density per Hz at an offset from the centre."""
    if form == "bpsk":
        return bpsk(f, chip * F0)
    if form == "mboc":
        return 10 / 11 * boc(f, F0, F0) + 1 / 11 * boc(f, 6 * F0, F0)
    if form == "altboc":
        return altboc(f, sub * F0, chip * F0)
    return boc(f, sub * F0, chip * F0, form == "bocc")


def spectra(offsets: DataFrame, floor_db: float = -60.0) -> DataFrame:
    """sys, signal, offset_hz and db (relative to 1/MHz, not below the floor) of every signal of the catalogue at each offset_hz."""
    f = F.col("offset_hz")

    def level(form: str, sub: float, chip: float) -> Column:
        return F.greatest(10 * F.log10(F.greatest(density(f, form, sub, chip) * 1e6, F.lit(1e-30))), F.lit(floor_db))

    every = F.array(*[F.struct(F.lit(sys).alias("sys"), F.lit(name).alias("signal"), level(form, sub, chip).alias("db")) for sys, name, form, sub, chip, _ in CATALOGUE])
    return offsets.select("offset_hz", F.inline(every)).select("sys", "signal", "offset_hz", "db")


def spectrum(spark: SparkSession, reach_hz: float = 25e6, points: int = 2000, floor_db: float = -60.0) -> DataFrame:
    """spectra at so many points, evenly over the reach to both sides."""
    axis = spark.range(points).select((-reach_hz + (F.col("id") + 0.5) * (2 * reach_hz / points)).alias("offset_hz"))
    return spectra(axis, floor_db)


def strength_indicator(cn0: Column) -> Column:
    """RINEX signal strength 1 to 9; NULL without a positive C/N0."""
    return F.when(cn0 > 0, F.least(F.lit(9), F.greatest(F.lit(1), F.floor(cn0 / 6 + 0.5))).cast("int"))


def best_signals(signals: DataFrame) -> DataFrame:
    """Per satellite the strongest positive C/N0 and its code."""
    good = signals.where("cn0 > 0")
    return good.groupBy(F.substring("prn", 1, 1).alias("sys"), "prn").agg(F.max("cn0").alias("cn0"), F.max_by("code", F.struct("cn0", "code")).alias("code"))


def pattern_extent(values: Column) -> Column:
    """struct lo, hi and sym (the larger size, 1 if there is none) of an array of phase centre variations; 0 for an empty one."""
    lo, hi = F.coalesce(F.array_min(values), F.lit(0.0)), F.coalesce(F.array_max(values), F.lit(0.0))
    size = F.greatest(F.abs(lo), F.abs(hi))
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(size > 0, size).otherwise(1.0).alias("sym"))


def pattern_at(pcv: Column, zen1: Column, dzen: Column, zenith: Column, dazi: Column, azimuth: Column) -> Column:
    """Variation of the nearest grid point; pcv has a row of zeniths per azimuth."""
    row = F.floor(F.pmod(azimuth, F.lit(360.0)) / dazi + 0.5).cast("int")
    row = F.when(row >= F.size(pcv), 0).otherwise(row)
    return F.try_element_at(F.try_element_at(pcv, row + 1), F.floor((zenith - zen1) / dzen + 0.5).cast("int") + 1)
