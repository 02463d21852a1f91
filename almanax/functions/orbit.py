"""Satellite positions from broadcast ephemerides, and dilution of precision."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanax.functions.geodesy import az_el, ecef_to_geodetic
from almanax.functions.timescales import gps_utc, time_of_week
from almanax.operators.asof import LONG_AGE, max_age, nearest

#: Gravity and rotation of the Earth by interface document; fixed values.
MU = {"G": 3.986005e14, "J": 3.986005e14, "I": 3.986005e14, "E": 3.986004418e14, "C": 3.986004418e14}
OMEGA_E = {"G": 7.2921151467e-5, "J": 7.2921151467e-5, "I": 7.2921151467e-5, "E": 7.2921151467e-5, "C": 7.292115e-5}
HALF_WEEK, WEEK = 302_400.0, 604_800.0
KEPLER_FIELDS = ("sqrtA", "e", "m0", "deltaN", "omega0", "omegaDot", "i0", "idot", "omega", "cuc", "cus", "crc", "crs", "cic", "cis", "toe")
STATE_FIELDS = ("x", "y", "z", "vx", "vy", "vz", "ax", "ay", "az")
#: PZ-90: gravity, equatorial radius in km, second zonal term, rotation; fixed values.
PZ_MU, PZ_A, PZ_J2, PZ_OMEGA = 398600.4418, 6378.136, 1.0826257e-3, 7.2921151467e-5
BEIDOU_GEO = (*range(1, 6), *range(59, 64))


def _one(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _by_system(sys: Column, table: dict) -> Column:
    out = F.lit(table["G"])
    for k in ("E", "C"):
        if table[k] != table["G"]:
            out = F.when(sys == k, F.lit(table[k])).otherwise(out)
    return out


def kepler_position(eph: Column, sys: Column, prn: Column, tow: Column, rounds: int = 8) -> Column:
    """struct x, y, z in metres at a time of week in seconds of the ephemeris' own system.

    Kepler's equation is solved by a fixed number of Newton steps, folded over an array. BeiDou's geostationary satellites get the
    extra rotations of their interface document.
    """
    mu, rate = _by_system(sys, MU), _by_system(sys, OMEGA_E)
    d = tow - eph["toe"]
    tk = F.when(d > HALF_WEEK, d - WEEK).when(d < -HALF_WEEK, d + WEEK).otherwise(d)
    a = eph["sqrtA"] * eph["sqrtA"]
    mean = eph["m0"] + (F.sqrt(mu / (a * a * a)) + eph["deltaN"]) * tk

    def at_anomaly(m: Column) -> Column:
        newton = lambda big, _: big - (big - eph["e"] * F.sin(big) - m) / (1 - eph["e"] * F.cos(big))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), m, newton)

    def place(p: Column) -> Column:
        nu = F.atan2(F.sqrt(1 - eph["e"] * eph["e"]) * F.sin(p["E"]), F.cos(p["E"]) - eph["e"])
        return _one(F.struct(p["tk"].alias("tk"), p["a"].alias("a"), p["E"].alias("E"), (nu + eph["omega"]).alias("phi")), corrected)

    def corrected(p: Column) -> Column:
        s2, c2 = F.sin(2 * p["phi"]), F.cos(2 * p["phi"])
        u = p["phi"] + eph["cus"] * s2 + eph["cuc"] * c2
        r = p["a"] * (1 - eph["e"] * F.cos(p["E"])) + eph["crs"] * s2 + eph["crc"] * c2
        i = eph["i0"] + eph["idot"] * p["tk"] + eph["cis"] * s2 + eph["cic"] * c2
        n = F.substring(prn, 2, 9).cast("int")
        geo = (sys == "C") & n.isin(*BEIDOU_GEO)
        turn = F.when(geo, eph["omegaDot"]).otherwise(eph["omegaDot"] - rate)
        node = eph["omega0"] + turn * p["tk"] - rate * eph["toe"]
        return _one(F.struct((r * F.cos(u)).alias("x"), (r * F.sin(u)).alias("y"), i.alias("i"), node.alias("o"), geo.alias("geo"), (rate * p["tk"]).alias("w")), to_earth)

    def to_earth(p: Column) -> Column:
        x = p["x"] * F.cos(p["o"]) - p["y"] * F.cos(p["i"]) * F.sin(p["o"])
        y = p["x"] * F.sin(p["o"]) + p["y"] * F.cos(p["i"]) * F.cos(p["o"])
        z = p["y"] * F.sin(p["i"])
        return _one(F.struct(x.alias("x"), y.alias("y"), z.alias("z"), p["geo"].alias("geo"), p["w"].alias("w")), stationary)

    def stationary(p: Column) -> Column:
        c, s = math.cos(math.radians(-5.0)), math.sin(math.radians(-5.0))
        y1, z1 = p["y"] * c + p["z"] * s, p["z"] * c - p["y"] * s
        turned = F.struct((p["x"] * F.cos(p["w"]) + y1 * F.sin(p["w"])).alias("x"), (y1 * F.cos(p["w"]) - p["x"] * F.sin(p["w"])).alias("y"), z1.alias("z"))
        return F.when(p["geo"], turned).otherwise(F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))

    return _one(F.struct(tk.alias("tk"), a.alias("a"), at_anomaly(mean).alias("E")), place)


def _motion(s: np.ndarray, acc: np.ndarray) -> np.ndarray:
    """Derivative of positions and velocities (km, km/s) in the rotating frame."""
    x, y, z, vx, vy, vz = s
    r2 = x * x + y * y + z * z
    r = np.sqrt(r2)
    g, k = PZ_MU / (r2 * r), 1.5 * PZ_J2 * PZ_A**2 / r2
    f = 5 * z * z / r2
    return np.array([vx, vy, vz, -g * x * (1 + k * (1 - f)) + PZ_OMEGA**2 * x + 2 * PZ_OMEGA * vy + acc[0], -g * y * (1 + k * (1 - f)) + PZ_OMEGA**2 * y - 2 * PZ_OMEGA * vx + acc[1], -g * z * (1 + k * (3 - f)) + acc[2]])


_XYZ = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])


@F.arrow_udf(_XYZ)
def state_vector_position(state: pa.Array, dt: pa.Array) -> pa.Array:
    """Metres, dt seconds from a state vector in km: Runge-Kutta steps of at most a minute, forwards or backwards, for a batch at once."""
    n = len(state)
    cols = [state.field(f).to_numpy(zero_copy_only=False).astype(float) for f in STATE_FIELDS]
    s, acc, left = np.array(cols[:6]), np.array(cols[6:]), dt.to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(all="ignore"):
        for _ in range(int(np.ceil(np.nanmax(np.abs(left), initial=0) / 60))):
            h = np.clip(left, -60, 60)
            k1 = _motion(s, acc)
            k2 = _motion(s + h / 2 * k1, acc)
            k3 = _motion(s + h / 2 * k2, acc)
            k4 = _motion(s + h * k3, acc)
            s = s + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
            left = left - h
    bad = ~np.isfinite(s[:3]).all(axis=0)
    return pa.StructArray.from_arrays([pa.array(s[i] * 1000, mask=bad) for i in range(3)], names=list("xyz")) if n else pa.array([], pa.struct([(c, pa.float64()) for c in "xyz"]))


def satellite_positions(times: DataFrame, eph: DataFrame, receiver: tuple[float, float, float] | None = None) -> DataFrame:
    """t_ms, prn, x, y, z, lat, lon and, if a receiver (ECEF) is given, az and el.

    times: t_ms, in GPS time. eph: prn, sys, toc_ms, ord, healthy, kepler (struct) and state (struct); one of them NULL. A time
    takes the nearest ephemeris young enough; without one there is no row. A receiver at the origin counts as none.
    """
    prns = eph.select("prn").distinct()
    grid = times.select("t_ms").crossJoin(prns)
    age = max_age(F.substring("_k", 1, 1))
    found = nearest(grid, eph, "prn", "t_ms", "toc_ms", LONG_AGE, [F.col("ord")], ["toc_ms", "kepler", "state"], age).where("best is not null")
    sys = F.substring("prn", 1, 1)
    by_state = sys.isin("R", "S")
    shift = F.when(sys == "C", 14.0).otherwise(0.0)
    tow = time_of_week(F.col("t_ms")) / 1000 - shift
    dt = (F.col("t_ms") - F.col("best.toc_ms")) / 1000 - F.when(sys == "R", gps_utc(F.col("t_ms"))).otherwise(0)
    kepler = found.where(~by_state).withColumn("p", kepler_position(F.col("best.kepler"), sys, F.col("prn"), tow))
    state = found.where(by_state).withColumn("p", state_vector_position(F.col("best.state"), dt))
    rows = kepler.select("t_ms", "prn", "p").unionByName(state.select("t_ms", "prn", "p")).where("p.x is not null").select("t_ms", "prn", "p.*")
    rows = rows.withColumn("g", ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))).select("t_ms", "prn", "x", "y", "z", F.col("g.lat").alias("lat"), F.col("g.lon").alias("lon"))
    if receiver is None or not any(receiver):
        return rows
    rx, ry, rz = (F.lit(float(v)) for v in receiver)
    place = rows.withColumn("r", ecef_to_geodetic(rx, ry, rz))
    look = az_el(F.col("r.lat"), F.col("r.lon"), F.col("x") - rx, F.col("y") - ry, F.col("z") - rz)
    return place.withColumn("l", look).select("t_ms", "prn", "x", "y", "z", "lat", "lon", F.col("l.az").alias("az"), F.col("l.el").alias("el"))


def dilution(sky: DataFrame) -> DataFrame:
    """t_ms, satellites, gdop, pdop, hdop, vdop; NULL with fewer than four satellites or a degenerate sky.

    The 4x4 normal matrix is ten sums of products per epoch, so partial sums go into the shuffle; its inverse's diagonal is written
    out by cofactors.
    """
    e, n, u = F.cos("el") * F.sin("az"), F.cos("el") * F.cos("az"), F.sin("el")
    v = {"e": e, "n": n, "u": u, "t": F.lit(1.0)}
    names = list(v)
    sums = [F.sum(v[a] * v[b]).alias(a + b) for i, a in enumerate(names) for b in names[i:]]
    m = sky.where("el is not null and az is not null").groupBy("t_ms").agg(F.count(F.lit(1)).alias("satellites"), *sums)
    at = lambda a, b: F.col(a + b if names.index(a) <= names.index(b) else b + a)

    def minor(skip: str) -> Column:
        p, q, r = (x for x in names if x != skip)
        return at(p, p) * (at(q, q) * at(r, r) - at(q, r) * at(q, r)) - at(p, q) * (at(p, q) * at(r, r) - at(q, r) * at(p, r)) + at(p, r) * (at(p, q) * at(q, r) - at(q, q) * at(p, r))

    def determinant() -> Column:
        total = F.lit(0.0)
        for k, col in enumerate(names):
            rest = [x for x in names if x != col]
            rows = names[1:]
            b = [[at(r, c) for c in rest] for r in rows]
            det3 = b[0][0] * (b[1][1] * b[2][2] - b[1][2] * b[2][1]) - b[0][1] * (b[1][0] * b[2][2] - b[1][2] * b[2][0]) + b[0][2] * (b[1][0] * b[2][1] - b[1][1] * b[2][0])
            total += (-1) ** k * at(names[0], col) * det3
        return total

    m = m.withColumn("det", determinant())
    ok = (F.col("satellites") >= 4) & (F.abs("det") > 1e-12)
    q = {k: F.when(ok, minor(k) / F.col("det")) for k in names}
    out = m.select("t_ms", "satellites", *[c.alias(f"q{k}") for k, c in q.items()])
    root = lambda *ks: F.sqrt(sum((F.col(f"q{k}") for k in ks[1:]), F.col(f"q{ks[0]}")))
    return out.select("t_ms", "satellites", root("e", "n", "u", "t").alias("gdop"), root("e", "n", "u").alias("pdop"), root("e", "n").alias("hdop"), root("u").alias("vdop"))
