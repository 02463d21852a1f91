"""Geodesy on the WGS84 ellipsoid as Columns. Angles are radians and lengths metres unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84; fixed values.
A, INVERSE_FLATTENING = 6378137.0, 298.257223563
FLAT = 1 / INVERSE_FLATTENING
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
MEAN_RADIUS = 6371008.8
REFRACTION = 0.13


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def geodetic_to_ecef(lat: Column, lon: Column, h: Column) -> Column:
    """struct x, y, z."""
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.struct(((n + h) * F.cos(lat) * F.cos(lon)).alias("x"), ((n + h) * F.cos(lat) * F.sin(lon)).alias("y"), ((n * (1 - E2) + h) * F.sin(lat)).alias("z"))


def ecef_to_geodetic(x: Column, y: Column, z: Column, rounds: int = 3) -> Column:
    """struct lat, lon, h: Bowring's parametric latitude, refined a fixed number of times; exact at the poles too."""
    p = F.sqrt(x * x + y * y)
    ep2 = E2 / (1 - E2)
    tangent = lambda beta: F.atan2(z + ep2 * B * F.pow(F.sin(beta), 3), p - E2 * A * F.pow(F.cos(beta), 3))
    lat = tangent(F.atan2(z * A, p * B))
    for _ in range(rounds - 1):
        lat = tangent(F.atan2((1 - FLAT) * F.sin(lat), F.cos(lat)))
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    h = p * F.cos(lat) + z * F.sin(lat) - A * A / n
    return F.struct(lat.alias("lat"), F.atan2(y, x).alias("lon"), h.alias("h"))


def enu(lat: Column, lon: Column, dx: Column, dy: Column, dz: Column) -> Column:
    """struct e, n, u of an ECEF difference, seen from a geodetic place."""
    sl, cl, so, co = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    return F.struct((-so * dx + co * dy).alias("e"), (-sl * co * dx - sl * so * dy + cl * dz).alias("n"), (cl * co * dx + cl * so * dy + sl * dz).alias("u"))


def az_el(lat: Column, lon: Column, dx: Column, dy: Column, dz: Column) -> Column:
    """struct az in [0, 2 pi), el and range of an ECEF difference."""
    d = enu(lat, lon, dx, dy, dz)
    reach = F.sqrt(dx * dx + dy * dy + dz * dz)
    return F.struct(F.pmod(F.atan2(d["e"], d["n"]), F.lit(2 * math.pi)).alias("az"), F.atan2(d["u"], F.sqrt(d["e"] * d["e"] + d["n"] * d["n"])).alias("el"), reach.alias("range"))


def euclidean(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_RADIUS) -> Column:
    s = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(s > 1, 1.0).otherwise(s)))


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 12) -> Column:
    """struct distance, initial and final bearing (degrees) of the geodesic, by Vincenty's inverse formula.

    A fixed number of rounds, folded over an array, so that the expression stays small; nearly antipodal pairs, for which it
    doesn't settle, are NULL, and equal places 0.
    """
    u1, u2 = F.atan((1 - FLAT) * F.tan(lat1)), F.atan((1 - FLAT) * F.tan(lat2))
    span = lon2 - lon1
    base = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), span.alias("L"))

    def turn(k: Column, lam: Column, then) -> Column:
        """then of the figures of a turn, each of which is computed once from those before."""

        def more(p: Column, names: str, figures: dict[str, Column]) -> Column:
            return F.struct(*[p[n].alias(n) for n in names.split()], *[v.alias(n) for n, v in figures.items()])

        def sides(p: Column) -> Column:
            sin_sigma = F.sqrt(F.pow(k["c2"] * p["sin_lam"], 2) + F.pow(k["c1"] * k["s2"] - k["s1"] * k["c2"] * p["cos_lam"], 2))
            return more(p, "sin_lam", {"sin_sigma": sin_sigma, "cos_sigma": k["s1"] * k["s2"] + k["c1"] * k["c2"] * p["cos_lam"]})

        def angles(p: Column) -> Column:
            sin_alpha = F.when(p["sin_sigma"] != 0, k["c1"] * k["c2"] * p["sin_lam"] / p["sin_sigma"]).otherwise(F.lit(0.0))
            return more(p, "sin_sigma cos_sigma", {"sigma": F.atan2(p["sin_sigma"], p["cos_sigma"]), "sin_alpha": sin_alpha})

        squared = lambda p: more(p, "sin_sigma cos_sigma sigma sin_alpha", {"cos2": 1 - p["sin_alpha"] * p["sin_alpha"]})
        middle = lambda p: more(p, "sin_sigma cos_sigma sigma sin_alpha cos2", {"cos_m": F.when(p["cos2"] != 0, p["cos_sigma"] - 2 * k["s1"] * k["s2"] / p["cos2"]).otherwise(F.lit(0.0))})
        start = F.struct(F.sin(lam).alias("sin_lam"), F.cos(lam).alias("cos_lam"))
        return _once(start, lambda p: _once(sides(p), lambda q: _once(angles(q), lambda r: _once(squared(r), lambda s: _once(middle(s), then)))))

    def solve(k: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            c = lambda p: FLAT / 16 * p["cos2"] * (4 + FLAT * (4 - 3 * p["cos2"]))
            nxt = lambda p: k["L"] + (1 - c(p)) * FLAT * p["sin_alpha"] * (p["sigma"] + c(p) * p["sin_sigma"] * (p["cos_m"] + c(p) * p["cos_sigma"] * (2 * p["cos_m"] * p["cos_m"] - 1)))
            return F.struct(turn(k, state["lam"], nxt).alias("lam"), state["lam"].alias("before"))

        settled = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(k["L"].alias("lam"), F.lit(99.0).alias("before")), step)
        return _once(settled, lambda s: F.when(F.abs(s["lam"] - s["before"]) < 1e-11, turn(k, s["lam"], lambda p: finish(k, p, s["lam"]))))

    def finish(k: Column, p: Column, lam: Column) -> Column:
        u = p["cos2"] * (A * A - B * B) / (B * B)
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m = p["cos_m"]
        delta = big_b * p["sin_sigma"] * (m + big_b / 4 * (p["cos_sigma"] * (2 * m * m - 1) - big_b / 6 * m * (4 * p["sin_sigma"] * p["sin_sigma"] - 3) * (4 * m * m - 3)))
        bearing = lambda y, x: F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
        first = bearing(k["c2"] * F.sin(lam), k["c1"] * k["s2"] - k["s1"] * k["c2"] * F.cos(lam))
        last = bearing(k["c1"] * F.sin(lam), k["c1"] * k["s2"] * F.cos(lam) - k["s1"] * k["c2"])
        return F.struct((B * big_a * (p["sigma"] - delta)).alias("distance"), first.alias("initial"), last.alias("final"))

    same = (lat1 == lat2) & (lon1 == lon2)
    return F.when(same, F.struct(F.lit(0.0).alias("distance"), F.lit(0.0).alias("initial"), F.lit(0.0).alias("final"))).otherwise(_once(base, solve))


def rhumb(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_RADIUS) -> Column:
    """struct distance and bearing (degrees) of the line of constant bearing, the short way round."""
    dlon = F.pmod(lon2 - lon1 + math.pi, F.lit(2 * math.pi)) - math.pi
    stretch = F.ln(F.tan(math.pi / 4 + lat2 / 2) / F.tan(math.pi / 4 + lat1 / 2))
    q = F.when(F.abs(stretch) > 1e-12, (lat2 - lat1) / stretch).otherwise(F.cos(lat1))
    return F.struct((F.sqrt(F.pow(lat2 - lat1, 2) + q * q * dlon * dlon) * radius).alias("distance"), F.pmod(F.degrees(F.atan2(dlon, stretch)), F.lit(360.0)).alias("bearing"))


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct lat and lon of the middle of the great circle."""
    bx, by = F.cos(lat2) * F.cos(lon2 - lon1), F.cos(lat2) * F.sin(lon2 - lon1)
    lat = F.atan2(F.sin(lat1) + F.sin(lat2), F.sqrt(F.pow(F.cos(lat1) + bx, 2) + by * by))
    lon = lon1 + F.atan2(by, F.cos(lat1) + bx)
    return F.struct(lat.alias("lat"), (F.pmod(lon + math.pi, F.lit(2 * math.pi)) - math.pi).alias("lon"))


def horizon_distance(h: Column, k: float = REFRACTION) -> Column:
    """Distance to the horizon from a height, with refraction; 0 on or below the ground."""
    return F.sqrt(2 * F.greatest(h, F.lit(0.0)) * MEAN_RADIUS / (1 - k))


def utm(deg_lat: Column, deg_lon: Column) -> Column:
    """struct zone, hemisphere, easting and northing by Krueger's series to the third order; NULL beyond 84 N and 80 S."""
    lat, lon = F.radians(deg_lat), F.radians(deg_lon)
    zone = F.least(F.floor((deg_lon + 180) / 6) + 1, F.lit(60))
    zone = F.when((deg_lat >= 56) & (deg_lat < 64) & (deg_lon >= 3) & (deg_lon < 12), 32).otherwise(zone)
    svalbard = F.when(deg_lon < 9, 31).when(deg_lon < 21, 33).when(deg_lon < 33, 35).otherwise(37)
    zone = F.when((deg_lat >= 72) & (deg_lat < 84) & (deg_lon >= 0) & (deg_lon < 42), svalbard).otherwise(zone)
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    c = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(lat)) - c * F.atanh(c * F.sin(lat)))
    d = lon - F.radians(zone * 6 - 183)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east += a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north += a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = deg_lat < 0
    found = F.struct(zone.cast("int").alias("zone"), F.when(south, "S").otherwise("N").alias("hemisphere"), (500000 + 0.9996 * radius * east).alias("easting"), (F.when(south, 1e7).otherwise(0.0) + 0.9996 * radius * north).alias("northing"))
    return F.when((deg_lat <= 84) & (deg_lat >= -80), found)


def maidenhead(lat_deg: Column, lon_deg: Column) -> Column:
    """Locator of six characters."""
    x, y = F.least(lon_deg + 180, F.lit(359.999999)), F.least(lat_deg + 90, F.lit(179.999999))
    letter = lambda base, v: F.char(base + F.floor(v).cast("int"))
    digit = lambda v: F.floor(v).cast("int").cast("string")
    return F.concat(letter(65, x / 20), letter(65, y / 10), digit(x % 20 / 2), digit(y % 10), letter(97, x % 2 * 12), letter(97, y % 1 * 24))


def geohash(lat_deg: Column, lon_deg: Column, length: int = 12) -> Column:
    """Base-32 cell name: bits of longitude and latitude by turns."""
    bits = -(-5 * length // 2)
    scaled = lambda v, low, width: F.least(F.floor((v - low) / width * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
    x, y = scaled(lon_deg, -180.0, 360.0), scaled(lat_deg, -90.0, 180.0)
    letters = "0123456789bcdefghjkmnpqrstuvwxyz"
    out = []
    for k in range(length):
        value = F.lit(0).cast("long")
        for i in range(5 * k, 5 * k + 5):
            source = x if i % 2 == 0 else y
            value = value * 2 + F.shiftright(source, bits - 1 - i // 2).bitwiseAND(1)
        out.append(F.substring(F.lit(letters), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def dms(deg: Column) -> Column:
    """struct degrees, minutes and seconds of a size without its sign."""
    a = F.abs(deg)
    return F.struct(F.floor(a).cast("int").alias("d"), (F.floor(a * 60) % 60).cast("int").alias("m"), (a * 3600 - F.floor(a * 60) * 60).alias("s"))


def dms_text(deg: Column, is_lat: bool) -> Column:
    """dd°mm'ss.sss"N with three digits of degrees for longitudes; seconds that round to 60 carry."""
    ms = F.floor(F.abs(deg) * 3_600_000 + 0.5)
    d, m, s = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, ms % 60_000
    part = F.concat(F.lpad(F.floor(s / 1000).cast("string"), 2, "0"), F.lit("."), F.lpad((s % 1000).cast("string"), 3, "0"))
    ends = ("N", "S") if is_lat else ("E", "W")
    return F.concat(F.lpad(d.cast("string"), 2 if is_lat else 3, "0"), F.lit("°"), F.lpad(m.cast("string"), 2, "0"), F.lit("'"), part, F.lit('"'), F.when(deg >= 0, ends[0]).otherwise(ends[1]))


def parse_dms(text: Column, is_lat: bool) -> Column:
    """Degrees of a text like 48°07'02.280"N; NULL if it is none or out of range."""
    form = r"^\s*(\d{1,3})[°\s]\s*(\d{1,2})['′\s]\s*(\d{1,2}(?:\.\d+)?)[\"″\s]*\s*([NSEWnsew])\s*$"
    part = lambda i: F.regexp_extract(text, form, i)
    d, m, s = (part(i).try_cast("double") for i in (1, 2, 3))
    side = F.upper(part(4))
    value = (d + m / 60 + s / 3600) * F.when(side.isin("S", "W"), -1).otherwise(1)
    fits = side.isin(*(("N", "S") if is_lat else ("E", "W"))) & (m < 60) & (s < 60) & (F.abs(value) <= (90 if is_lat else 180))
    return F.when(fits, value)


def ecef_problem(x: Column, y: Column, z: Column, most_m: float = 5e7) -> Column:
    """NULL for usable coordinates, else what is wrong with them."""
    missing = x.isNull() | y.isNull() | z.isNull() | F.isnan(x) | F.isnan(y) | F.isnan(z)
    far = F.sqrt(x * x + y * y + z * z) > most_m
    return F.when(missing, "not a number").when((x == 0) & (y == 0), "x and y are both zero").when(far, "too far from the Earth")


def normalised_bearing(deg: Column) -> Column:
    return F.pmod(deg, F.lit(360.0))


def great_circle_points(lat1: Column, lon1: Column, lat2: Column, lon2: Column, segments: int = 64) -> Column:
    """Array of struct lat, lon along the great circle; equal places give both ends."""
    ends = F.array(F.struct(lat1.alias("lat"), lon1.alias("lon")), F.struct(lat2.alias("lat"), lon2.alias("lon")))
    both = F.struct(haversine(lat1, lon1, lat2, lon2, 1.0).alias("d"), *[f(v).alias(f"{n}{v_n}") for v_n, v in (("a1", lat1), ("o1", lon1), ("a2", lat2), ("o2", lon2)) for n, f in (("s", F.sin), ("c", F.cos))], ends.alias("ends"))

    def between(k: Column) -> Column:
        def at(i: Column) -> Column:
            f = i / segments
            parts = F.struct((F.sin((1 - f) * k["d"]) / F.sin(k["d"])).alias("a"), (F.sin(f * k["d"]) / F.sin(k["d"])).alias("b"))
            return _once(_once(parts, point), lambda p: F.struct(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])).alias("lat"), F.atan2(p["y"], p["x"]).alias("lon")))

        def point(p: Column) -> Column:
            x = p["a"] * k["ca1"] * k["co1"] + p["b"] * k["ca2"] * k["co2"]
            y = p["a"] * k["ca1"] * k["so1"] + p["b"] * k["ca2"] * k["so2"]
            return F.struct(x.alias("x"), y.alias("y"), (p["a"] * k["sa1"] + p["b"] * k["sa2"]).alias("z"))

        return F.when(k["d"] < 1e-12, k["ends"]).otherwise(F.transform(F.sequence(F.lit(0), F.lit(segments)), at))

    return _once(both, between)


def straight_points(lat1: Column, lon1: Column, lat2: Column, lon2: Column, segments: int = 64) -> Column:
    """Array of struct lat, lon, evenly between two places in both angles."""
    part = lambda a, b, i: a + (b - a) * i / segments
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: F.struct(part(lat1, lat2, i).alias("lat"), part(lon1, lon2, i).alias("lon")))
