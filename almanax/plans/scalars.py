"""Queries on time scales and geodesy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanax.functions import geodesy as G
from almanax.functions import timescales as T
from almanax.plans.adapter import PLACES, millis, places
from almanax.session import load


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates with the order's number of seconds added, read as GPS time."""
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (millis("o_orderdate") + F.col("o_orderkey") * 1000 % 86_400_000).alias("ms"))


_INSTANTS = "t AS (SELECT o_orderkey AS id, (epoch_us(o_orderdate) // 1000) + o_orderkey * 1000 % 86400000 AS ms FROM orders)"
_LEAP = "CASE " + " ".join(f"WHEN ms >= {(at + leap - 19) * 1000} THEN {leap - 19}" for at, leap in reversed(T.LEAPS)) + " END"
_STAMP = "strftime(make_timestamp({} * 1000), '%Y-%m-%d %H:%M:%S.%g')"


def time_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("ms")
    return _instants(spark, sf_dir).select(
        "id", T.gps_week(ms).alias("week"), T.time_of_week(ms).alias("tow_ms"), T.day_of_year(ms).alias("doy"), F.weekofyear(F.timestamp_millis(ms)).alias("week_of_year"), T.time_of_day(ms).alias("tod_ms"),
        (F.dayofweek(F.timestamp_millis(ms)) - 1).alias("weekday"), T.hour_code(ms).alias("hour_code"), T.gps_utc(ms).alias("leap"), F.round(T.modified_julian_date(ms), 9).alias("mjd"), F.round(T.mjd2000(ms), 9).alias("mjd2000"),
        T.date_time(ms).alias("gps"), T.date_time(T.utc_ms(ms)).alias("utc"), T.date_time(ms + T.TAI_GPS_MS).alias("tai"), T.rinex_epoch(ms).alias("rinex"),
    )


def glonass_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GLONASS day numbers, and the instant made from them again."""
    ms = F.col("ms")
    rows = _instants(spark, sf_dir).select("id", ms, T.glonass_n4(ms).alias("n4"), T.glonass_na(ms).alias("na"), T.time_of_day(T.utc_ms(ms) + 10_800_000).alias("moscow_tod_ms"))
    return rows.withColumn("back_ms", T.from_glonass(F.col("n4"), F.col("na"), F.col("moscow_tod_ms")))


def time_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants from week and time of week, Julian date, RINEX epoch, ISO week and UTC: each gives the instant again."""
    ms = F.col("ms")
    stamp = F.timestamp_millis(ms)
    year = F.extract(F.lit("YEAROFWEEK"), stamp)
    return _instants(spark, sf_dir).select(
        "id", T.from_week(T.gps_week(ms), T.time_of_week(ms)).alias("by_week"), T.from_julian(T.julian_date(ms)).alias("by_julian"), T.from_rinex_epoch(T.rinex_epoch(ms)).alias("by_rinex"),
        T.from_iso_week(year, F.weekofyear(stamp), F.weekday(stamp) + 1).alias("by_iso_week"), T.gps_ms_of_utc(T.utc_ms(ms)).alias("by_utc"), T.parse_date_time(F.date_format(stamp, "yyyy.MM.dd HH,mm,ss")).alias("by_text"),
    )


def time_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = o.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (millis("o_orderdate") + F.col("l_orderkey") * 7919 % 100_000_000).alias("a"), millis("l_shipdate").alias("b"))
    return rows.select("id", "line", T.difference(F.col("a"), F.col("b")).alias("d")).select("id", "line", "d.*")


def geodetic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir).withColumn("e", G.geodetic_to_ecef(F.radians("lat"), F.radians("lon"), F.col("h")))
    back = G.ecef_to_geodetic(F.col("e.x"), F.col("e.y"), F.col("e.z"))
    return p.withColumn("g", back).select("id", *[F.round(f"e.{c}", 3).alias(c) for c in "xyz"], F.round(F.degrees("g.lat"), 6).alias("lat"), F.round(F.degrees("g.lon"), 6).alias("lon"), F.round("g.h", 2).alias("h"))


def look_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Azimuth, elevation and range to a point 20,000 km above (30 N, 40 E), and its ENU components."""
    p = places(spark, sf_dir).withColumns({"lat": F.radians("lat"), "lon": F.radians("lon")})
    p = p.withColumns({"a": G.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h")), "b": G.geodetic_to_ecef(F.radians(F.lit(30.0)), F.radians(F.lit(40.0)), F.lit(2e7))})
    d = [F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz"]
    p = p.withColumns({"l": G.az_el(F.col("lat"), F.col("lon"), *d), "v": G.enu(F.col("lat"), F.col("lon"), *d)})
    return p.select("id", F.round(F.degrees("l.az"), 5).alias("az"), F.round(F.degrees("l.el"), 5).alias("el"), F.round("l.range", 2).alias("range"), *[F.round(f"v.{c}", 2).alias(c) for c in "enu"])


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each place to (48.1, 11.5): great circle, rhumb line, middle, horizon."""
    p = places(spark, sf_dir).withColumns({"la": F.radians("lat"), "lo": F.radians("lon")})
    to = F.radians(F.lit(48.1)), F.radians(F.lit(11.5))
    p = p.withColumns({"m": G.midpoint(F.col("la"), F.col("lo"), *to), "r": G.rhumb(F.col("la"), F.col("lo"), *to)})
    return p.select(
        "id", F.round(G.haversine(F.col("la"), F.col("lo"), *to), 2).alias("great_circle"), F.round("r.distance", 2).alias("rhumb"), F.round("r.bearing", 5).alias("bearing"), F.round(F.degrees("m.lat"), 5).alias("mid_lat"),
        F.round(F.degrees("m.lon"), 5).alias("mid_lon"), F.round(G.horizon_distance(F.col("h")), 2).alias("horizon"),
    )


def geodesics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vincenty distances and bearings from each place to (48.1, 11.5)."""
    p = places(spark, sf_dir).withColumns({"la": F.radians("lat"), "lo": F.radians("lon")})
    p = p.withColumn("v", G.vincenty(F.col("la"), F.col("lo"), F.radians(F.lit(48.1)), F.radians(F.lit(11.5))))
    return p.select("id", F.round("v.distance", 3).alias("distance"), F.round("v.initial", 6).alias("initial"), F.round("v.final", 6).alias("final"))


def grid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTM coordinates, Maidenhead locator and geohash of each place."""
    p = places(spark, sf_dir).withColumn("u", G.utm(F.col("lat"), F.col("lon")))
    return p.select("id", "u.zone", "u.hemisphere", F.round("u.easting", 2).alias("easting"), F.round("u.northing", 2).alias("northing"), G.maidenhead(F.col("lat"), F.col("lon")).alias("maidenhead"), G.geohash(F.col("lat"), F.col("lon")).alias("geohash"))


def dms_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitudes moved by a fraction, as text and read again."""
    p = places(spark, sf_dir).withColumn("v", F.col("lat") + (F.col("id") % 1000) / 1000)
    text = G.dms_text(F.col("v"), True)
    return p.select("id", text.alias("text"), F.round(G.parse_dms(text, True), 6).alias("back"))


QUERIES = {f.__name__: f for f in (time_scales, glonass_dates, time_inverses, time_differences, geodetic_round_trip, look_angles, distances, geodesics, grid_names, dms_texts)}

_N = "(6378137.0 / sqrt(1 - {e2} * pow(sin({a}), 2)))"
_E2 = repr(G.E2)
_R = repr(G.MEAN_RADIUS)


def _ecef(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    n = _N.format(e2=_E2, a=lat)
    return f"(({n} + {h}) * cos({lat}) * cos({lon}))", f"(({n} + {h}) * cos({lat}) * sin({lon}))", f"(({n} * (1 - {_E2}) + {h}) * sin({lat}))"


_X, _Y, _Z = _ecef("radians(lat)", "radians(lon)", "h")
_BX, _BY, _BZ = _ecef("radians(30.0)", "radians(40.0)", "2e7")
_MID = "cos(radians(48.1)) * cos(radians(11.5) - lo)", "cos(radians(48.1)) * sin(radians(11.5) - lo)"

ORACLE_SQL = {
    "time_scales": f"""WITH {_INSTANTS}, u AS (SELECT *, {_LEAP} AS leap FROM t)
        SELECT id, (ms - 315964800000) // 604800000 AS week, (ms - 315964800000) % 604800000 AS tow_ms, CAST(dayofyear(make_timestamp(ms * 1000)) AS INT) AS doy, CAST(weekofyear(make_timestamp(ms * 1000)) AS INT) AS week_of_year,
               ms % 86400000 AS tod_ms, CAST(dayofweek(make_timestamp(ms * 1000)) AS INT) AS weekday, chr(CAST(97 + ms % 86400000 // 3600000 AS INT)) AS hour_code, leap,
               round(40587 + (ms + 51184) / 86400000.0, 9) AS mjd, round((ms + 51184 - 946684800000) / 86400000.0, 9) AS mjd2000, {_STAMP.format("ms")} AS gps, {_STAMP.format("(ms - leap * 1000)")} AS utc,
               {_STAMP.format("(ms + 19000)")} AS tai, '> ' || strftime(make_timestamp(ms * 1000), '%Y %m %d %H %M %S.%g') || '0000' AS rinex FROM u""",
    "glonass_dates": f"""WITH {_INSTANTS}, u AS (SELECT *, make_timestamp((ms - ({_LEAP}) * 1000 + 10800000) * 1000) AS m FROM t),
        v AS (SELECT *, CAST(floor((year(m) - 1996) / 4) + 1 AS BIGINT) AS n4 FROM u)
        SELECT id, ms, n4, date_diff('day', make_date(CAST(1996 + (n4 - 1) * 4 AS INT), 1, 1), m::DATE) + 1 AS na, epoch_us(m) // 1000 % 86400000 AS moscow_tod_ms, ms AS back_ms FROM v""",
    "time_inverses": f"WITH {_INSTANTS} SELECT id, ms AS by_week, ms AS by_julian, ms AS by_rinex, ms // 86400000 * 86400000 AS by_iso_week, ms AS by_utc, ms // 1000 * 1000 AS by_text FROM t",
    "time_differences": """WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, (epoch_us(l_shipdate) // 1000) - (epoch_us(o_orderdate) // 1000) - l_orderkey * 7919 % 100000000 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        s AS (SELECT *, CAST(sign(d) AS BIGINT) AS g, abs(d) // 1000 AS s FROM r) SELECT id, line, g * (s // 86400) AS days, g * (s // 3600 % 24) AS hours, g * (s // 60 % 60) AS minutes, g * (s % 60) AS seconds FROM s""",
    "geodetic_round_trip": f"WITH {PLACES} SELECT id, round({_X}, 3) AS x, round({_Y}, 3) AS y, round({_Z}, 3) AS z, round(lat, 6) AS lat, round(lon, 6) AS lon, round(h, 2) AS h FROM places",
    "look_angles": f"""WITH {PLACES}, d AS (SELECT id, radians(lat) AS la, radians(lon) AS lo, {_BX} - {_X} AS dx, {_BY} - {_Y} AS dy, {_BZ} - {_Z} AS dz FROM places),
        v AS (SELECT *, -sin(lo) * dx + cos(lo) * dy AS e, -sin(la) * cos(lo) * dx - sin(la) * sin(lo) * dy + cos(la) * dz AS n, cos(la) * cos(lo) * dx + cos(la) * sin(lo) * dy + sin(la) * dz AS u FROM d)
        SELECT id, round((degrees(atan2(e, n)) + 360) % 360, 5) AS az, round(degrees(atan2(u, sqrt(e * e + n * n))), 5) AS el, round(sqrt(dx * dx + dy * dy + dz * dz), 2) AS range, round(e, 2) AS e, round(n, 2) AS n, round(u, 2) AS u FROM v""",
    "distances": f"""WITH {PLACES}, p AS (SELECT *, radians(lat) AS la, radians(lon) AS lo, radians(48.1) AS lb, radians(11.5) AS ob FROM places),
        q AS (SELECT *, (ob - lo + 3 * pi()) % (2 * pi()) - pi() AS dl, ln(tan(pi() / 4 + lb / 2) / tan(pi() / 4 + la / 2)) AS st, {_MID[0]} AS bx, {_MID[1]} AS byy FROM p)
        SELECT id, round(2 * {_R} * asin(sqrt(pow(sin((lb - la) / 2), 2) + cos(la) * cos(lb) * pow(sin((ob - lo) / 2), 2))), 2) AS great_circle,
               round({_R} * sqrt(pow(lb - la, 2) + pow((lb - la) / st * dl, 2)), 2) AS rhumb, round((degrees(atan2(dl, st)) + 360) % 360, 5) AS bearing,
               round(degrees(atan2(sin(la) + sin(lb), sqrt(pow(cos(la) + bx, 2) + byy * byy))), 5) AS mid_lat, round(degrees((lo + atan2(byy, cos(la) + bx) + 3 * pi()) % (2 * pi()) - pi()), 5) AS mid_lon,
               round(sqrt(2 * greatest(h, 0) * {_R} / 0.87), 2) AS horizon FROM q""",
    "dms_texts": f"""WITH {PLACES}, v AS (SELECT id, lat + id % 1000 / 1000.0 AS v FROM places), m AS (SELECT *, CAST(floor(abs(v) * 3600000 + 0.5) AS BIGINT) AS ms FROM v)
        SELECT id, lpad((ms // 3600000)::VARCHAR, 2, '0') || '°' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || '''' || lpad((ms % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') || '"' || CASE WHEN v >= 0 THEN 'N' ELSE 'S' END AS text,
               round(CASE WHEN v >= 0 THEN 1 ELSE -1 END * (ms / 3600000.0), 6) AS back FROM m""",
}


def _alphabet() -> str:
    return "0123456789bcdefghjkmnpqrstuvwxyz"


def _vincenty_sql(rounds: int = 12) -> str:
    """The same rounds, unrolled as one CTE each."""
    f, a, b = repr(G.FLAT), repr(G.A), repr(G.B)
    head = f"""WITH {PLACES}, b0 AS (SELECT id, radians(lat) AS la, radians(lon) AS lo, radians(48.1) AS lb, radians(11.5) AS ob FROM places),
        k AS (SELECT *, sin(atan((1 - {f}) * tan(la))) AS s1, cos(atan((1 - {f}) * tan(la))) AS c1, sin(atan((1 - {f}) * tan(lb))) AS s2, cos(atan((1 - {f}) * tan(lb))) AS c2, ob - lo AS l FROM b0),
        r0 AS (SELECT *, l AS lam, 99.0 AS bef FROM k)"""
    turn = "SELECT id, la, lo, lb, ob, s1, c1, s2, c2, l, lam, bef, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs"
    more = "SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss <> 0 THEN c1 * c2 * sin(lam) / ss ELSE 0 END AS sa"
    last = "SELECT *, 1 - sa * sa AS c2a, CASE WHEN 1 - sa * sa <> 0 THEN cs - 2 * s1 * s2 / (1 - sa * sa) ELSE 0 END AS cm"
    parts = [head]
    for i in range(rounds + 1):
        parts.append(f"x{i} AS (SELECT *, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS cc FROM ({last} FROM ({more} FROM ({turn} FROM r{i}))))")
        if i < rounds:
            parts.append(f"r{i + 1} AS (SELECT id, la, lo, lb, ob, s1, c1, s2, c2, l, l + (1 - cc) * {f} * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam, lam AS bef FROM x{i})")
    parts.append(f"y AS (SELECT *, c2a * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS u FROM x{rounds})")
    parts.append("z AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS ba, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS bb FROM y)")
    dist = f"{b} * ba * (sg - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))))"
    ok = "abs(lam - bef) < 1e-11"
    angle = lambda e: f"CASE WHEN {ok} THEN round((degrees({e}) + 360) % 360, 6) END"
    return ", ".join(parts) + f" SELECT id, CASE WHEN {ok} THEN round({dist}, 3) END AS distance, {angle('atan2(c2 * sin(lam), c1 * s2 - s1 * c2 * cos(lam))')} AS initial, {angle('atan2(c1 * sin(lam), c1 * s2 * cos(lam) - s1 * c2)')} AS final FROM z"


def _grid_names_sql() -> str:
    f = G.FLAT
    n = f / (2 - f)
    radius = G.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    c = 2 * math.sqrt(n) / (1 + n)
    sinh, cosh = lambda x: f"((exp({x}) - exp(-({x}))) / 2)", lambda x: f"((exp({x}) + exp(-({x}))) / 2)"
    atanh = lambda x: f"(ln((1 + {x}) / (1 - {x})) / 2)"
    east = " + ".join(["eta", *[f"{a!r} * cos({2 * j} * xi) * {sinh(f'{2 * j} * eta')}" for j, a in enumerate(alpha, 1)]])
    north = " + ".join(["xi", *[f"{a!r} * sin({2 * j} * xi) * {cosh(f'{2 * j} * eta')}" for j, a in enumerate(alpha, 1)]])
    sin_lat = "sin(radians(lat))"
    bits = "||".join(f"substr('{_alphabet()}', CAST(" + " + ".join(f"(({'xi30' if i % 2 == 0 else 'yi30'} >> {29 - i // 2}) & 1) * {2 ** (4 - i % 5)}" for i in range(5 * k, 5 * k + 5)) + " + 1 AS INT), 1)" for k in range(12))
    return f"""WITH {PLACES}, z AS (SELECT *, CASE WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END
            WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 ELSE least(CAST(floor((lon + 180) / 6) AS INT) + 1, 60) END AS zone FROM places),
        t AS (SELECT *, {sinh(f"({atanh(sin_lat)} - {c!r} * {atanh(f'({c!r} * {sin_lat})')})")} AS t, radians(lon - (zone * 6 - 183)) AS d FROM z),
        x AS (SELECT *, atan2(t, cos(d)) AS xi, {atanh("(sin(d) / sqrt(1 + t * t))")} AS eta, least(lon + 180, 359.999999) AS mx, least(lat + 90, 179.999999) AS my,
              CAST(floor((lon + 180) / 360 * 1073741824) AS BIGINT) AS xi30, CAST(floor((lat + 90) / 180 * 1073741824) AS BIGINT) AS yi30 FROM t)
        SELECT id, CASE WHEN lat BETWEEN -80 AND 84 THEN zone END AS zone, CASE WHEN lat BETWEEN -80 AND 84 THEN CASE WHEN lat < 0 THEN 'S' ELSE 'N' END END AS hemisphere,
               CASE WHEN lat BETWEEN -80 AND 84 THEN round(500000 + {radius!r} * ({east}), 2) END AS easting, CASE WHEN lat BETWEEN -80 AND 84 THEN round(CASE WHEN lat < 0 THEN 1e7 ELSE 0 END + {radius!r} * ({north}), 2) END AS northing,
               chr(65 + CAST(floor(mx / 20) AS INT)) || chr(65 + CAST(floor(my / 10) AS INT)) || CAST(CAST(floor(mx % 20 / 2) AS INT) AS VARCHAR) || CAST(CAST(floor(my % 10) AS INT) AS VARCHAR) || chr(97 + CAST(floor(mx % 2 * 12) AS INT)) || chr(97 + CAST(floor(my % 1 * 24) AS INT)) AS maidenhead,
               {bits} AS geohash FROM x"""


ORACLE_SQL["geodesics"] = _vincenty_sql()
ORACLE_SQL["grid_names"] = _grid_names_sql()
