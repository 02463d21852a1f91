"""Queries on orbits, sky positions, dilution of precision, spectra and tracks of fixes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanax.functions import orbit, signals, timescales
from almanax.operators import tracks
from almanax.plans.adapter import POSITIONS, millis, positions
from almanax.session import load

RECEIVER = (3_771_793.97, 140_253.34, 5_124_304.35)
START = 1_704_067_200_000


def kepler_ephemerides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plausible GPS and Galileo elements from suppliers, one every two hours of a day; each 48 suppliers are a minute later."""
    s = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 24 + 1).alias("n"), F.col("s_suppkey").alias("k"))
    hours = spark.range(12).select(F.col("id").alias("h"))
    sys = F.when(F.col("k") % 48 >= 24, "E").otherwise("G")
    field = {"sqrtA": F.when(sys == "E", 5440.6).otherwise(5153.6), "e": 0.001 * (F.col("n") % 15), "m0": F.col("n") * 0.7 + F.col("h") * 1.05, "deltaN": F.lit(4.5e-9), "omega0": F.col("n") % 6 * 1.047, "omegaDot": F.lit(-8.0e-9), "i0": F.lit(0.96), "idot": F.lit(1e-10), "omega": F.col("n") * 0.3, "cuc": F.lit(1e-6), "cus": F.lit(8e-6), "crc": F.lit(200.0), "crs": F.lit(-50.0), "cic": F.lit(1e-7), "cis": F.lit(-1e-7)}
    toe = timescales.time_of_week(F.col("toc_ms")) / 1000
    kepler = F.struct(*[(c if not isinstance(c, float) else F.lit(c)).cast("double").alias(k) for k, c in field.items()], toe.alias("toe"))
    toc = F.col("h") * 7_200_000 + START + F.floor(F.col("k") / 48) % 120 * 60_000
    rows = s.crossJoin(F.broadcast(hours)).withColumn("toc_ms", toc)  # twelve rows
    state = F.lit(None).cast("struct<" + ",".join(f"{f}:double" for f in orbit.STATE_FIELDS) + ">")
    return rows.select(F.concat(sys, F.lpad(F.col("n").cast("string"), 2, "0")).alias("prn"), sys.alias("sys"), "toc_ms", (F.col("k") * 100 + F.col("h")).alias("ord"), F.lit(True).alias("healthy"), kepler.alias("kepler"), state.alias("state"))


def _times(spark: SparkSession) -> DataFrame:
    return spark.range(96).select((F.lit(START) + F.col("id") * 900_000).alias("t_ms"))


def satellite_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = orbit.satellite_positions(_times(spark), kepler_ephemerides(spark, sf_dir), RECEIVER)
    return out.select("t_ms", "prn", *[F.round(c, 2).alias(c) for c in "xyz"], F.round(F.degrees("el"), 6).alias("el"))


def glonass_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State vectors carried forward and back by Runge-Kutta; not SQL.

    Every supplier is an ephemeris: 24 slots, then half-hours of a day, then seconds of a half-hour. Few suppliers leave times without one.
    """
    s = load(spark, sf_dir, "supplier").where("s_suppkey is not null")
    n = F.col("s_suppkey")
    slot, half = F.pmod(n - 1, F.lit(24)) + 1, F.floor((n - 1) / 24)
    toc = F.lit(START + 900_000) + F.pmod(half, F.lit(48)) * 1_800_000 + F.pmod(F.floor(half / 48), F.lit(1800)) * 1000
    speed = math.sqrt(orbit.PZ_MU / 25_500.0)
    field = {"x": 25_500 * F.cos(n * 0.26), "y": 25_500 * F.sin(n * 0.26) * 0.43, "z": 25_500 * F.sin(n * 0.26) * 0.9, "vx": -speed * F.sin(n * 0.26), "vy": speed * F.cos(n * 0.26) * 0.43, "vz": speed * F.cos(n * 0.26) * 0.9, "ax": n * 0.0, "ay": n * 0.0, "az": n * 0.0}
    state = F.struct(*[c.alias(k) for k, c in field.items()])
    kepler = F.lit(None).cast("struct<" + ",".join(f"{f}:double" for f in orbit.KEPLER_FIELDS) + ">")
    eph = s.select(F.concat(F.lit("R"), F.lpad(slot.cast("string"), 2, "0")).alias("prn"), F.lit("R").alias("sys"), toc.alias("toc_ms"), n.alias("ord"), F.lit(True).alias("healthy"), kepler.alias("kepler"), state.alias("state"))
    out = orbit.satellite_positions(_times(spark), eph)
    return out.select("t_ms", "prn", *[F.round(c, 2).alias(c) for c in "xyz"])


def dilution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the event-made sky, by hours."""
    sky = positions(spark, sf_dir).where("el > 0.1").withColumn("t_ms", F.floor(F.col("t_ms") / 3_600_000) * 3_600_000)
    return orbit.dilution(sky).select("t_ms", "satellites", *[F.round(c, 5).alias(c) for c in ("gdop", "pdop", "hdop", "vdop")])


def navigation_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every six hours from the first to the last order."""
    eph = load(spark, sf_dir, "orders").select(millis("o_orderdate").alias("toc_ms"))
    return timescales.navigation_times(eph, 6 * 3_600_000)


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of all signals of the catalogue at an offset for each part."""
    axis = load(spark, sf_dir, "part").select(((F.col("p_partkey").cast("double") * 12_345.0 + 617.25) % 5e7 - 2.5e7).alias("offset_hz"))
    return signals.spectra(axis).withColumn("db", F.round("db", 6))


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track of fixes per user from events."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("track"), millis("ts").alias("t_ms"), (48 + F.col("event_id") % 1000 / 1e5).alias("lat"), (11 + F.col("event_id") % 777 / 1e5).alias("lon"), (500 + F.col("value") / 10).alias("alt"), (F.col("event_id") % 9 + 4).cast("int").alias("satellites"), (F.col("value") / 10).alias("speed"), F.lit(1).alias("quality"))


def track_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tracks.statistics(_fixes(spark, sf_dir))
    return out.select("track", "fixes", "start_ms", "end_ms", "duration", F.round("distance", 2).alias("distance"), F.round("max_speed_kmh", 6).alias("max_speed_kmh"), F.round("satellites", 6).alias("satellites"), "lat_min", "lat_max", "lon_min", "lon_max")


def track_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the fixes about their mean place."""
    out = tracks.precision(_fixes(spark, sf_dir))
    return out.select("track", *[F.round(c, 4).alias(c) for c in ("h_rms", "v_rms", "drms2", "cep", "reach")])


def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.coloured_segments(_fixes(spark, sf_dir))


QUERIES = {f.__name__: f for f in (satellite_positions, glonass_positions, dilution, navigation_times, spectrum, track_statistics, track_precision, track_segments)}


def _positions_sql() -> str:
    """Kepler's equation by as many Newton steps, one CTE each."""
    mu, w = "CASE sys WHEN 'E' THEN 3.986004418e14 ELSE 3.986005e14 END", "7.2921151467e-5"
    x, y, z = (repr(v) for v in RECEIVER)
    head = f"""WITH el AS (SELECT s_suppkey AS k, s_suppkey % 24 + 1 AS n, h, CASE WHEN s_suppkey % 48 >= 24 THEN 'E' ELSE 'G' END AS sys, {START} + h * 7200000 + s_suppkey // 48 % 120 * 60000 AS toc FROM supplier, (SELECT unnest(range(0, 12)) AS h)),
        ef AS (SELECT sys || lpad(n::VARCHAR, 2, '0') AS prn, sys, toc, k * 100 + h AS ord, CASE sys WHEN 'E' THEN 5440.6 ELSE 5153.6 END::DOUBLE AS sa, 0.001::DOUBLE * (n % 15) AS e, n * 0.7::DOUBLE + h * 1.05::DOUBLE AS m0, n % 6 * 1.047::DOUBLE AS o0, n * 0.3::DOUBLE AS om, (toc - 315964800000) % 604800000 / 1000.0::DOUBLE AS toe FROM el),
        tm AS (SELECT {START} + i * 900000 AS t_ms FROM (SELECT unnest(range(0, 96)) AS i)),
        b AS (SELECT t_ms, prn, min_by(ord, (abs(t_ms - toc), ord)) AS ord FROM tm JOIN ef ON abs(t_ms - toc) <= 14400000 GROUP BY ALL),
        e0 AS (SELECT t_ms, ef.*, (t_ms - 315964800000) % 604800000 / 1000.0::DOUBLE - toe AS d FROM b JOIN ef USING (prn, ord)),
        k0 AS (SELECT *, CASE WHEN d > 302400 THEN d - 604800 WHEN d < -302400 THEN d + 604800 ELSE d END AS tk, sa * sa AS a FROM e0),
        a0 AS (SELECT *, m0 + (sqrt(({mu}) / (a * a * a)) + 4.5e-9) * tk AS mm FROM k0), n0 AS (SELECT *, mm AS ea FROM a0)"""
    steps = [f"n{i + 1} AS (SELECT * REPLACE (ea - (ea - e * sin(ea) - mm) / (1 - e * cos(ea)) AS ea) FROM n{i})" for i in range(8)]
    tail = f"""p AS (SELECT *, atan2(sqrt(1 - e * e) * sin(ea), cos(ea) - e) + om AS phi FROM n8),
        c AS (SELECT *, phi + 8e-6 * sin(2 * phi) + 1e-6 * cos(2 * phi) AS u, a * (1 - e * cos(ea)) - 50 * sin(2 * phi) + 200 * cos(2 * phi) AS r, 0.96 + 1e-10 * tk - 1e-7 * sin(2 * phi) + 1e-7 * cos(2 * phi) AS i, o0 + (-8.0e-9 - {w}) * tk - {w} * toe AS o FROM p),
        f AS (SELECT t_ms, prn, r * cos(u) * cos(o) - r * sin(u) * cos(i) * sin(o) AS x, r * cos(u) * sin(o) + r * sin(u) * cos(i) * cos(o) AS y, r * sin(u) * sin(i) AS z FROM c),
        rx AS (SELECT atan2({y}, {x}) AS lo, sqrt({x} * {x} + {y} * {y}) AS p)"""
    return head + ", " + ", ".join(steps) + ", " + tail + " SELECT t_ms, prn, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, " + _elevation_sql(x, y, z) + " AS el FROM f, rx"


def _elevation_sql(x: str, y: str, z: str) -> str:
    from almanax.functions import geodesy as G

    ep2 = G.E2 / (1 - G.E2)
    px, py, pz = RECEIVER
    p = math.hypot(px, py)
    tangent = lambda b: math.atan2(pz + ep2 * G.B * math.sin(b) ** 3, p - G.E2 * G.A * math.cos(b) ** 3)
    lat = tangent(math.atan2(pz * G.A, p * G.B))
    for _ in range(2):
        lat = tangent(math.atan2((1 - G.FLAT) * math.sin(lat), math.cos(lat)))
    lon = math.atan2(py, px)
    sl, cl, so, co = math.sin(lat), math.cos(lat), math.sin(lon), math.cos(lon)
    d = [f"(x - {x})", f"(y - {y})", f"(z - {z})"]
    dot = lambda *k: "(" + " + ".join(f"{v!r} * {c}" for v, c in zip(k, d, strict=True)) + ")"
    e, n, u = dot(-so, co, 0.0), dot(-sl * co, -sl * so, cl), dot(cl * co, cl * so, sl)
    return f"round(degrees(atan2({u}, sqrt({e} * {e} + {n} * {n}))), 6)"


_TRACK = "fx AS (SELECT user_id AS track, epoch_us(ts) // 1000 AS t_ms, 48 + event_id % 1000 / 1e5 AS lat, 11 + event_id % 777 / 1e5 AS lon, value, CAST(event_id % 9 + 4 AS INT) AS sats FROM events)"
ORACLE_SQL = {
    "satellite_positions": _positions_sql(),
    "navigation_times": "WITH e AS (SELECT min(epoch_us(o_orderdate) // 1000) AS a, max(epoch_us(o_orderdate) // 1000) AS b FROM orders) SELECT unnest(range(a, b + 1, 21600000)) AS t_ms FROM e",
    "track_statistics": f"""WITH {_TRACK}, p AS (SELECT *, radians(lat) AS la, radians(lon) AS lo, radians(lag(lat) OVER w) AS lb, radians(lag(lon) OVER w) AS ob FROM fx WINDOW w AS (PARTITION BY track ORDER BY t_ms)),
        d AS (SELECT *, 2 * 6371008.8 * asin(sqrt(pow(sin((la - lb) / 2), 2) + cos(la) * cos(lb) * pow(sin((lo - ob) / 2), 2))) AS d FROM p)
        SELECT track, count(*) AS fixes, min(t_ms) AS start_ms, max(t_ms) AS end_ms, (max(t_ms) - min(t_ms)) / 1000.0 AS duration, round(sum(d), 2) AS distance, round(max(value / 10) * 1.852, 6) AS max_speed_kmh, round(avg(sats), 6) AS satellites,
               min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM d GROUP BY track""",
    "track_segments": f"""WITH {_TRACK}, c AS (SELECT track, t_ms, least(8, greatest(0, sats - 4)) AS colour, lead(t_ms) OVER (PARTITION BY track ORDER BY t_ms) AS nx FROM fx), l AS (SELECT *, lag(colour) OVER (PARTITION BY track ORDER BY t_ms) AS bef FROM c WHERE nx IS NOT NULL),
        g AS (SELECT *, CAST(sum(CASE WHEN bef = colour THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY t_ms) AS BIGINT) AS segment FROM l)
        SELECT track, segment, CAST(any_value(colour) AS INT) AS colour, min(t_ms) AS start_ms, max(nx) AS end_ms, count(*) AS pieces FROM g GROUP BY track, segment""",
}


def _dilution_sql() -> str:
    """The diagonal of the normal matrix's inverse by cofactors."""
    names = ("e", "n", "u", "t")
    at = lambda a, b: a + b if names.index(a) <= names.index(b) else b + a
    sums = ", ".join(f"sum({a} * {b}) AS {a + b}" for i, a in enumerate(names) for b in names[i:])

    def det(rows, cols) -> str:
        if len(rows) == 1:
            return at(rows[0], cols[0])
        parts = [f"{'-' if k % 2 else '+'} {at(rows[0], c)} * ({det(rows[1:], [x for x in cols if x != c])})" for k, c in enumerate(cols)]
        return " ".join(parts)

    cof = {k: det([x for x in names if x != k], [x for x in names if x != k]) for k in names}
    inverse = ", ".join(f"CASE WHEN m >= 4 AND abs(d) > 1e-12 THEN ({cof[k]}) / d END AS q{k}" for k in names)
    return f"""WITH {POSITIONS}, v AS (SELECT t_ms // 3600000 * 3600000 AS t_ms, cos(el) * sin(az) AS e, cos(el) * cos(az) AS n, sin(el) AS u, 1.0::DOUBLE AS t FROM pos WHERE el > 0.1),
        s AS (SELECT t_ms, count(*) AS m, {sums} FROM v GROUP BY 1), x AS (SELECT *, {det(list(names), list(names))} AS d FROM s), q AS (SELECT t_ms, m, {inverse} FROM x)
        SELECT t_ms, m AS satellites, round(sqrt(qe + qn + qu + qt), 5) AS gdop, round(sqrt(qe + qn + qu), 5) AS pdop, round(sqrt(qe + qn), 5) AS hdop, round(sqrt(qu), 5) AS vdop FROM q"""


ORACLE_SQL["dilution"] = _dilution_sql()


def _precision_sql() -> str:
    """Places by the ellipsoid, their mean, and the mean's latitude by the tangent of the parametric one, as often as the library does."""
    from almanax.functions import geodesy as G

    a, b, e2, flat = (repr(v) for v in (G.A, G.B, G.E2, G.FLAT))
    ep2 = repr(G.E2 / (1 - G.E2))
    tangent = lambda t: f"atan2(z + {ep2} * {b} * pow(sin({t}), 3), p - {e2} * {a} * pow(cos({t}), 3))"
    return f"""WITH {_TRACK}, ll AS (SELECT track, radians(lat) AS la, radians(lon) AS lo, 500 + value / 10 AS h FROM fx), nn AS (SELECT *, {a} / sqrt(1 - {e2} * sin(la) * sin(la)) AS n FROM ll),
        pt AS (SELECT track, (n + h) * cos(la) * cos(lo) AS px, (n + h) * cos(la) * sin(lo) AS py, (n * (1 - {e2}) + h) * sin(la) AS pz FROM nn), mn AS (SELECT track, avg(px) AS x, avg(py) AS y, avg(pz) AS z, sqrt(avg(px) * avg(px) + avg(py) * avg(py)) AS p FROM pt GROUP BY track),
        l1 AS (SELECT *, {tangent(f"atan2(z * {a}, p * {b})")} AS la FROM mn), l2 AS (SELECT * REPLACE ({tangent(f"atan2((1 - {flat}) * sin(la), cos(la))")} AS la) FROM l1), l3 AS (SELECT * REPLACE ({tangent(f"atan2((1 - {flat}) * sin(la), cos(la))")} AS la) FROM l2),
        d AS (SELECT track, la, atan2(y, x) AS lo, px - x AS dx, py - y AS dy, pz - z AS dz FROM pt JOIN l3 USING (track)),
        v AS (SELECT track, -sin(lo) * dx + cos(lo) * dy AS e, -sin(la) * cos(lo) * dx - sin(la) * sin(lo) * dy + cos(la) * dz AS n, cos(la) * cos(lo) * dx + cos(la) * sin(lo) * dy + sin(la) * dz AS u FROM d),
        g AS (SELECT track, sqrt(avg(e * e + n * n)) AS h, sqrt(avg(u * u)) AS v, max(greatest(abs(e), abs(n))) AS most FROM v GROUP BY track)
        SELECT track, round(h, 4) AS h_rms, round(v, 4) AS v_rms, round(2 * h, 4) AS drms2, round({tracks.CEP_RATIO!r} * h, 4) AS cep, round(CASE WHEN most > 0 THEN ceil(most * 1.1 * 1000) / 1000 ELSE 1.0 END, 4) AS reach FROM g"""


def _spectrum_sql() -> str:
    """Each signal of the catalogue by the formula of its modulation."""
    pi = repr(math.pi)

    def boc(sub: float, chip: float, cosine: bool = False) -> str:
        half, top = f"({pi} * f / {2 * sub!r})", "sin" if round(2 * sub / chip) % 2 == 0 else "cos"
        wave = f"2 * pow(sin({half} / 2), 2) / cos({half})" if cosine else f"tan({half})"
        return f"CASE WHEN abs(f) < 1e-6 THEN 0.0 WHEN abs(cos({half})) < 1e-9 THEN NULL ELSE {chip!r} * pow({top}({pi} * f / {chip!r}) * ({wave}) / ({pi} * f), 2) END"

    def density(form: str, sub: float, chip: float) -> str:
        s, c = float(sub * signals.F0), float(chip * signals.F0)
        if form == "bpsk":
            x = f"({pi} * (f / {c!r}))"
            return f"CASE WHEN abs(f / {c!r}) < 1e-12 THEN 1.0 ELSE pow(sin{x} / {x}, 2) END / {c!r}"
        if form == "mboc":
            return f"10.0 / 11 * ({boc(signals.F0, signals.F0)}) + 1.0 / 11 * ({boc(6 * signals.F0, signals.F0)})"
        if form == "altboc":
            h, q = f"({pi} * f / {2 * s!r})", f"({pi} * f / {4 * s!r})"
            return f"CASE WHEN abs(f) < 1e-6 THEN 0.0 WHEN abs(cos{h}) < 1e-9 THEN NULL ELSE {c!r} / (2 * {pi} * {pi} * f * f) * pow(cos({pi} * f / {c!r}) / cos{h}, 2) * (pow(cos{h}, 2) - cos{h} - 2 * cos{h} * cos{q} + 2) END"
        return boc(s, c, form == "bocc")

    each = " UNION ALL ".join(f"SELECT '{sys}' AS sys, '{name}' AS signal, f, {density(form, sub, chip)} AS d FROM ax" for sys, name, form, sub, chip, _ in signals.CATALOGUE)
    return f"""WITH ax AS (SELECT (p_partkey::DOUBLE * 12345.0::DOUBLE + 617.25::DOUBLE) % 5e7::DOUBLE - 2.5e7::DOUBLE AS f FROM part), al AS ({each})
        SELECT sys, signal, f AS offset_hz, round(greatest(10 * log10(greatest(d * 1e6, 1e-30)), -60.0), 6) AS db FROM al"""


ORACLE_SQL |= {"track_precision": _precision_sql(), "spectrum": _spectrum_sql()}
