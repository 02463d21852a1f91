"""Queries on searches, pages, listings, formats and the smaller joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanax.functions import geodesy, signals, timescales
from almanax.operators import asof, filters, listing
from almanax.plans.adapter import PLACES, POSITIONS, millis, places, positions
from almanax.session import load


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "BRAND#1", ["p_name", "p_brand", "p_type"])


def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty names that hold what was typed: a list is cut by design."""
    names = load(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))
    return filters.autocomplete(names, "mer#0000000")


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty by name, as a list shows it."""
    return filters.page(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", 1, 50, False, "p_partkey")


#: Endings that differ by accents and case alone, in the order of names; every fifth name is null.
_ENDINGS = ("resume", "Resume", "RESUME", "résumé")


def page_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty by name up, and the first down, by letters, then accents, then case; nulls last."""
    k = F.col("p_partkey")
    ending = F.get(F.array(*[F.lit(x) for x in _ENDINGS]), (k % 5).cast("int"))
    names = load(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), ending).alias("name"))
    up = filters.page(names, "name", 2, 50, False, "p_partkey", collation="UNICODE").withColumn("way", F.lit("up"))
    return up.unionByName(filters.page(names, "name", 0, 50, True, "p_partkey", collation="UNICODE").withColumn("way", F.lit("down")))


def first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = load(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("key"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"), F.col("event_id").alias("file_ord"))
    return asof.first_known(h)


def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 97).cast("string")).alias("name"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("size"))
    return asof.staged(f)


def same_ephemerides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even and of odd numbers as two versions of a day's ephemerides."""
    o = load(spark, sf_dir, "orders").select(F.concat(F.lit("G"), (F.col("o_custkey") % 32).cast("string")).alias("prn"), millis("o_orderdate").alias("toc_ms"), F.col("o_orderkey").alias("ord"))
    return asof.same_ephemerides(o.where("ord % 2 = 0"), o.where("ord % 2 = 1"))


def station_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    streams = p.select(F.col("id").cast("string").alias("mountpoint"), F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.col("lat")).alias("lat"), F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.col("lon")).alias("lon"))
    own = p.where("id % 3 = 0").select(F.col("id").cast("string").alias("mountpoint"), (F.col("lat") + 0.5).alias("lat"), "lon", "h")
    return asof.station_position(streams, own)


def best_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select(F.concat(F.lit("E"), F.lpad((F.col("user_id") % 36 + 1).cast("string"), 2, "0")).alias("prn"), F.col("event_type").alias("code"), (F.col("value") % 60 - 5).alias("cn0"))
    return signals.best_signals(e).withColumn("ssi", signals.strength_indicator(F.col("cn0")))


def loaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    kind = F.element_at(F.array(*[F.lit(s) for s in ("_GN.rnx", "_RN.rnx.gz", "_MN.rnx", "_MO.rnx", ".24n", ".24o", ".nav", "_SN.rnx")]), (F.col("c_custkey") % 8 + 1).cast("int"))
    return listing.loaded_files(c.select(F.concat(F.lit("X"), F.col("c_custkey").cast("string"), kind).alias("name"), (F.col("c_custkey") * 100).alias("size")))


def polled_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status answers made from orders as JSON text, and read again."""
    o = load(spark, sf_dir, "orders").withColumn("prn", F.concat(F.lit("G"), F.lpad((F.col("o_custkey") % 32 + 1).cast("string"), 2, "0")))
    text = F.format_string('{"updatedAt": %d, "satellites": {"%s": {"prn": "%s", "health": %d, "week": %d, "toe": %d, "lastReceived": %d}}}', "o_orderkey", "prn", "prn", F.col("o_custkey") % 3, F.col("o_orderkey") % 1024, F.col("o_orderkey") % 600000, F.col("o_orderkey") * 1000)
    rows = listing.polled_status(o.select(text.alias("json")))
    when = timescales.ephemeris_instant(F.substring("prn", 1, 1), F.col("week"), F.col("toe"), F.col("tb"), F.col("toc"), F.col("received_ms"), F.lit(1_704_067_200_000))
    return rows.select("prn", "received_ms", "health", "week", when.alias("t_ms"), timescales.expired(F.substring("prn", 1, 1), F.col("received_ms"), F.lit(20_000_000)).alias("expired"))


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    n = F.col("id")
    return c.select("id", timescales.duration_text(n * 7).alias("duration"), timescales.age_text(n * 13_000).alias("age"), timescales.size_text(n * n * 3).alias("size"))


def time_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.time_ticks(load(spark, sf_dir, "events").agg(F.min(millis("ts")).alias("start_ms"), (F.min(millis("ts")) + 50_000_000).alias("end_ms")))


def elevation_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.elevation_heatmap(positions(spark, sf_dir), 60).withColumn("el", F.round("el", 6))


def great_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the way from each place to (48.1, 11.5): along the great circle in 4 pieces, and evenly in both angles."""
    p = places(spark, sf_dir).withColumns({"la": F.radians("lat"), "lo": F.radians("lon")})
    to = F.radians(F.lit(48.1)), F.radians(F.lit(11.5))
    both = F.arrays_zip(geodesy.great_circle_points(F.col("la"), F.col("lo"), *to, 4).alias("a"), geodesy.straight_points(F.col("la"), F.col("lo"), *to, 4).alias("b"))
    rows = p.select("id", F.posexplode(both).alias("i", "p"))
    return rows.select("id", "i", F.round(F.degrees("p.a.lat"), 5).alias("lat"), F.round(F.degrees("p.a.lon"), 5).alias("lon"), F.round(F.degrees("p.b.lat"), 5).alias("even_lat"), F.round(F.degrees("p.b.lon"), 5).alias("even_lon"))


def antenna_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent and nearest grid value of a pattern made from a part's number."""
    n = F.col("p_partkey")
    pcv = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda z: ((n * (a + 1) + z * 7) % 23 - 11) / 10))
    rows = load(spark, sf_dir, "part").select(n.alias("id"), pcv.alias("pcv"))
    e = signals.pattern_extent(F.flatten("pcv"))
    at = signals.pattern_at(F.col("pcv"), F.lit(0.0), F.lit(15.0), F.col("id") % 75, F.lit(90.0), F.col("id") % 360)
    return rows.withColumn("e", e).select("id", "e.lo", "e.hi", "e.sym", at.alias("value"))


_NAMED = (search, autocomplete, page, page_collated, first_known, staged_files, same_ephemerides, station_position, best_signals, loaded_files, polled_status, formats, time_ticks, elevation_heatmap, great_circles, antenna_patterns)
QUERIES = {f.__name__: f for f in _NAMED}

_TENTH = "CAST(CAST(floor({} * 10 + 0.5) / 10 AS DECIMAL(20, 1)) AS VARCHAR)"
ORACLE_SQL = {
    "search": "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE lower(p_name) LIKE '%brand#1%' OR lower(p_brand) LIKE '%brand#1%' OR lower(p_type) LIKE '%brand#1%'",
    "autocomplete": "SELECT c_name AS name, c_custkey AS ord FROM customer WHERE upper(c_name) LIKE '%MER#0000000%' ORDER BY ord LIMIT 50",
    "page_collated": f"""WITH n AS (SELECT p_partkey, p_name, CAST(p_partkey % 5 AS INT) AS e, p_name || ' ' || [{", ".join(f"'{x}'" for x in _ENDINGS)}][CAST(p_partkey % 5 AS INT) + 1] AS name FROM part),
u AS (SELECT p_partkey, name, 'up' AS way FROM n ORDER BY name IS NULL, p_name, e, p_partkey LIMIT 50 OFFSET 100),
d AS (SELECT p_partkey, name, 'down' AS way FROM n ORDER BY name IS NULL, p_name DESC, e DESC, p_partkey LIMIT 50)
SELECT * FROM u UNION ALL SELECT * FROM d""",
    "page": "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 50 OFFSET 50",
    "first_known": "SELECT user_id % 40 AS key, min_by(value, event_id) FILTER (event_id % 3 = 0) AS value FROM events GROUP BY 1",
    "staged_files": "SELECT 'f' || o_custkey % 97 AS name, min(o_orderkey) AS ord, min_by(o_totalprice, o_orderkey) AS size FROM orders GROUP BY 1",
    "same_ephemerides": "WITH o AS (SELECT 'G' || o_custkey % 32 AS prn, epoch_us(o_orderdate) // 1000 AS toc_ms, o_orderkey AS ord FROM orders) SELECT prn, toc_ms, min(ord) FILTER (ord % 2 = 0) AS left_ord, min(ord) FILTER (ord % 2 = 1) AS right_ord FROM o GROUP BY ALL HAVING left_ord IS NOT NULL AND right_ord IS NOT NULL",
    "station_position": f"WITH {PLACES} SELECT id::VARCHAR AS mountpoint, CASE WHEN id % 3 = 0 THEN lat + 0.5 WHEN NOT (id % 4 = 0 OR (lat = 0 AND lon = 0)) THEN lat END AS lat, CASE WHEN id % 3 = 0 THEN lon WHEN NOT (id % 4 = 0 OR (lat = 0 AND lon = 0)) THEN lon END AS lon, CASE WHEN id % 3 = 0 THEN h WHEN NOT (id % 4 = 0 OR (lat = 0 AND lon = 0)) THEN 0.0::DOUBLE END AS h FROM places",
    "best_signals": "WITH e AS (SELECT 'E' || lpad((user_id % 36 + 1)::VARCHAR, 2, '0') AS prn, event_type AS code, value % 60 - 5 AS cn0 FROM events), b AS (SELECT 'E' AS sys, prn, max(cn0) AS cn0, max_by(code, (cn0, code)) AS code FROM e WHERE cn0 > 0 GROUP BY prn) SELECT *, CAST(least(9, greatest(1, floor(cn0 / 6 + 0.5))) AS INT) AS ssi FROM b",
    "loaded_files": """WITH c AS (SELECT c_custkey % 8 AS k, c_custkey * 100 AS size FROM customer), g AS (SELECT CASE WHEN k IN (3, 5, 7) THEN 'obs' ELSE 'nav' END AS kind, CASE k WHEN 0 THEN 'G' WHEN 1 THEN 'R' WHEN 2 THEN 'M' WHEN 4 THEN 'G' WHEN 6 THEN '?' END AS system, size FROM c)
        SELECT kind, system, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(instr('GRECJISM?', system) - 1, -1) AS INT) AS place FROM g GROUP BY kind, system""",
    "polled_status": """SELECT 'G' || lpad((o_custkey % 32 + 1)::VARCHAR, 2, '0') AS prn, o_orderkey * 1000 AS received_ms, CAST(o_custkey % 3 AS INT) AS health, CAST(o_orderkey % 1024 AS INT) AS week,
        315964800000 + (o_orderkey % 1024 + 2048 - CASE WHEN o_orderkey % 1024 + 2048 > 2295 + 512 THEN 1024 ELSE 0 END) * 604800000 + o_orderkey % 600000 * 1000 AS t_ms, 20000000 - o_orderkey * 1000 > 7200000 AS expired FROM orders""",
    "formats": f"""SELECT c_custkey AS id, CASE WHEN c_custkey * 7 >= 3600 THEN (c_custkey * 7 // 3600) || 'h ' || (c_custkey * 7 // 60 % 60) || 'm' WHEN c_custkey * 7 >= 60 THEN (c_custkey * 7 // 60) || 'm ' || (c_custkey * 7 % 60) || 's' ELSE (c_custkey * 7) || 's' END AS duration,
        CASE WHEN c_custkey * 13 < 60 THEN (c_custkey * 13) || 's ago' WHEN c_custkey * 13 < 3600 THEN CAST(floor(c_custkey * 13 / 60.0::DOUBLE + 0.5) AS BIGINT) || 'm ago' ELSE {_TENTH.format("(c_custkey * 13 / 3600.0::DOUBLE)")} || 'h ago' END AS age,
        CASE WHEN c_custkey * c_custkey * 3 < 1024 THEN (c_custkey * c_custkey * 3) || ' B' WHEN c_custkey * c_custkey * 3 < 1048576 THEN {_TENTH.format("(c_custkey * c_custkey * 3 / 1024.0::DOUBLE)")} || ' KB' ELSE {_TENTH.format("(c_custkey * c_custkey * 3 / 1048576.0::DOUBLE)")} || ' MB' END AS size FROM customer""",
    "time_ticks": "WITH s AS (SELECT min(epoch_us(ts) // 1000) AS a FROM events), f AS (SELECT CAST(ceil(a / 10800000.0::DOUBLE) AS BIGINT) * 10800000 AS f, a + 50000000 AS b FROM s) SELECT unnest(range(f, b + 1, 10800000)) AS t_ms FROM f",
    "elevation_heatmap": f"""WITH {POSITIONS}, e AS (SELECT t_ms, row_number() OVER (ORDER BY t_ms) - 1 AS i, greatest(1, CAST(ceil(count(*) OVER () / 60.0) AS BIGINT)) AS step FROM (SELECT DISTINCT t_ms FROM pos))
        SELECT t_ms, prn, round(degrees(el), 6) AS el FROM (SELECT t_ms FROM e WHERE i % step = 0) CROSS JOIN (SELECT DISTINCT prn FROM pos) LEFT JOIN pos USING (t_ms, prn)""",
    "great_circles": f"""WITH {PLACES}, p AS (SELECT id, radians(lat) AS la, radians(lon) AS lo, radians(48.1) AS lb, radians(11.5) AS ob FROM places), d AS (SELECT *, 2 * asin(sqrt(pow(sin((lb - la) / 2), 2) + cos(la) * cos(lb) * pow(sin((ob - lo) / 2), 2))) AS d FROM p),
        k AS (SELECT *, sin((1 - i / 4.0::DOUBLE) * d) / sin(d) AS a, sin(i / 4.0::DOUBLE * d) / sin(d) AS b FROM d, (SELECT unnest(range(0, 5)) AS i)), v AS (SELECT *, a * cos(la) * cos(lo) + b * cos(lb) * cos(ob) AS x, a * cos(la) * sin(lo) + b * cos(lb) * sin(ob) AS y, a * sin(la) + b * sin(lb) AS z FROM k)
        SELECT id, CAST(i AS INT) AS i, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) AS lat, round(degrees(atan2(y, x)), 5) AS lon, round(degrees(la + (lb - la) * i / 4), 5) AS even_lat, round(degrees(lo + (ob - lo) * i / 4), 5) AS even_lon FROM v""",
    "antenna_patterns": """WITH c AS (SELECT p_partkey AS id, a, z, ((p_partkey * (a + 1) + z * 7) % 23 - 11) / 10.0::DOUBLE AS v FROM part, (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 6)) AS z))
        SELECT id, min(v) AS lo, max(v) AS hi, greatest(abs(min(v)), abs(max(v))) AS sym, max(v) FILTER (a = CAST(floor(id % 360 / 90.0 + 0.5) AS INT) % 4 AND z = CAST(floor(id % 75 / 15.0 + 0.5) AS INT)) AS value FROM c GROUP BY id""",
}
