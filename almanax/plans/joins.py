"""Queries on nearest joins, merges, availability and constellation status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanax.functions import status as S
from almanax.model import STATUS_ORDER
from almanax.operators import asof, availability, grid
from almanax.plans.adapter import EPH, HOUR, OBS, POSITIONS, ephemerides, millis, observations, positions
from almanax.session import load

#: 1995-01-01: targets are spread over the ephemerides' years.
START, SPAN = 788_918_400_000, 220_000_000_000


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    prn = F.concat(F.substring(F.lit("GRECJIS"), (F.col("user_id") % 7 + 1).cast("int"), F.lit(1)), F.lpad(F.floor(F.col("user_id") / 7 + 1).cast("string"), 2, "0"))
    return e.select(prn.alias("prn"), (START + F.col("event_id") * 21_937_003 % SPAN).alias("t_ms")).distinct()


_TARGETS = "tg AS (SELECT DISTINCT substr('GRECJIS', CAST(user_id % 7 + 1 AS INT), 1) || lpad(CAST(user_id // 7 + 1 AS VARCHAR), 2, '0') AS prn, 788918400000 + event_id * 21937003 % 220000000000 AS t_ms FROM events)"


def nearest_ephemeris(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.nearest_ephemeris(_targets(spark, sf_dir), ephemerides(spark, sf_dir))
    return out.select("prn", "t_ms", F.col("best.toc_ms").alias("toc_ms"), F.col("best.ord").alias("ord"), F.col("best.healthy").alias("healthy"))


def elevation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    points = e.select(F.col("event_id").alias("id"), F.concat(F.lit("G"), F.lpad((F.col("user_id") * 3 % 20 + 1).cast("string"), 2, "0")).alias("prn"), millis("ts").alias("t_ms"))
    return asof.elevation_lookup(points, positions(spark, sf_dir)).select("id", "prn", "t_ms", F.round("el", 9).alias("el"))


def availability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    eph, seen = _day(spark, sf_dir)
    return availability.availability(eph, seen, most=97)


def availability_navigation_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return availability.availability(_day(spark, sf_dir)[0], None, most=97)


def _day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ephemerides with their times folded into the events' month, and observed satellites."""
    eph = ephemerides(spark, sf_dir).withColumn("toc_ms", F.lit(1_704_067_200_000) + F.col("ord") * 1_337_777 % 2_500_000_000)
    return eph, grid.satellite_snr(observations(spark, sf_dir)).select("t_ms", "prn")


def navigation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return availability.navigation_summary(ephemerides(spark, sf_dir))


def sky_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at or above 10 degrees of satellites seen in the same half minute, joined to their values."""
    p = positions(spark, sf_dir)
    e = load(spark, sf_dir, "events")
    snr = e.select((F.floor(millis("ts") / 30_000) * 30_000).alias("t_ms"), F.concat(F.lit("G"), F.lpad((F.col("user_id") % 20 + 1).cast("string"), 2, "0")).alias("prn"), "event_id", "value")
    snr = snr.groupBy("t_ms", "prn").agg(F.max_by("value", "event_id").alias("snr")).withColumn("band", F.lit("1"))
    out = asof.sky_signal(asof.sky(snr, p, 10.0), snr)
    return out.select("t_ms", "prn", "band", F.round("el", 9).alias("el"), "snr")


def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as three files, in which every fifth value is missing."""
    o = load(spark, sf_dir, "events").select((F.floor(millis("ts") / HOUR) * HOUR).alias("t_ms"), F.lit("G").alias("sys"), F.concat(F.lit("G"), F.lpad((F.col("user_id") % 30 + 1).cast("string"), 2, "0")).alias("prn"), F.col("event_type").alias("code"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), (F.col("event_id") % 3).alias("file_ord"), F.col("event_id").alias("rec_ord"))
    return asof.merge_files(o)


def msm_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "events").select((F.floor(millis("ts") / HOUR) * HOUR + F.col("event_id") % 20).alias("time_ms"), F.col("event_id").alias("ord"), F.concat(F.lit("E"), F.lpad((F.col("user_id") % 30 + 1).cast("string"), 2, "0")).alias("prn"), F.col("event_type").alias("code"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("phase"), F.when(F.col("event_id") % 4 != 0, F.col("value") % 60).alias("cn0"))
    return asof.msm_epochs(m)


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live ephemerides of real slots, from orders: the last by time."""
    o = load(spark, sf_dir, "orders")
    sys = F.substring(F.lit("GERCJS"), (F.col("o_custkey") % 6 + 1).cast("int"), F.lit(1))
    n = F.col("o_custkey") % 40
    prn = F.when(sys == "S", F.concat(sys, (120 + n).cast("string"))).otherwise(F.concat(sys, F.lpad((n + 1).cast("string"), 2, "0")))
    rows = o.select(prn.alias("prn"), (F.col("o_orderkey") * 1000).alias("received_ms"), (F.col("o_orderkey") % 7 * F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(9)).cast("int").alias("health"), (F.col("o_orderkey") % 3).cast("int").alias("sat_type"))
    return availability.latest(rows)


NOW = 15_000_000


def constellation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return availability.constellation_status(_live(spark, sf_dir), NOW, {"G": "IIF", "C": "GEO", "R": "GLONASS-M"})


def constellation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return availability.constellation_totals(_live(spark, sf_dir))


def groups_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return availability.groups_present(_live(spark, sf_dir))


def satellite_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Satellites of events and of orders; the latter's numbers are moved, so that some are on one side only."""
    user = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 150 + 40).alias("user"))
    sys = F.substring(F.lit("GRECJIS"), (F.col("user") % 7 + 1).cast("int"), F.lit(1))
    eph = user.select(F.concat(sys, F.lpad(F.floor(F.col("user") / 7 + 1).cast("string"), 2, "0")).alias("prn"), sys.alias("sys"))
    return availability.satellite_panel(observations(spark, sf_dir), eph)


def panel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each system the satellites of the panel on either side."""
    return availability.panel_groups(satellite_panel(spark, sf_dir))


def health_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir)
    n = S.number(F.col("prn"))
    return live.select("prn", S.health_text(F.col("prn"), F.col("health")).alias("text"), S.qzss_bits(F.col("health")).alias("bits"), S.beidou_generation(n).alias("generation"))


_NAMED = (
    nearest_ephemeris, elevation_lookup, availability_matrix, availability_navigation_only, navigation_summary, sky_signal, merged_files, msm_groups, constellation_status, constellation_totals, groups_present,
    satellite_panel, panel_groups, health_texts,
)
QUERIES = {f.__name__: f for f in _NAMED}

_AGE = "CASE WHEN substr({p}, 1, 1) IN ('R', 'S') THEN 1800000 ELSE 14400000 END"
_DAY = f"{EPH.replace('eph AS', 'eph0 AS')}, eph AS (SELECT prn, sys, 1704067200000 + ord * 1337777 % 2500000000 AS toc_ms, ord, healthy FROM eph0), {OBS}, seen AS (SELECT DISTINCT t_ms, prn FROM obs WHERE code LIKE 'S%' AND value > 0)"
#: The bins' axis is one row and meets satellites by a column of ones; ephemerides meet bins by buckets of four hours and their neighbours.
_CELLS = f"""
ax AS (SELECT one, a, n, (b - a)::DOUBLE / n AS w FROM (SELECT one, a, b, CAST(least(97, greatest(10, ceil((b - a) / 60000.0))) AS INT) AS n FROM ax0)),
c0 AS (SELECT prn, a, w, unnest(range(0, n)) AS bin FROM prns JOIN ax USING (one)),
c AS (SELECT prn, bin, a + (bin + 0.5::DOUBLE) * w AS t FROM c0),
cb AS (SELECT prn, bin, t, CAST(floor(t / 14400000) AS BIGINT) AS k FROM c),
eb AS (SELECT prn, toc_ms, ord, healthy, toc_ms // 14400000 - 1 AS k FROM eph
  UNION ALL SELECT prn, toc_ms, ord, healthy, toc_ms // 14400000 AS k FROM eph
  UNION ALL SELECT prn, toc_ms, ord, healthy, toc_ms // 14400000 + 1 AS k FROM eph),
met AS (SELECT prn, bin, abs(t - toc_ms) AS gap, ord, healthy FROM cb JOIN eb USING (prn, k)),
best AS (SELECT prn, bin, min_by(healthy, (gap, ord)) AS ok FROM met WHERE gap <= {_AGE.format(p="prn")} GROUP BY prn, bin)"""
_LIVE = """lv AS (SELECT prn, max_by({'r': r, 'h': h, 's': s}, r) AS e FROM (SELECT CASE substr('GERCJS', CAST(o_custkey % 6 + 1 AS INT), 1) WHEN 'S' THEN 'S' || (120 + o_custkey % 40) ELSE substr('GERCJS', CAST(o_custkey % 6 + 1 AS INT), 1) || lpad((o_custkey % 40 + 1)::VARCHAR, 2, '0') END AS prn,
  o_orderkey * 1000 AS r, CAST(o_orderkey % 7 * CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 9 END AS INT) AS h, CAST(o_orderkey % 3 AS INT) AS s FROM orders) GROUP BY prn),
live AS (SELECT prn, substr(prn, 1, 1) AS sys, CAST(substr(prn, 2) AS INT) AS n, e.r AS r, e.h AS h, e.s AS s FROM lv)"""
_OK = "CASE WHEN sys = 'J' THEN h & 32 = 0 ELSE h = 0 END"


def _in(numbers) -> str:
    return "n IN (" + ", ".join(map(str, numbers)) + ")"


_GROUP = (
    "CASE sys WHEN 'G' THEN CASE " + " ".join(f"WHEN n = {n} THEN '{b}'" for n, b in S.GPS_BLOCKS.items()) + " ELSE 'Unknown' END WHEN 'E' THEN CASE WHEN n IN (14, 18) THEN 'FOC (eccentric)' WHEN n IN (11, 12, 19, 20) THEN 'IOV' ELSE 'FOC' END"
    " WHEN 'R' THEN CASE s WHEN 1 THEN 'GLONASS-M' WHEN 0 THEN 'GLONASS' ELSE 'Unknown' END WHEN 'C' THEN CASE WHEN n <= 5 THEN 'GEO' WHEN n <= 10 OR n = 16 THEN 'IGSO' WHEN n BETWEEN 11 AND 14 THEN 'MEO (BDS-2)' WHEN n BETWEEN 38 AND 40 THEN 'IGSO (BDS-3)'"
    " WHEN n BETWEEN 19 AND 46 THEN 'MEO (BDS-3)' WHEN n BETWEEN 56 AND 63 THEN 'BDS-3' ELSE 'Other' END WHEN 'J' THEN CASE n WHEN 3 THEN 'GEO' ELSE 'QZO' END WHEN 'S' THEN CASE " + " ".join(f"WHEN {_in(v)} THEN '{k}'" for k, v in S.SBAS_SYSTEMS.items()) + " ELSE 'Other' END END"
)
_SLOTS = " UNION ALL ".join(f"SELECT '{k}' AS sys, '{k}' || lpad(i::VARCHAR, {d}, '0') AS prn, i::INT AS n FROM (SELECT unnest(range({a}, {b + 1})) AS i)" for k, (a, b, d) in S.SLOTS.items())
_HEALTH = "CASE h & 31 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(S.GPS_HEALTH)) + " END"

_PANEL = f"""WITH {OBS}, a AS (SELECT DISTINCT prn, 1 AS o FROM obs), b AS (SELECT DISTINCT substr('GRECJIS', CAST((o_custkey % 150 + 40) % 7 + 1 AS INT), 1) || lpad(CAST((o_custkey % 150 + 40) // 7 + 1 AS VARCHAR), 2, '0') AS prn, 1 AS e FROM orders), panel AS (SELECT prn, o IS NOT NULL AS observed, e IS NOT NULL AS has_eph, CAST((instr('GRECJIS', substr(prn, 1, 1)) - 1) * 1000 + CAST(substr(prn, 2) AS INT) AS INT) AS place FROM a FULL JOIN b USING (prn))"""
ORACLE_SQL = {
    "nearest_ephemeris": f"""WITH {EPH}, {_TARGETS}, b AS (SELECT tg.prn, t_ms, min_by(struct_pack(toc_ms := toc_ms, ord := ord, healthy := healthy), (abs(t_ms - toc_ms), ord)) AS e FROM tg JOIN eph ON eph.prn = tg.prn AND abs(t_ms - toc_ms) <= {_AGE.format(p="tg.prn")} GROUP BY ALL)
        SELECT prn, t_ms, e.toc_ms AS toc_ms, e.ord AS ord, e.healthy AS healthy FROM tg LEFT JOIN b USING (prn, t_ms)""",
    "elevation_lookup": f"""WITH {POSITIONS}, pt AS (SELECT event_id AS id, 'G' || lpad((user_id * 3 % 20 + 1)::VARCHAR, 2, '0') AS prn, epoch_us(ts) // 1000 AS t_ms FROM events),
        b AS (SELECT id, min_by(el, (abs(pt.t_ms - pos.t_ms), -pos.t_ms)) AS el FROM pt JOIN pos ON pos.prn = pt.prn AND abs(pt.t_ms - pos.t_ms) <= 60000 WHERE el <> 0 GROUP BY 1) SELECT id, prn, t_ms, round(el, 9) AS el FROM pt LEFT JOIN b USING (id)""",
    "availability_matrix": f"""WITH {_DAY},
ends AS (SELECT min(toc_ms) - 7200000 AS lo, max(toc_ms) + 7200000 AS hi FROM eph UNION ALL SELECT min(t_ms), max(t_ms) FROM seen),
ax0 AS (SELECT 1 AS one, min(lo) AS a, max(hi) AS b FROM ends),
prns AS (SELECT prn, 1 AS one FROM eph UNION SELECT prn, 1 FROM seen), {_CELLS},
sx AS (SELECT prn, t_ms, 1 AS one FROM seen),
so AS (SELECT DISTINCT prn, CAST(floor((t_ms - a) / w) AS INT) AS bin, 1 AS s FROM sx JOIN ax USING (one))
SELECT substr(prn, 1, 1) AS sys, prn, CAST(bin AS INT) AS bin, t AS t_ms, CASE WHEN s = 1 AND ok THEN 3 WHEN s = 1 AND NOT ok THEN 4 WHEN s = 1 THEN 5 WHEN ok THEN 6 WHEN NOT ok THEN 2 ELSE 0 END AS state
FROM c LEFT JOIN best USING (prn, bin) LEFT JOIN so USING (prn, bin)""",
    "availability_navigation_only": f"""WITH {_DAY},
ax0 AS (SELECT 1 AS one, min(toc_ms) - 7200000 AS a, max(toc_ms) + 7200000 AS b FROM eph),
prns AS (SELECT DISTINCT prn, 1 AS one FROM eph), {_CELLS}
SELECT substr(prn, 1, 1) AS sys, prn, CAST(bin AS INT) AS bin, t AS t_ms, CASE WHEN ok THEN 1 WHEN NOT ok THEN 2 ELSE 0 END AS state
FROM c LEFT JOIN best USING (prn, bin)""",
    "navigation_summary": f"WITH {EPH} SELECT sys, count(DISTINCT prn) AS satellites, count(*) AS ephemerides, min(toc_ms) AS start_ms, max(toc_ms) AS end_ms, (max(toc_ms) - min(toc_ms)) / 1000.0 AS duration FROM eph GROUP BY sys",
    "sky_signal": f"""WITH {POSITIONS}, s AS (SELECT (epoch_us(ts) // 1000) // 30000 * 30000 AS t_ms, 'G' || lpad((user_id % 20 + 1)::VARCHAR, 2, '0') AS prn, max_by(value, event_id) AS snr FROM events GROUP BY ALL)
        SELECT t_ms, prn, '1' AS band, round(el, 9) AS el, snr FROM pos JOIN s USING (t_ms, prn) WHERE el >= radians(10.0)""",
    "merged_files": """SELECT (epoch_us(ts) // 1000) // 3600000 * 3600000 AS t_ms, 'G' AS sys, 'G' || lpad((user_id % 30 + 1)::VARCHAR, 2, '0') AS prn, event_type AS code,
        max_by(value, (event_id % 3, event_id)) FILTER (event_id % 5 <> 0) AS value FROM events GROUP BY ALL""",
    "msm_groups": """SELECT CAST(floor(((epoch_us(ts) // 1000) // 3600000 * 3600000 + event_id % 20) / 10.0 + 0.5) AS BIGINT) * 10 AS time_ms, 'E' || lpad((user_id % 30 + 1)::VARCHAR, 2, '0') AS prn, event_type AS code,
        max_by(value, event_id) FILTER (event_id % 3 <> 0) AS phase, max_by(value % 60, event_id) FILTER (event_id % 4 <> 0) AS cn0 FROM events GROUP BY ALL""",
    "constellation_status": f"""WITH {_LIVE}, sl AS ({_SLOTS}), j AS (SELECT sl.sys, sl.prn, sl.n, r, h, s FROM sl LEFT JOIN live USING (prn)),
        g AS (SELECT *, {_GROUP} AS "group", CASE sys WHEN 'G' THEN 'IIF' WHEN 'C' THEN 'GEO' WHEN 'R' THEN 'GLONASS-M' END AS want, CASE sys WHEN 'G' THEN 7200000 WHEN 'E' THEN 14400000 WHEN 'R' THEN 1800000 WHEN 'C' THEN 3600000 WHEN 'J' THEN 7200000 ELSE 600000 END AS lim FROM j)
        SELECT sys, prn, CASE WHEN r IS NULL THEN 'none' WHEN {NOW} - r > lim THEN 'expired' WHEN {_OK} THEN 'healthy' ELSE 'unhealthy' END AS state, "group", want IS NOT NULL AND NOT ("group" = want AND (sys <> 'R' OR r IS NOT NULL)) AS dimmed FROM g""",
    "constellation_totals": f"WITH {_LIVE} SELECT sys, count(*) AS tracked, count(*) FILTER ({_OK}) AS healthy, count(*) FILTER (NOT ({_OK})) AS unhealthy FROM live GROUP BY sys",
    "groups_present": f"""WITH {_LIVE}, g AS (SELECT DISTINCT sys, {_GROUP} AS "group" FROM live), k AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{n}', {i})" for s, ns in S.GROUPS.items() for i, n in enumerate(ns))}) AS t(sys, "group", place)) SELECT * FROM g JOIN k USING (sys, "group")""",
    "satellite_panel": f"{_PANEL} SELECT * FROM panel",
    "panel_groups": f"{_PANEL} SELECT substr(prn, 1, 1) AS sys, count(*) FILTER (observed) AS observed, count(*) FILTER (has_eph) AS with_eph, min(CASE WHEN instr('{STATUS_ORDER}', substr(prn, 1, 1)) > 0 THEN instr('{STATUS_ORDER}', substr(prn, 1, 1)) - 1 ELSE {len(STATUS_ORDER)} END)::INT AS place FROM panel GROUP BY 1",
    "health_texts": f"""WITH {_LIVE} SELECT prn, CASE WHEN sys IN ('G', 'J') THEN CASE WHEN h >> 5 = 0 THEN 'OK' ELSE 'Bad' END || ': ' || {_HEALTH} WHEN sys = 'E' THEN CASE h {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(S.GALILEO_HEALTH))} ELSE 'Unknown' END ELSE CASE WHEN h = 0 THEN 'OK' ELSE 'Unhealthy' END END AS text,
        concat_ws(',', {", ".join(f"CASE WHEN h & {32 >> i} <> 0 THEN '{b}' END" for i, b in enumerate(S.QZSS_BITS))}) AS bits,
        CASE WHEN n <= 5 THEN 'BDS-2 GEO' WHEN n <= 10 OR n = 16 THEN 'BDS-2 IGSO' WHEN n BETWEEN 11 AND 14 THEN 'BDS-2 MEO' WHEN n BETWEEN 38 AND 40 THEN 'BDS-3 IGSO' WHEN n BETWEEN 19 AND 46 THEN 'BDS-3 MEO' WHEN n BETWEEN 56 AND 63 THEN 'BDS-3' ELSE '—' END AS generation FROM live""",
}
