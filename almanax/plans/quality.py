"""Queries on completeness, arcs, multipath, cycle slips and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from almanax.model import FREQUENCIES
from almanax.operators import asof
from almanax.operators import quality as Q
from almanax.plans.adapter import DUAL, L1, L2, OBS, POSITIONS, dual_frequency, observations, positions
from almanax.session import load

INTERVAL = 30_000
#: Added before rounding to two digits: inputs have two digits and arcs' means are fractions of at most 92 parts, from whose ties it keeps off.
OFF_TIES = 0.00381966


def completeness_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.completeness_cells(observations(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


def completeness_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.completeness_signals(Q.completeness_cells(observations(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


def completeness_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.completeness_total(Q.completeness_cells(observations(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


def completeness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Q.completeness_cells(observations(spark, sf_dir)).withColumn("percent", F.round("percent", 6))
    return Q.completeness_matrix(cells, ["C1C", "L1C", "S1C", "L2W", "S2W"])


def phase_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs of each satellite's band: first and last time and length."""
    p = Q.pairs(dual_frequency(spark, sf_dir)).where("phase is not null")
    rows = Q.arcs(p.select("t_ms", "prn", "band"), ["prn", "band"], INTERVAL)
    return rows.groupBy("prn", "band", "arc").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))


def _mp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.multipath(dual_frequency(spark, sf_dir), INTERVAL)


def multipath_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mp(spark, sf_dir).withColumn("mp", F.round(F.col("mp") + OFF_TIES, 2))


def multipath_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.multipath_series(_mp(spark, sf_dir)).withColumn("rms", F.round("rms", 5))


def multipath_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.multipath_signals(_mp(spark, sf_dir)).withColumn("rms", F.round("rms", 5))


def multipath_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.multipath_distribution(_mp(spark, sf_dir))


def multipath_first_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.first_series(Q.multipath_series(_mp(spark, sf_dir)))


def multipath_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.pooled_rms(_mp(spark, sf_dir)).withColumn("rms", F.round("rms", 5))


def multipath_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.multipath_heatmap(_mp(spark, sf_dir), 60).withColumn("mp", F.round(F.col("mp") + 0.0123456, 1))  # moved off the ties that two-digit input makes


def _early_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions moved to the times of the dual-frequency data."""
    p = positions(spark, sf_dir).withColumn("t_ms", F.floor(F.col("t_ms") / 30_000) % 499 * 30_000)
    return p.groupBy("t_ms", "prn").agg(F.max("el").alias("el"))


def multipath_by_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = asof.elevation_lookup(_mp(spark, sf_dir), _early_positions(spark, sf_dir))
    return Q.multipath_by_elevation(points).withColumn("rms", F.round("rms", 5))


def phase_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.phase_jumps(dual_frequency(spark, sf_dir), INTERVAL).withColumn("magnitude", F.round("magnitude", 4))


def geometry_free_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.geometry_free_jumps(dual_frequency(spark, sf_dir), INTERVAL).withColumn("magnitude", F.round("magnitude", 4))


def slip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.slip_counts(Q.phase_jumps(dual_frequency(spark, sf_dir), INTERVAL))


def slip_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = dual_frequency(spark, sf_dir)
    return Q.slip_signals(Q.geometry_free_jumps(obs, INTERVAL), obs).withColumn("rate", F.round("rate", 6))


def multipath_arcs_of_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipath whose arcs end at single-frequency slips."""
    obs = dual_frequency(spark, sf_dir)
    return Q.multipath(obs, INTERVAL, Q.phase_jumps(obs, INTERVAL)).withColumn("mp", F.round(F.col("mp") + OFF_TIES, 2))


def _two_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same satellites at the same times seen by two stations, of which the second has gaps of its own and a jump."""
    obs = dual_frequency(spark, sf_dir)
    i = F.floor(F.col("t_ms") / 30_000)
    jump = F.when((F.col("code") == "L1C") & (i % 40 >= 25), F.col("value") + 9.0).otherwise(F.col("value"))
    second = obs.where(i % 40 >= 8).withColumn("value", jump).withColumn("station", F.lit("B"))
    return obs.withColumn("station", F.lit("A")).unionByName(second)


def station_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry-free slips of two stations, each by its own arcs."""
    return Q.geometry_free_jumps(_two_stations(spark, sf_dir), INTERVAL).withColumn("magnitude", F.round("magnitude", 4))


def station_multipath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipath series of two stations."""
    return Q.multipath_series(Q.multipath(_two_stations(spark, sf_dir), INTERVAL)).withColumn("rms", F.round("rms", 5))


def wide_lane_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.wide_lane_jumps(dual_frequency(spark, sf_dir), INTERVAL).withColumn("magnitude", F.round("magnitude", 4))


def cycle_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three detectors."""
    return Q.cycle_slips(dual_frequency(spark, sf_dir), INTERVAL).withColumn("magnitude", F.round("magnitude", 4))


def elevation_cn0(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    snr = p.select("t_ms", "prn", F.lit("1").alias("band"), (F.degrees("lat") % 17 + 30).alias("snr"))
    out = Q.elevation_cn0(asof.sky_signal(p.where("el >= 0").select("t_ms", "prn", "el"), snr))
    return out.withColumn("cn0", F.round("cn0", 1))


def sky_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each satellite's track above 20 degrees: a position below parts them."""
    w = W.partitionBy("prn").orderBy("t_ms")
    p = positions(spark, sf_dir).withColumn("up", F.degrees("el") >= 20).withColumn("before", F.lag("up").over(w))
    rows = Q.islands(p, ["prn"], F.col("up") & F.col("before")).where("up")
    return rows.groupBy("prn", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms")).drop("segment")


def ground_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each satellite's ground track, cut where it crosses the antimeridian."""
    w = W.partitionBy("prn").orderBy("t_ms")
    p = positions(spark, sf_dir).withColumn("near", F.abs(F.degrees("lon") - F.lag(F.degrees("lon")).over(w)) <= 180)
    rows = Q.islands(p, ["prn"], F.col("near"))
    return rows.groupBy("prn", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("start_ms"))


def observation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.warnings(dual_frequency(spark, sf_dir), INTERVAL).drop("examples")


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations every half minute, with faults that the event's number sets."""
    k = F.col("event_id")
    e = load(spark, sf_dir, "events").select("event_id", "value")
    t = k * 30_000 + F.when(k % 101 >= 51, 600_000).otherwise(0) + F.when(k % 67 == 0, 7_000).otherwise(0)
    obs = e.select(
        F.when(k % 79 != 0, t).alias("t_ms"), F.lit("G").alias("sys"), F.when(k % 89 == 0, "X1").otherwise(F.concat(F.lit("G"), F.lpad((k % 20 + 1).cast("string"), 2, "0"))).alias("prn"),
        F.when(k % 83 == 0, "Q9").otherwise("C1C").alias("code"), F.when(k % 73 == 0, -F.col("value")).otherwise(F.col("value") + 1).alias("value"), "event_id",
    )
    return obs.unionByName(obs.where("event_id % 97 = 0")).drop("event_id")


_HEADER = {"marker_name": "ALMA", "approx_position": (1.0, 2.0, 3.0)}


def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule's objections with their first three examples."""
    return Q.warnings(_faulty(spark, sf_dir), INTERVAL, _HEADER, 3).withColumn("examples", F.array_join("examples", "; "))


def validation_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.severities(Q.warnings(_faulty(spark, sf_dir), INTERVAL, _HEADER))


_NAMED = (
    completeness_cells, completeness_signals, completeness_total, completeness_matrix, phase_arcs, multipath_points, multipath_series, multipath_signals, multipath_distribution, multipath_first_series, multipath_pooled,
    multipath_heatmap, multipath_by_elevation, phase_jumps, geometry_free_jumps, slip_counts, slip_signals, cycle_slips, wide_lane_jumps, multipath_arcs_of_slips, station_slips, station_multipath, elevation_cn0, sky_tracks, ground_tracks, observation_warnings, validation_findings, validation_severities,
)
QUERIES = {f.__name__: f for f in _NAMED}

_CELLS = f"""WITH {OBS}, f AS (SELECT prn, code, min(t_ms) AS first_ms, count(*) AS present FROM obs WHERE value IS NOT NULL AND value <> 0 GROUP BY ALL), ep AS (SELECT DISTINCT prn, t_ms FROM obs),
cells AS (SELECT prn, code, count(*) AS expected, any_value(present) AS present, 100.0 * any_value(present) / count(*) AS percent FROM ep JOIN f USING (prn) WHERE t_ms >= first_ms GROUP BY ALL)"""
_F1, _F2 = FREQUENCIES["G"]["1"], FREQUENCIES["G"]["2"]
_A12, _A21 = (_F1 / _F2) ** 2, (_F2 / _F1) ** 2


def _raw(c: str, a: float, i: str, j: str) -> str:
    return f"({c} - {i}) - {2 / (a - 1)!r} * ({i} - {j})"


_MP = f"""WITH {DUAL}, bo AS (SELECT * FROM du WHERE l2 IS NOT NULL),
raw AS (SELECT t_ms, prn, '1' AS band, '2' AS ref, {_raw("c1", _A12, f"l1 * {L1!r}", f"l2 * {L2!r}")} AS raw FROM bo UNION ALL SELECT t_ms, prn, '2', '1', {_raw("c2", _A21, f"l2 * {L2!r}", f"l1 * {L1!r}")} FROM bo),
lg AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY prn, band ORDER BY t_ms) > 150000 THEN 1 ELSE 0 END AS nw FROM raw),
ar AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY prn, band ORDER BY t_ms) AS BIGINT) AS arc FROM lg),
mn AS (SELECT *, avg(raw) OVER (PARTITION BY prn, band, arc) AS m, count(*) OVER (PARTITION BY prn, band, arc) AS n FROM ar),
mp AS (SELECT t_ms, 'G' AS sys, prn, band, ref, arc, raw - m AS mp FROM mn WHERE n >= 10)"""
_SF = f"""WITH {DUAL}, b AS (SELECT t_ms, prn, '1' AS band, l1 * {L1!r} - c1 AS d FROM du UNION ALL SELECT t_ms, prn, '2', l2 * {L2!r} - c2 FROM du WHERE l2 IS NOT NULL),
s AS (SELECT *, t_ms - lag(t_ms) OVER w AS gap, d - lag(d) OVER w AS step FROM b WINDOW w AS (PARTITION BY prn, band ORDER BY t_ms)),
sf AS (SELECT t_ms, 'G' AS sys, prn, 'SF ' || band AS signal, abs(step) AS magnitude FROM s WHERE gap <= 150000 AND abs(step) > 3.0)"""
_GF = f"""WITH {DUAL}, b AS (SELECT t_ms, prn, l1 * {L1!r} - l2 * {L2!r} AS gf FROM du WHERE l2 IS NOT NULL),
a0 AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY prn ORDER BY t_ms) > 150000 THEN 1 ELSE 0 END AS nw FROM b), a AS (SELECT *, sum(nw) OVER (PARTITION BY prn ORDER BY t_ms) AS arc FROM a0),
s AS (SELECT *, gf - lag(gf) OVER (PARTITION BY prn, arc ORDER BY t_ms) AS step FROM a), s2 AS (SELECT *, coalesce(lag(step) OVER (PARTITION BY prn, arc ORDER BY t_ms), 0) AS bef FROM s),
gf AS (SELECT t_ms, 'G' AS sys, prn, 'GF 1-2' AS signal, abs(step - bef) AS magnitude FROM s2 WHERE abs(step - bef) > 0.15 AND NOT abs(bef) > 0.15)"""

#: Melbourne-Wuebbena: the figures of a satellite's rows, one after another.
_MW = f"""{_GF.replace("WITH ", "WITH RECURSIVE ", 1)}, mo AS MATERIALIZED (SELECT prn, t_ms, l1 - l2 - ({_F1!r} * c1 + {_F2!r} * c2) / ({_F1!r} + {_F2!r}) * ({_F1!r} - {_F2!r}) / 299792458.0::DOUBLE AS mw, row_number() OVER (PARTITION BY prn ORDER BY t_ms) AS rn FROM du WHERE l2 IS NOT NULL),
rc(prn, rn, t_ms, n, mean, spread, mag) AS (SELECT prn, rn, t_ms, 1, mw, {Q.MW_START_SIGMA**2!r}::DOUBLE, NULL::DOUBLE FROM mo WHERE rn = 1
  UNION ALL SELECT prn, rn, t_ms, CASE WHEN hit THEN 1 ELSE n + 1 END, CASE WHEN hit OR n = 0 THEN mw ELSE mean + (mw - mean) / (n + 1) END, CASE WHEN hit OR n = 0 THEN {Q.MW_START_SIGMA**2!r}::DOUBLE ELSE spread + ((mw - mean) * (mw - mean) - spread) / (n + 1) END, CASE WHEN hit THEN abs(mw - mean) END
  FROM (SELECT *, n >= 2 AND abs(mw - mean) > greatest({float(Q.MW_SIGMAS)!r} * sqrt(spread), {float(Q.MW_CYCLES)!r}) AS hit
    FROM (SELECT mo.prn, mo.rn, mo.t_ms, mo.mw, rc.mean, rc.spread, CASE WHEN mo.t_ms - rc.t_ms > 150000 THEN 0 ELSE rc.n END AS n FROM rc JOIN mo ON mo.prn = rc.prn AND mo.rn = rc.rn + 1))),
mw AS (SELECT t_ms, 'G' AS sys, prn, 'MW 1-2' AS signal, mag AS magnitude FROM rc WHERE mag IS NOT NULL)"""
#: The two stations' rows.
_TWO = f"""WITH {DUAL}, ds AS (SELECT 'A' AS station, * FROM du UNION ALL SELECT 'B', * REPLACE (CASE WHEN t_ms // 30000 % 40 >= 25 THEN l1 + 9.0::DOUBLE ELSE l1 END AS l1) FROM du WHERE t_ms // 30000 % 40 >= 8)"""

_FAULTY = """WITH e AS (SELECT event_id AS k, value FROM events),
o0 AS (SELECT k, CASE WHEN k % 79 <> 0 THEN k * 30000 + CASE WHEN k % 101 >= 51 THEN 600000 ELSE 0 END + CASE WHEN k % 67 = 0 THEN 7000 ELSE 0 END END AS t_ms,
  CASE WHEN k % 89 = 0 THEN 'X1' ELSE 'G' || lpad((k % 20 + 1)::VARCHAR, 2, '0') END AS prn, CASE WHEN k % 83 = 0 THEN 'Q9' ELSE 'C1C' END AS code, CASE WHEN k % 73 = 0 THEN -value ELSE value + 1 END AS value FROM e),
o AS (SELECT * FROM o0 UNION ALL SELECT * FROM o0 WHERE k % 97 = 0),
c AS (SELECT t_ms, prn, code, count(*) AS c, min(value) AS least, prn || ' ' || code || ' ' || coalesce(t_ms::VARCHAR, '-') AS example FROM o GROUP BY t_ms, prn, code),
s AS (SELECT t_ms, t_ms - lag(t_ms) OVER (ORDER BY t_ms) AS step FROM (SELECT DISTINCT t_ms FROM o WHERE t_ms IS NOT NULL)),
f AS (SELECT 'no_time' AS rule, t_ms, example FROM c WHERE t_ms IS NULL UNION ALL SELECT 'duplicate', t_ms, example FROM c WHERE c > 1 UNION ALL SELECT 'bad_satellite', t_ms, example FROM c WHERE prn = 'X1'
  UNION ALL SELECT 'bad_code', t_ms, example FROM c WHERE code = 'Q9' UNION ALL SELECT 'bad_range', t_ms, example FROM c WHERE code = 'C1C' AND least < 0
  UNION ALL SELECT CASE WHEN step > 150000 THEN 'gap' ELSE 'irregular' END, t_ms, step || ' ms to ' || t_ms FROM s WHERE step > 150000 OR step % 30000 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY t_ms NULLS FIRST, example) AS n FROM f),
g AS (SELECT rule, count(*) AS count, min(t_ms) AS first_ms, string_agg(example, '; ' ORDER BY n) FILTER (n <= 3) AS examples FROM n GROUP BY rule),
m AS (SELECT rule AS code, """ + "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in Q.RULES.items()) + " END AS severity, CASE rule " + " ".join(f"WHEN '{k}' THEN '{v[1].replace(chr(39), chr(39) * 2)}'" for k, v in Q.RULES.items()) + """ END AS message, count, first_ms, examples FROM g
  UNION ALL SELECT 'missing_header', 'error', 'header lacks interval', 1, NULL, 'interval')"""

ORACLE_SQL = {
    "validation_findings": f"{_FAULTY} SELECT * FROM m",
    "validation_severities": f"{_FAULTY} SELECT CAST(coalesce(sum(count) FILTER (severity = 'error'), 0) AS BIGINT) AS errors, CAST(coalesce(sum(count) FILTER (severity = 'warning'), 0) AS BIGINT) AS warnings, CAST(coalesce(sum(count) FILTER (severity = 'info'), 0) AS BIGINT) AS info FROM m",
    "wide_lane_jumps": f"{_MW} SELECT t_ms, sys, prn, signal, round(magnitude, 4) AS magnitude FROM mw",
    "cycle_slips": f"""{_MW}{_SF[_SF.index(", b AS"):].replace(", b AS", ", bs AS").replace("FROM b ", "FROM bs ").replace("\ns AS", "\nss AS").replace("FROM s ", "FROM ss ")}, al AS (SELECT *, 0 AS k FROM mw UNION ALL SELECT *, 1 FROM gf UNION ALL SELECT *, 2 FROM sf)
        SELECT t_ms, sys, prn, signal, round(magnitude, 4) AS magnitude FROM al QUALIFY k = min(k) OVER (PARTITION BY prn, t_ms)""",
    "multipath_arcs_of_slips": f"""{_SF}, k AS (SELECT DISTINCT prn, t_ms, 1 AS slip FROM sf){_MP[_MP.index(", bo AS"):].replace("FROM raw)", "FROM raw LEFT JOIN k USING (prn, t_ms))").replace("> 150000 THEN 1", "> 150000 OR slip = 1 THEN 1").replace("SELECT *, CASE WHEN t_ms - lag", "SELECT raw.*, CASE WHEN t_ms - lag")}
        SELECT t_ms, sys, prn, band, ref, arc, round(mp + {OFF_TIES!r}::DOUBLE, 2) AS mp FROM mp""",
    "station_slips": f"""{_TWO}, b AS (SELECT station, t_ms, prn, l1 * {L1!r} - l2 * {L2!r} AS gf FROM ds WHERE l2 IS NOT NULL), a0 AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY station, prn ORDER BY t_ms) > 150000 THEN 1 ELSE 0 END AS nw FROM b),
        a AS (SELECT *, sum(nw) OVER (PARTITION BY station, prn ORDER BY t_ms) AS arc FROM a0), s AS (SELECT *, gf - lag(gf) OVER (PARTITION BY station, prn, arc ORDER BY t_ms) AS step FROM a),
        s2 AS (SELECT *, coalesce(lag(step) OVER (PARTITION BY station, prn, arc ORDER BY t_ms), 0) AS bef FROM s)
        SELECT station, t_ms, 'G' AS sys, prn, 'GF 1-2' AS signal, round(abs(step - bef), 4) AS magnitude FROM s2 WHERE abs(step - bef) > 0.15 AND NOT abs(bef) > 0.15""",
    "station_multipath": f"""{_TWO}, bo AS (SELECT * FROM ds WHERE l2 IS NOT NULL),
        raw AS (SELECT station, t_ms, prn, '1' AS band, '2' AS ref, {_raw("c1", _A12, f"l1 * {L1!r}", f"l2 * {L2!r}")} AS raw FROM bo UNION ALL SELECT station, t_ms, prn, '2', '1', {_raw("c2", _A21, f"l2 * {L2!r}", f"l1 * {L1!r}")} FROM bo),
        lg AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY station, prn, band ORDER BY t_ms) > 150000 THEN 1 ELSE 0 END AS nw FROM raw), ar AS (SELECT *, sum(nw) OVER (PARTITION BY station, prn, band ORDER BY t_ms) AS arc FROM lg),
        mn AS (SELECT *, avg(raw) OVER (PARTITION BY station, prn, band, arc) AS m, count(*) OVER (PARTITION BY station, prn, band, arc) AS n FROM ar)
        SELECT station, 'G' AS sys, prn, band, ref, round(sqrt(avg((raw - m) * (raw - m))), 5) AS rms, count(*) AS count FROM mn WHERE n >= 10 GROUP BY ALL""",
    "completeness_cells": f"{_CELLS} SELECT prn, code, expected, present, round(percent, 6) AS percent FROM cells",
    "completeness_signals": f"{_CELLS} SELECT substr(prn, 1, 1) AS sys, code, count(*) AS satellites, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(present) AS BIGINT) AS present, round(100.0 * sum(present) / sum(expected), 6) AS percent FROM cells GROUP BY ALL",
    "completeness_total": f"{_CELLS} SELECT round(100.0 * sum(present) / sum(expected), 6) AS percent FROM cells WHERE expected > 0",
    "completeness_matrix": f"{_CELLS} SELECT prn, " + ", ".join(f'max(round(percent, 6)) FILTER (code = \'{c}\') AS "{c}"' for c in ("C1C", "L1C", "S1C", "L2W", "S2W")) + " FROM cells GROUP BY prn",
    "phase_arcs": f"""WITH {DUAL}, b AS (SELECT t_ms, prn, '1' AS band FROM du UNION ALL SELECT t_ms, prn, '2' FROM du WHERE l2 IS NOT NULL), l AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY prn, band ORDER BY t_ms) > 150000 THEN 1 ELSE 0 END AS nw FROM b),
        a AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY prn, band ORDER BY t_ms) AS BIGINT) AS arc FROM l) SELECT prn, band, arc, min(t_ms) AS start_ms, max(t_ms) AS end_ms, count(*) AS n FROM a GROUP BY ALL""",
    "multipath_points": f"{_MP} SELECT t_ms, sys, prn, band, ref, arc, round(mp + {OFF_TIES!r}::DOUBLE, 2) AS mp FROM mp",
    "multipath_series": f"{_MP} SELECT sys, prn, band, ref, round(sqrt(avg(mp * mp)), 5) AS rms, count(*) AS count FROM mp GROUP BY ALL",
    "multipath_signals": f"{_MP} SELECT sys, band, ref, round(sqrt(avg(mp * mp)), 5) AS rms, count(*) AS count, count(DISTINCT prn) AS satellites FROM mp GROUP BY ALL",
    "multipath_distribution": f"""{_MP}, l AS (SELECT list(mp ORDER BY mp) AS v FROM mp), r AS (SELECT greatest(abs(v[CAST(floor(len(v) * 0.995) AS INT) + 1]), abs(v[CAST(floor(len(v) * 0.005) AS INT) + 1]), 0.1) AS r FROM l),
        c AS (SELECT CAST(least(39, greatest(0, floor((mp + r) / (2 * r / 40)))) AS INT) AS bin, count(*) AS n FROM mp, r GROUP BY 1)
        SELECT CAST(bin AS INT) AS bin, floor((-r + (bin + 0.5) * (2 * r / 40)) * 1000 + 0.5) / 1000 AS mp, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 40)) AS bin) CROSS JOIN r LEFT JOIN c USING (bin)""",
    "multipath_first_series": f"{_MP}, s AS (SELECT sys, prn, band, ref, sqrt(avg(mp * mp)) AS rms FROM mp GROUP BY ALL) SELECT sys, prn, band, ref, floor(rms * 1000 + 0.5) / 1000 AS rms FROM s WHERE band = '1'",
    "multipath_pooled": f"{_MP} SELECT prn, round(sqrt(avg(mp * mp)), 5) AS rms, count(*) AS n FROM mp GROUP BY prn HAVING count(*) >= 10",
    "multipath_heatmap": f"{_MP}, f AS (SELECT * FROM mp WHERE band = '1'), e AS (SELECT min(t_ms) AS a, max(t_ms) AS b FROM f) SELECT prn, CAST(least(59, floor((t_ms - a) / (b - a)::DOUBLE * 60)) AS INT) AS col, round(avg(mp) + 0.0123456, 1) AS mp FROM f, e GROUP BY ALL",
    "multipath_by_elevation": f"""{_MP}, {POSITIONS}, ep AS (SELECT t_ms // 30000 % 499 * 30000 AS p_ms, prn, max(el) AS el FROM pos GROUP BY ALL),
        k AS (SELECT DISTINCT prn, t_ms FROM mp), b AS (SELECT k.prn, k.t_ms, min_by(el, (abs(k.t_ms - p_ms), -p_ms)) AS el FROM k JOIN ep ON ep.prn = k.prn AND abs(k.t_ms - p_ms) <= 60000 WHERE el <> 0 GROUP BY ALL),
        p AS (SELECT sys, mp, CAST(least(floor(degrees(el) / 5), 17) * 5 AS INT) AS low FROM mp JOIN b USING (prn, t_ms) WHERE el > 0)
        SELECT sys, low, CASE WHEN count(*) >= 5 THEN round(sqrt(avg(mp * mp)), 5) END AS rms, count(*) AS n FROM p GROUP BY ALL""",
    "phase_jumps": f"{_SF} SELECT t_ms, sys, prn, signal, round(magnitude, 4) AS magnitude FROM sf",
    "geometry_free_jumps": f"{_GF} SELECT t_ms, sys, prn, signal, round(magnitude, 4) AS magnitude FROM gf",
    "slip_counts": f"{_SF} SELECT prn, count(*) AS slips FROM sf GROUP BY prn",
    "slip_signals": f"""{_GF}, p AS (SELECT '1' AS band, count(*) AS epochs, count(DISTINCT prn) AS satellites FROM du UNION ALL SELECT '2', count(l2), count(DISTINCT prn) FILTER (l2 IS NOT NULL) FROM du)
        SELECT 'G' AS sys, band, (SELECT count(*) FROM gf) AS slips, epochs, satellites, round((SELECT count(*) FROM gf) / epochs * 1000.0, 6) AS rate, 0 AS place FROM p""",
    "elevation_cn0": f"""WITH {POSITIONS}, j AS (SELECT CAST(least(floor(degrees(el)), 89) AS INT) AS bin, degrees(el) AS d, degrees(lat) % 17 + 30 AS snr FROM pos WHERE el >= 0)
        SELECT 'G' AS sys, '1' AS band, bin, CAST(floor(avg(d) + 0.5) AS BIGINT) AS el, round(floor(avg(snr) * 10 + 0.5) / 10, 1) AS cn0 FROM j GROUP BY bin HAVING count(*) >= 2""",
    "sky_tracks": f"""WITH {POSITIONS}, u AS (SELECT prn, t_ms, degrees(el) >= 20 AS up, lag(degrees(el) >= 20) OVER (PARTITION BY prn ORDER BY t_ms) AS bef FROM pos),
        s AS (SELECT *, sum(CASE WHEN up AND bef THEN 0 ELSE 1 END) OVER (PARTITION BY prn ORDER BY t_ms) AS g FROM u) SELECT prn, count(*) AS n, min(t_ms) AS start_ms, max(t_ms) AS end_ms FROM s WHERE up GROUP BY prn, g""",
    "ground_tracks": f"""WITH {POSITIONS}, u AS (SELECT prn, t_ms, abs(degrees(lon) - lag(degrees(lon)) OVER (PARTITION BY prn ORDER BY t_ms)) <= 180 AS near FROM pos),
        s AS (SELECT *, CAST(sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY prn ORDER BY t_ms) AS BIGINT) AS segment FROM u) SELECT prn, segment, count(*) AS n, min(t_ms) AS start_ms FROM s GROUP BY ALL""",
    "observation_warnings": f"WITH {DUAL}, g AS (SELECT t_ms, t_ms - lag(t_ms) OVER (ORDER BY t_ms) AS gap FROM (SELECT DISTINCT t_ms FROM du)) SELECT 'gap' AS code, 'info' AS severity, 'gap in the epochs' AS message, count(*) AS count, min(t_ms) AS first_ms FROM g WHERE gap > 150000 HAVING count(*) > 0",
}
