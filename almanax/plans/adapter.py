"""Observation-shaped views of the driver's general tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanax.model import FREQUENCIES, SPEED_OF_LIGHT
from almanax.session import load, spread

HOUR = 3_600_000
CODES = {"click": "C1C", "view": "L1C", "purchase": "S1C", "signup": "S2W", "error": "L2W"}


def millis(column: str):
    """Unix milliseconds of a timestamp without zone, read as UTC."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly observations from events; of equal keys the greatest event_id wins."""
    e = load(spark, sf_dir, "events")
    sys = F.substring(F.lit("GRECJIS"), (F.col("user_id") % 7 + 1).cast("int"), F.lit(1))
    rows = e.select(
        (F.floor(millis("ts") / HOUR) * HOUR).alias("t_ms"), sys.alias("sys"), F.concat(sys, F.lpad(F.floor(F.col("user_id") / 7 + 1).cast("string"), 2, "0")).alias("prn"),
        F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[F.col("event_type")].alias("code"), (F.col("value") % 60).alias("value"), "event_id",
    )
    return rows.groupBy("t_ms", "sys", "prn", "code").agg(F.max_by("value", "event_id").alias("value"))


OBS = """obs AS (
  SELECT ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS t_ms, substr('GRECJIS', CAST(user_id % 7 + 1 AS INT), 1) AS sys,
         substr('GRECJIS', CAST(user_id % 7 + 1 AS INT), 1) || lpad(CAST(user_id // 7 + 1 AS VARCHAR), 2, '0') AS prn,
         CASE event_type WHEN 'click' THEN 'C1C' WHEN 'view' THEN 'L1C' WHEN 'purchase' THEN 'S1C' WHEN 'signup' THEN 'S2W' WHEN 'error' THEN 'L2W' END AS code,
         max_by(value % 60, event_id) AS value
  FROM events GROUP BY ALL)"""


def ephemerides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prn, sys, toc_ms, ord and healthy from orders."""
    o = load(spark, sf_dir, "orders")
    user = F.col("o_custkey") % 150
    sys = F.substring(F.lit("GRECJIS"), (user % 7 + 1).cast("int"), F.lit(1))
    return o.select(F.concat(sys, F.lpad(F.floor(user / 7 + 1).cast("string"), 2, "0")).alias("prn"), sys.alias("sys"), millis("o_orderdate").alias("toc_ms"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") != "P").alias("healthy"))


EPH = """eph AS (
  SELECT substr('GRECJIS', CAST((o_custkey % 150) % 7 + 1 AS INT), 1) || lpad(CAST((o_custkey % 150) // 7 + 1 AS VARCHAR), 2, '0') AS prn,
         substr('GRECJIS', CAST((o_custkey % 150) % 7 + 1 AS INT), 1) AS sys, (epoch_us(o_orderdate) // 1000) AS toc_ms, o_orderkey AS ord, o_orderstatus <> 'P' AS healthy
  FROM orders)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat and lon in degrees and h in metres, from customers; dealt over all cores."""
    c = spread(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 179 - 89).cast("double").alias("lat"), (F.col("c_custkey") * 13 % 359 - 179).cast("double").alias("lon"), F.col("c_acctbal").alias("h"))


PLACES = "places AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 179 - 89 AS DOUBLE) AS lat, CAST(c_custkey * 13 % 359 - 179 AS DOUBLE) AS lon, c_acctbal AS h FROM customer)"


def dual_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS pseudoranges and phases on two bands every 30 s from all events, with noise and slips that the event's number sets, and 8 epochs left out after each 92."""
    e = load(spark, sf_dir, "events")
    i, n = F.floor(F.col("event_id") / 20), F.col("event_id") % 20 + 1
    reach = 2e7 + 800.0 * i * 30
    jump = F.when(n % 3 == 0, 50.0 * F.floor(i / 70)).otherwise(0.0)
    rows = e.select(
        ((i + F.floor(i / 92) * 8) * 30_000).alias("t_ms"), F.concat(F.lit("G"), F.lpad(n.cast("string"), 2, "0")).alias("prn"),
        F.create_map(F.lit("C1C"), reach + F.col("value") % 2, F.lit("L1C"), reach / L1 + 1e6 + jump, F.lit("C2W"), reach + F.col("value") % 1, F.lit("L2W"), F.when(F.col("event_id") % 37 != 0, reach / L2 + 2e6)).alias("v"),
    )
    return rows.select("t_ms", F.lit("G").alias("sys"), "prn", F.explode("v").alias("code", "value"))


L1, L2 = SPEED_OF_LIGHT / FREQUENCIES["G"]["1"], SPEED_OF_LIGHT / FREQUENCIES["G"]["2"]
DUAL = f"""ev AS (SELECT event_id, event_id // 20 AS i, event_id % 20 + 1 AS n, value, 2e7 + 800.0::DOUBLE * (event_id // 20) * 30 AS r FROM events),
du AS (SELECT (i + i // 92 * 8) * 30000 AS t_ms, 'G' || lpad(n::VARCHAR, 2, '0') AS prn, r + value % 2 AS c1, r / {L1!r} + 1e6 + CASE WHEN n % 3 = 0 THEN 50.0 * (i // 70) ELSE 0 END AS l1, r + value % 1 AS c2,
       CASE WHEN event_id % 37 <> 0 THEN r / {L2!r} + 2e6 END AS l2 FROM ev)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t_ms (half minutes), prn, lat, lon, az and el in radians from events; of equal keys the greatest event_id."""
    e = load(spark, sf_dir, "events")
    prn = F.concat(F.lit("G"), F.lpad((F.col("user_id") % 20 + 1).cast("string"), 2, "0"))
    at = lambda x: F.radians(x)
    rows = e.select(
        (F.floor(millis("ts") / 30_000) * 30_000).alias("t_ms"), prn.alias("prn"), "event_id",
        F.struct(at(F.col("event_id") * 7 % 120 - 60).alias("lat"), at(F.col("event_id") * 13 % 360 - 180).alias("lon"), at(F.col("event_id") * 17 % 360).alias("az"), at(F.col("event_id") * 11 % 100 - 10).alias("el")).alias("p"),
    )
    return rows.groupBy("t_ms", "prn").agg(F.max_by("p", "event_id").alias("p")).select("t_ms", "prn", "p.*")


POSITIONS = """pos AS (SELECT t_ms, prn, radians(e * 7 % 120 - 60) AS lat, radians(e * 13 % 360 - 180) AS lon, radians(e * 17 % 360) AS az, radians(e * 11 % 100 - 10) AS el
  FROM (SELECT (epoch_us(ts) // 1000) // 30000 * 30000 AS t_ms, 'G' || lpad((user_id % 20 + 1)::VARCHAR, 2, '0') AS prn, max(event_id) AS e FROM events GROUP BY ALL))"""
