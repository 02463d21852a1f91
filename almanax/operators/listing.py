"""Small listings: loaded files, polled status, time axes and elevation heat maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanax.operators.grid import strided
from almanax.sources.names import is_navigation_name, navigation_system

#: Order of the groups of loaded files; fixed values.
FILE_GROUPS = "GRECJISM?"
HOUR_MS = 3_600_000
#: What a satellite's entry in a status answer may hold.
STATUS = "struct<updatedAt: bigint, satellites: map<string, struct<prn: string, health: int, satType: int, week: int, toe: double, toc: double, tb: int, lastReceived: bigint>>>"


def loaded_files(files: DataFrame) -> DataFrame:
    """kind, system (of navigation files, ? if unknown), files, bytes and place, of rows (name, size)."""
    nav = is_navigation_name(F.col("name"))
    system = F.when(nav, F.coalesce(navigation_system(F.col("name")), F.lit("?")))
    out = files.groupBy(F.when(nav, "nav").otherwise("obs").alias("kind"), system.alias("system")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return out.withColumn("place", F.when(F.col("system").isNull(), -1).otherwise(F.call_function("instr", F.lit(FILE_GROUPS), F.col("system")) - 1))


def polled_status(answers: DataFrame) -> DataFrame:
    """prn, received_ms, health, sat_type, week, toe, toc and tb of JSON answers (column json), a row per satellite and answer."""
    j = answers.select(F.from_json("json", STATUS).alias("j"))
    return j.select("j.updatedAt", F.explode("j.satellites").alias("prn", "s")).select("prn", F.col("s.lastReceived").alias("received_ms"), "s.health", F.col("s.satType").alias("sat_type"), "s.week", "s.toe", "s.toc", "s.tb")


def time_ticks(span: DataFrame) -> DataFrame:
    """t_ms of axis labels over rows (start_ms, end_ms): whole multiples of 1 to 4 hours by the length; both ends if there is at most one."""
    hours = (F.col("end_ms") - F.col("start_ms")) / HOUR_MS
    step = (F.when(hours <= 6, 1).when(hours <= 12, 2).when(hours <= 18, 3).otherwise(4) * HOUR_MS).cast("long")
    first = F.ceil(F.col("start_ms") / step) * step
    inner = F.when(first <= F.col("end_ms"), F.sequence(first, F.col("end_ms"), step)).otherwise(F.array().cast("array<bigint>"))
    ticks = F.when(F.size(inner) <= 1, F.array_distinct(F.array_sort(F.concat(F.array("start_ms"), inner, F.array("end_ms"))))).otherwise(inner)
    return span.select(F.explode(ticks).alias("t_ms"))


def elevation_heatmap(positions: DataFrame, most: int = 600) -> DataFrame:
    """t_ms, prn and el (degrees; NULL without a position) of every step-th epoch and every satellite of the data."""
    times = strided(positions.select("t_ms").distinct(), most)
    prns = positions.agg(F.array_sort(F.collect_set("prn")).alias("prns"))  # satellites are at most a few hundred
    grid = times.crossJoin(F.broadcast(prns)).select("t_ms", F.explode("prns").alias("prn"))
    return grid.join(positions.select("t_ms", "prn", F.degrees("el").alias("el")), ["t_ms", "prn"], "left")
