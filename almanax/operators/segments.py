"""Scans along time by pieces of a day, stitched: no task holds or sorts more than a day of a satellite's rows.

A piece is reduced to a row (its ends and counts); these, one for each day, are scanned by key, and what they carry is handed back to
the pieces' rows. Keys are column names; a key that may be null goes in a struct (see whole_key), as joins leave nulls out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

DAY_MS = 86_400_000


def whole_key(rows: DataFrame, own: list[str]) -> tuple[DataFrame, list[str]]:
    """rows with own, receivers' columns that may be null, as one column that never is, and that column's name."""
    return (rows.withColumn("_own", F.struct(*own)), ["_own"]) if own else (rows, [])


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_day", F.floor(F.col("t_ms") / DAY_MS))


def with_previous(rows: DataFrame, keys: list[str], columns: list[str], name: str = "_before") -> DataFrame:
    """rows with the columns of the key's row before, as a struct; null for a key's first row. A key's times are distinct."""
    at = [*keys, "_day"]
    rows = with_day(rows)
    ends = rows.groupBy(*at).agg(F.max_by(F.struct(*columns), "t_ms").alias("_last"))
    ends = ends.withColumn("_carried", F.lag("_last").over(W.partitionBy(*keys).orderBy("_day"))).drop("_last")  # a row for each day
    inside = rows.withColumn(name, F.lag(F.struct(*columns)).over(W.partitionBy(*at).orderBy("t_ms")))
    return inside.join(ends, at, "left").withColumn(name, F.coalesce(name, "_carried")).drop("_carried", "_day")


def numbered(rows: DataFrame, keys: list[str], gap_ms: int, broken: Column | None = None) -> DataFrame:
    """rows with _day and arc, which counts the key's gaps of over gap_ms, and its rows that are marked as broken, so far."""
    at = [*keys, "_day"]
    rows = with_day(rows).withColumn("_broken", F.lit(False) if broken is None else F.coalesce(broken, F.lit(False)))
    w = W.partitionBy(*at).orderBy("t_ms")
    before = F.lag("t_ms").over(w)
    rows = rows.withColumn("_new", F.when(before.isNotNull() & ((F.col("t_ms") - before > gap_ms) | F.col("_broken")), 1).otherwise(0))
    rows = rows.withColumn("_arc", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = rows.groupBy(*at).agg(F.min("t_ms").alias("_a"), F.max("t_ms").alias("_b"), F.sum("_new").alias("_n"), F.min_by("_broken", "t_ms").alias("_first"))
    days = W.partitionBy(*keys).orderBy("_day")  # a row for each day
    # whether a piece begins an arc, by the piece before; a key's very first row begins one only if it is marked
    opens = F.when((F.col("_a") - F.lag("_b").over(days) > gap_ms) | F.col("_first"), 1).otherwise(0)
    ends = ends.withColumn("_opens", opens).withColumn("_carried", F.sum(F.col("_opens") + F.col("_n")).over(days.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    out = rows.join(ends.select(*at, "_carried"), at)
    return out.withColumn("arc", F.col("_carried") + F.col("_arc")).drop("_broken", "_new", "_arc", "_carried")


def arc_means(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows of numbered() with _mean and _n of the column over each arc: of pieces first, then of arcs, and back by the pieces."""
    at = [*keys, "_day", "arc"]
    part = rows.groupBy(*at).agg(F.sum(column).alias("_s"), F.count(F.lit(1)).alias("_c"))
    whole = part.groupBy(*keys, "arc").agg((F.sum("_s") / F.sum("_c")).alias("_mean"), F.sum("_c").alias("_n"))
    return rows.join(part.select(*at).join(whole, [*keys, "arc"]), at)
