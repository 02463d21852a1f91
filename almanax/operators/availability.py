"""Availability matrices, constellation status and satellite panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanax.functions import status as S
from almanax.functions.timescales import expired
from almanax.model import STATUS_ORDER, SYSTEM_ORDER, system_rank
from almanax.operators.asof import nearest_ephemeris

#: States of a cell; fixed values.
EMPTY, EPH_HEALTHY, EPH_UNHEALTHY, OBS_EPH_HEALTHY, OBS_EPH_UNHEALTHY, OBS_NO_EPH, NOT_OBS_HAS_EPH = range(7)
PAD_MS = 7_200_000


def bins(eph: DataFrame, observed: DataFrame | None = None, most: int = 400) -> DataFrame:
    """One row: start_ms, width_ms and n of the time bins over ephemerides (padded by two hours) and observations."""
    span = eph.agg((F.min("toc_ms") - PAD_MS).alias("a"), (F.max("toc_ms") + PAD_MS).alias("b"))
    if observed is not None:
        span = span.unionByName(observed.agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))).agg(F.min("a").alias("a"), F.max("b").alias("b"))
    n = F.least(F.lit(most), F.greatest(F.lit(10), F.ceil((F.col("b") - F.col("a")) / 60_000))).cast("int")
    return span.select(F.col("a").alias("start_ms"), ((F.col("b") - F.col("a")) / n).alias("width_ms"), n.alias("n"))


def availability(eph: DataFrame, observed: DataFrame | None = None, most: int = 400) -> DataFrame:
    """sys, prn, bin, t_ms (the bin's middle) and state.

    observed: t_ms and prn of satellites with a C/N0. A time is turned into its bin, so that finding it is an equi-join; the last
    bin ends before the last observation.
    """
    axis = bins(eph, observed, most)
    prns = eph.select("prn").unionByName(observed.select("prn")).distinct() if observed is not None else eph.select("prn").distinct()
    grid = prns.crossJoin(F.broadcast(axis)).select("prn", "start_ms", "width_ms", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))  # axis is one row
    cells = grid.select("prn", "bin", (F.col("start_ms") + (F.col("bin") + 0.5) * F.col("width_ms")).alias("t_ms"))
    cells = nearest_ephemeris(cells, eph)
    has, good = F.col("best").isNotNull(), F.col("best.healthy")
    if observed is None:
        state = F.when(has, F.when(good, EPH_HEALTHY).otherwise(EPH_UNHEALTHY)).otherwise(EMPTY)
        out = cells
    else:
        seen = observed.crossJoin(F.broadcast(axis)).select("prn", F.floor((F.col("t_ms") - F.col("start_ms")) / F.col("width_ms")).cast("int").alias("bin")).distinct().withColumn("seen", F.lit(True))
        out = cells.join(seen, ["prn", "bin"], "left")
        saw = F.col("seen").isNotNull()
        state = F.when(saw & has, F.when(good, OBS_EPH_HEALTHY).otherwise(OBS_EPH_UNHEALTHY)).when(saw, OBS_NO_EPH).when(has, F.when(good, NOT_OBS_HAS_EPH).otherwise(EPH_UNHEALTHY)).otherwise(EMPTY)
    return out.select(F.substring("prn", 1, 1).alias("sys"), "prn", "bin", "t_ms", state.alias("state"))


def navigation_summary(eph: DataFrame) -> DataFrame:
    """Per system: satellites, ephemerides, first and last time and duration in seconds."""
    out = eph.groupBy("sys").agg(F.count_distinct("prn").alias("satellites"), F.count(F.lit(1)).alias("ephemerides"), F.min("toc_ms").alias("start_ms"), F.max("toc_ms").alias("end_ms"))
    return out.withColumn("duration", (F.col("end_ms") - F.col("start_ms")) / 1000)


def latest(live: DataFrame, arrival: str = "received_ms") -> DataFrame:
    """The last ephemeris of each satellite."""
    rest = [c for c in live.columns if c != "prn"]
    return live.groupBy("prn").agg(F.max_by(F.struct(*rest), arrival).alias("_e")).select("prn", "_e.*")


def slots(spark: SparkSession) -> DataFrame:
    """sys and prn of every slot; a table of fixed size."""
    rows = [(sys, f"{sys}{i:0{digits}d}") for sys, (first, last, digits) in S.SLOTS.items() for i in range(first, last + 1)]
    return spark.createDataFrame(rows, "sys string, prn string").coalesce(1)


def constellation_status(live: DataFrame, now_ms: int, chosen: dict[str, str] | None = None) -> DataFrame:
    """sys, prn, state (none, expired, healthy, unhealthy), group and dimmed of every slot.

    live: one row per prn with received_ms, health and sat_type. chosen: the group that a system is filtered by.
    """
    all_slots = slots(live.sparkSession)
    both = all_slots.join(live.select("prn", "received_ms", "health", "sat_type"), "prn", "left")
    old = expired(F.col("sys"), F.col("received_ms"), F.lit(now_ms))
    state = F.when(F.col("received_ms").isNull(), "none").when(old, "expired").when(S.healthy(F.col("prn"), F.col("health")), "healthy").otherwise("unhealthy")
    name = S.group(F.col("prn"), F.col("sat_type"))
    wanted = F.lit(None).cast("string")
    for sys, g in (chosen or {}).items():
        wanted = F.when(F.col("sys") == sys, g).otherwise(wanted)
    fits = (name == wanted) & ((F.col("sys") != "R") | F.col("received_ms").isNotNull())
    return both.select("sys", "prn", state.alias("state"), name.alias("group"), (wanted.isNotNull() & ~fits).alias("dimmed"))


def constellation_totals(live: DataFrame) -> DataFrame:
    """Per system tracked, healthy and unhealthy satellites."""
    good = S.healthy(F.col("prn"), F.col("health"))
    return live.groupBy(F.substring("prn", 1, 1).alias("sys")).agg(F.count(F.lit(1)).alias("tracked"), F.count_if(good).alias("healthy"), F.count_if(~good).alias("unhealthy"))


def groups_present(live: DataFrame) -> DataFrame:
    """sys, group and its place in the fixed order, of the listed groups that satellites have."""
    sys = F.substring("prn", 1, 1)
    rows = live.select(sys.alias("sys"), S.group(F.col("prn"), F.col("sat_type")).alias("group")).distinct()
    return rows.withColumn("place", S.group_rank(F.col("sys"), F.col("group"))).where("place is not null")


def satellite_panel(observed: DataFrame, eph: DataFrame) -> DataFrame:
    """prn, observed, has_eph and place (by system, then number) of satellites that either side has."""
    a = observed.select("prn").distinct().withColumn("o", F.lit(True))
    b = eph.select("prn").distinct().withColumn("e", F.lit(True))
    both = a.join(b, "prn", "full")
    return both.select("prn", F.col("o").isNotNull().alias("observed"), F.col("e").isNotNull().alias("has_eph"), (system_rank(F.substring("prn", 1, 1), SYSTEM_ORDER) * 1000 + S.number(F.col("prn"))).alias("place"))


def panel_groups(panel: DataFrame) -> DataFrame:
    """Per system how many satellites are observed and how many have an ephemeris, in display order."""
    sys = F.substring("prn", 1, 1)
    return panel.groupBy(sys.alias("sys")).agg(F.count_if("observed").alias("observed"), F.count_if("has_eph").alias("with_eph"), F.min(system_rank(sys, STATUS_ORDER)).alias("place"))
