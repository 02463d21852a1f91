"""Tracks of fixes: statistics, precision and coloured segments. fixes has track, t_ms, lat, lon (degrees), alt, satellites, speed (knots) and quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from almanax.functions.geodesy import ecef_to_geodetic, enu, geodetic_to_ecef, haversine
from almanax.operators.quality import islands

KNOT_KMH = 1.852
#: Ratio of the circular error probable to the horizontal RMS of a round normal spread.
CEP_RATIO = math.sqrt(math.log(2))


def statistics(fixes: DataFrame) -> DataFrame:
    """Per track: fixes, start, end, duration (s), distance along the fixes, top speed, mean satellites and bounding box."""
    w = W.partitionBy("track").orderBy("t_ms")
    r = F.radians
    step = haversine(r(F.lag("lat").over(w)), r(F.lag("lon").over(w)), r("lat"), r("lon"))
    rows = fixes.where("quality > 0").withColumn("step", step)
    return rows.groupBy("track").agg(
        F.count(F.lit(1)).alias("fixes"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), ((F.max("t_ms") - F.min("t_ms")) / 1000).alias("duration"), F.sum("step").alias("distance"),
        (F.max("speed") * KNOT_KMH).alias("max_speed_kmh"), F.avg("satellites").alias("satellites"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
    )


def scatter(fixes: DataFrame) -> DataFrame:
    """fixes with e, n and u in metres about the mean ECEF place of their track."""
    p = fixes.where("quality > 0").withColumn("p", geodetic_to_ecef(F.radians("lat"), F.radians("lon"), F.coalesce("alt", F.lit(0.0))))
    mean = p.groupBy("track").agg(*[F.avg(f"p.{c}").alias(f"m{c}") for c in "xyz"])
    mean = mean.withColumn("g", ecef_to_geodetic(F.col("mx"), F.col("my"), F.col("mz")))
    both = p.join(mean, "track")
    return both.withColumn("v", enu(F.col("g.lat"), F.col("g.lon"), *[F.col(f"p.{c}") - F.col(f"m{c}") for c in "xyz"])).select(*fixes.columns, "v.*")


def precision(fixes: DataFrame) -> DataFrame:
    """Per track: horizontal and vertical RMS, 2DRMS, circular error probable (of a round normal spread) and a plot's reach."""
    square = lambda *cs: F.sqrt(F.avg(sum((F.col(c) * F.col(c) for c in cs[1:]), F.col(cs[0]) * F.col(cs[0]))))
    out = scatter(fixes).groupBy("track").agg(square("e", "n").alias("h_rms"), square("u").alias("v_rms"), F.max(F.greatest(F.abs("e"), F.abs("n"))).alias("most"))
    reach = F.when(F.col("most") > 0, F.ceil(F.col("most") * 1.1 * 1000) / 1000).otherwise(1.0)
    return out.select("track", "h_rms", "v_rms", (2 * F.col("h_rms")).alias("drms2"), (CEP_RATIO * F.col("h_rms")).alias("cep"), reach.alias("reach"))


def colour_class(satellites: Column) -> Column:
    """Steps of the ramp from 4 to 12 satellites."""
    return F.least(F.lit(8), F.greatest(F.lit(0), satellites - 4)).cast("int")


def coloured_segments(fixes: DataFrame) -> DataFrame:
    """track, segment, colour, start_ms, end_ms, pieces: consecutive pairs of fixes, merged while their colour stays."""
    w = W.partitionBy("track").orderBy("t_ms")
    pairs = fixes.where("quality > 0").withColumns({"colour": colour_class(F.col("satellites")), "next_ms": F.lead("t_ms").over(w)}).where("next_ms is not null")
    pairs = pairs.withColumn("before", F.lag("colour").over(w))
    rows = islands(pairs, ["track"], F.col("colour") == F.col("before"))
    return rows.groupBy("track", "segment").agg(F.first("colour").alias("colour"), F.min("t_ms").alias("start_ms"), F.max("next_ms").alias("end_ms"), F.count(F.lit(1)).alias("pieces"))
