"""Nearest-in-time joins, written as equi-joins on time buckets, and the joins built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Oldest usable ephemeris in milliseconds: GLONASS and SBAS, and all others; fixed values.
SHORT_AGE, LONG_AGE = 1_800_000, 14_400_000
ELEVATION_TOLERANCE = 60_000


def max_age(sys: Column) -> Column:
    return F.when(sys.isin("R", "S"), SHORT_AGE).otherwise(LONG_AGE)


def nearest(targets: DataFrame, samples: DataFrame, key: str, at: str, sample_at: str, tolerance_ms: int, tie: list, payload: list[str], limit: Column | None = None) -> DataFrame:
    """targets (distinct key and at) with best, a struct of payload from the nearest sample within the tolerance, else NULL.

    Both sides meet in buckets as wide as the tolerance; a sample goes to its own and both neighbours, so no pair is missed and a
    bucket's size doesn't grow with the length of the series. tie orders equally near samples, smallest first.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance_ms)
    t = targets.select(F.col(key).alias("_k"), F.col(at).alias("_at"), bucket(at).alias("_b"))
    s = samples.select(F.col(key).alias("_k"), F.col(sample_at).alias("_s"), F.explode(F.array(*[bucket(sample_at) + d for d in (-1, 0, 1)])).alias("_b"), F.struct(*tie).alias("_tie"), F.struct(*payload).alias("_p"))
    gap = F.abs(F.col("_at") - F.col("_s"))
    met = t.join(s, ["_k", "_b"]).where(gap <= (F.lit(tolerance_ms) if limit is None else limit))
    best = met.groupBy("_k", "_at").agg(F.min_by("_p", F.struct(gap, "_tie")).alias("best"))
    return targets.join(best, (F.col(key) == F.col("_k")) & (F.col(at) == F.col("_at")), "left").drop("_k", "_at")


def nearest_ephemeris(targets: DataFrame, eph: DataFrame, at: str = "t_ms") -> DataFrame:
    """targets (prn, at) with best (toc_ms, healthy, ord): the nearest ephemeris young enough; the first of equally near ones."""
    return nearest(targets, eph, "prn", at, "toc_ms", LONG_AGE, [F.col("ord")], ["toc_ms", "healthy", "ord"], max_age(F.substring("_k", 1, 1)))


def elevation_lookup(points: DataFrame, positions: DataFrame) -> DataFrame:
    """points (prn, t_ms, ...) with el, of the nearest position within 60 s; the later of two equally near. Elevation 0 means none."""
    some = positions.where("el is not null and el <> 0").select("prn", F.col("t_ms").alias("p_ms"), "el")
    found = nearest(points.select("prn", "t_ms").distinct(), some, "prn", "t_ms", "p_ms", ELEVATION_TOLERANCE, [-F.col("p_ms")], ["el"])
    return points.join(found.select("prn", "t_ms", F.col("best.el").alias("el")), ["prn", "t_ms"])


def sky(sat_epochs: DataFrame, positions: DataFrame, mask_deg: float = 5.0) -> DataFrame:
    """Positions of the satellites observed at an epoch, at or above the mask."""
    seen = sat_epochs.select("t_ms", "prn").distinct()
    return positions.where(F.col("el") >= F.radians(F.lit(mask_deg))).join(seen, ["t_ms", "prn"], "left_semi")


def sky_signal(sky_rows: DataFrame, band_snr: DataFrame) -> DataFrame:
    """t_ms, prn, band, el, snr: positions joined to each band's C/N0 at the same time."""
    return sky_rows.join(band_snr, ["t_ms", "prn"])


def merge_files(files: DataFrame) -> DataFrame:
    """One value per (t_ms, prn, code) of several files: the last that isn't NULL, by file_ord and then rec_ord."""
    order = F.struct("file_ord", "rec_ord")
    return files.groupBy("t_ms", "sys", "prn", "code").agg(F.max_by("value", F.when(F.col("value").isNotNull(), order)).alias("value"))


def first_known(headers: DataFrame, key: str = "key", value: str = "value", order: str = "file_ord") -> DataFrame:
    """Per key the first value that isn't NULL."""
    return headers.groupBy(key).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def staged(files: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """The first file of each name."""
    rest = [c for c in files.columns if c != name]
    return files.groupBy(name).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(name, "_r.*")


def same_ephemerides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of two versions' ephemerides with the same prn and toc_ms, the first of each on either side."""
    first = lambda d, n: d.groupBy("prn", "toc_ms").agg(F.min("ord").alias(n))
    return first(left, "left_ord").join(first(right, "right_ord"), ["prn", "toc_ms"])


def msm_epochs(messages: DataFrame) -> DataFrame:
    """time_ms (to 10 ms), prn, code and fields of MSM signals: later messages overwrite the fields they have.

    messages has time_ms, ord, prn, code and a nullable column per field.
    """
    fields = [c for c in messages.columns if c not in ("time_ms", "ord", "prn", "code")]
    key = (F.floor(F.col("time_ms") / 10 + 0.5) * 10).alias("time_ms")
    return messages.groupBy(key, "prn", "code").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in fields])


def station_position(streams: DataFrame, stations: DataFrame) -> DataFrame:
    """mountpoint, lat, lon, h: the station's own position, else the sourcetable's at height 0 unless that is 0, 0."""
    both = streams.select("mountpoint", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).join(stations, "mountpoint", "left")
    listed = ~((F.col("_lat") == 0) & (F.col("_lon") == 0))
    pick = lambda own, other: F.when(F.col("lat").isNotNull(), own).when(listed, other)
    return both.select("mountpoint", pick(F.col("lat"), F.col("_lat")).alias("lat"), pick(F.col("lon"), F.col("_lon")).alias("lon"), pick(F.col("h"), F.lit(0.0)).alias("h"))
