"""Per-epoch figures, statistics, histograms and downsampling of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from almanax.model import js_round, system_rank

POINTS = 2000


def band_of(code: Column) -> Column:
    return F.substring(code, 2, 1)


def code_registry(obs: DataFrame) -> DataFrame:
    """sys, code and ord: codes of a system by when they were first seen, then by name."""
    seen = obs.groupBy("sys", "code").agg(F.min("t_ms").alias("first_ms"))
    return seen.select("sys", "code", F.row_number().over(W.partitionBy("sys").orderBy("first_ms", "code")).alias("ord"))


def satellite_epochs(obs: DataFrame) -> DataFrame:
    return obs.groupBy("t_ms", "sys", "prn").agg(F.avg(F.when(F.col("code").startswith("S") & (F.col("value") > 0), F.col("value"))).alias("snr"))


def satellite_snr(obs: DataFrame) -> DataFrame:
    """Mean of a satellite's positive S values at an epoch."""
    return satellite_epochs(obs).where("snr is not null")


def band_snr(obs: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """t_ms, prn, band, snr: of a band's positive S values, that of the last code in the registry."""
    registry = code_registry(obs) if registry is None else registry
    s = obs.where(F.col("code").startswith("S") & (F.col("value") > 0)).join(F.broadcast(registry), ["sys", "code"])
    return s.groupBy("t_ms", "prn", band_of(F.col("code")).alias("band")).agg(F.max_by("value", "ord").alias("snr"))


def grid_epochs(obs: DataFrame) -> DataFrame:
    """t_ms, total_sats and mean_snr, the mean of the satellites' means."""
    return satellite_epochs(obs).groupBy("t_ms").agg(F.count(F.lit(1)).alias("total_sats"), F.avg("snr").alias("mean_snr"))


def grid_systems(obs: DataFrame) -> DataFrame:
    """t_ms, sys, sats, snr for every epoch and every system of the data; 0 and NULL where it is missing.

    Both scaffolds have one row per epoch or system, and the systems are a handful.
    """
    per = satellite_epochs(obs).groupBy("t_ms", "sys").agg(F.count(F.lit(1)).alias("sats"), F.avg("snr").alias("snr"))
    systems = per.agg(F.array_sort(F.collect_set("sys")).alias("all"))
    epochs = per.groupBy("t_ms").agg(F.map_from_entries(F.collect_list(F.struct("sys", F.struct("sats", "snr")))).alias("have"))
    rows = epochs.withColumn("all", systems.scalar()).select("t_ms", "have", F.explode("all").alias("sys"))
    mine = F.try_element_at("have", F.col("sys"))
    return rows.select("t_ms", "sys", F.coalesce(mine["sats"], F.lit(0).cast("long")).alias("sats"), mine["snr"].alias("snr"))


def statistics(obs: DataFrame, interval: Column | None = None) -> DataFrame:
    """One row of figures over all epochs. interval: the header's, in seconds, if it names one."""
    sat = satellite_epochs(obs)
    epochs = sat.groupBy("t_ms").agg(F.count(F.lit(1)).alias("sats"), F.sum("snr").alias("snr"), F.count("snr").alias("n_snr"))
    one = epochs.agg(
        F.count(F.lit(1)).alias("epochs"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.avg("sats").alias("mean_sats"),
        (F.sum("snr") / F.when(F.sum("n_snr") > 0, F.sum("n_snr"))).alias("mean_snr"),
    )
    second = F.array_max(F.col("two")["t_ms"])
    # the two least times of any number of epochs
    two = epochs.select("t_ms").orderBy("t_ms").limit(2).agg(F.collect_list(F.struct("t_ms")).alias("two")).select(second.alias("second_ms"), F.size("two").alias("n"))
    seen = obs.groupBy("sys", "prn").agg(F.lit(1)).groupBy("sys").agg(F.count(F.lit(1)).alias("n"))
    systems = seen.agg(F.sum("n").alias("unique_sats"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(system_rank(F.col("sys")).alias("o"), "sys", "n"))), lambda x: F.concat(x["sys"], F.lit(":"), x["n"].cast("string"))), ",").alias("per_system"))
    gap = F.when(F.col("n") == 2, (F.col("second_ms") - F.col("start_ms")) / 1000)
    both = one.crossJoin(two).crossJoin(systems)  # one row each
    return both.select(
        "epochs", "start_ms", "end_ms", ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration"), F.coalesce(interval if interval is not None else F.lit(None).cast("double"), gap).alias("interval"),
        "unique_sats", "per_system", "mean_sats", "mean_snr",
    )


def cn0_histogram(obs: DataFrame, width: int = 5, bins: int = 12) -> DataFrame:
    """sys, low, n: satellites' mean C/N0 by bins of 5 dB, the last open; empty bins are there with 0."""
    s = satellite_snr(obs).select("sys", F.least(F.floor(F.col("snr") / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = s.groupBy("sys", "bin").agg(F.count(F.lit(1)).alias("n"))
    return _with_all_bins(counts, bins, width)


def system_snr_histogram(obs: DataFrame, width: int = 2, bins: int = 30) -> DataFrame:
    """sys, low, n, stacked: systems' epoch means by bins of 2 dB; stacked counts the systems before and this one."""
    s = grid_systems(obs).where("snr > 0").select("sys", F.least(F.floor(F.col("snr") / width), F.lit(bins - 1)).cast("int").alias("bin"))
    full = _with_all_bins(s.groupBy("sys", "bin").agg(F.count(F.lit(1)).alias("n")), bins, width)
    return full.withColumn("stacked", F.sum("n").over(W.partitionBy("low").orderBy(system_rank(F.col("sys")), "sys").rowsBetween(W.unboundedPreceding, 0)))


def _with_all_bins(counts: DataFrame, bins: int, width: int) -> DataFrame:
    have = counts.groupBy("sys").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("have"))
    rows = have.select("sys", "have", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return rows.select("sys", (F.col("bin") * width).alias("low"), F.coalesce(F.try_element_at("have", F.col("bin")), F.lit(0).cast("long")).alias("n"))


def numbered_epochs(epochs: DataFrame, most: int = POINTS) -> DataFrame:
    """t_ms, i (from 0) and step = ceil(epochs / most). epochs has one row per epoch.

    Rows are numbered within ranges of time, and the ranges' counts, of which there are as many as partitions, are added.
    """
    ranged = epochs.select("t_ms").repartitionByRange("t_ms").withColumn("part", F.spark_partition_id())
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("m"), F.sum("n").alias("total"))
    local = ranged.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy("t_ms"))).crossJoin(F.broadcast(before))
    ahead = F.aggregate(F.map_entries("m"), F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["key"] < F.col("part"), x["value"]).otherwise(0))
    return local.select("t_ms", (ahead + F.col("k") - 1).alias("i"), F.greatest(F.lit(1), F.ceil(F.col("total") / most)).alias("step"))


def chart_rows(obs: DataFrame, most: int = POINTS) -> DataFrame:
    """Groups of step epochs: time of the middle one, rounded mean number of satellites and mean C/N0 (1 digit)."""
    grid = grid_epochs(obs)
    n = numbered_epochs(grid, most).withColumn("g", F.floor(F.col("i") / F.col("step")))
    size = F.count(F.lit(1))
    rows = grid.join(n, "t_ms").groupBy("g").agg(F.array_sort(F.collect_list("t_ms")).alias("times"), F.sum("total_sats").alias("sats"), F.avg("mean_snr").alias("snr"), size.alias("size"))
    middle = F.element_at("times", (F.floor(F.col("size") / 2) + 1).cast("int"))
    return rows.select(middle.alias("t_ms"), js_round(F.col("sats") / F.col("size")).alias("total"), js_round(F.col("snr"), 1).alias("snr"))


def strided(epochs: DataFrame, most: int) -> DataFrame:
    """Every step-th epoch, so that about most are left."""
    return numbered_epochs(epochs, most).where("i % step = 0").select("t_ms")


def satellite_heatmap(obs: DataFrame, most: int = POINTS) -> DataFrame:
    """Mean C/N0 of each satellite at every step-th epoch."""
    s = satellite_epochs(obs)
    return s.join(strided(s.select("t_ms").distinct(), most), "t_ms", "left_semi").where("snr is not null").select("t_ms", "prn", "snr")


def facets(obs: DataFrame) -> DataFrame:
    """sys, prns, bands and signals of the unfiltered data; signals (code without its type) by first seen."""
    r = code_registry(obs).groupBy("sys").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "code"))), lambda x: F.substring(x["code"], 2, 2))), ",").alias("signals"), F.array_join(F.array_sort(F.collect_set(band_of(F.col("code")))), ",").alias("bands"))
    prns = obs.groupBy("sys").agg(F.array_join(F.array_sort(F.collect_set("prn")), ",").alias("prns"))
    return prns.join(r, "sys")


def type_matrix(obs: DataFrame) -> DataFrame:
    """Per system its codes of each type (C, L, D, S), sorted by band and attribute."""
    codes = obs.select("sys", "code").distinct()
    lists = lambda t: F.array_join(F.array_sort(F.collect_list(F.when(F.col("code").startswith(t), F.col("code")))), " ").alias(f"codes_{t.lower()}")
    return codes.groupBy("sys").agg(*[lists(t) for t in "CLDS"])


def ordered_codes(obs: DataFrame) -> DataFrame:
    """sys, code and place: by band, then type, then name."""
    codes = obs.select("sys", "code").distinct()
    return codes.select("sys", "code", F.row_number().over(W.partitionBy("sys").orderBy(band_of(F.col("code")), F.substring("code", 1, 1), "code")).alias("place"))


def median_interval(epochs: DataFrame, first: int = 20, most_s: float = 300.0) -> DataFrame:
    """Upper median of the gaps below 300 s between the first 20 epochs, in seconds."""
    head = epochs.select("t_ms").distinct().orderBy("t_ms").limit(first)
    times = head.agg(F.array_sort(F.collect_list("t_ms")).alias("t"))
    gaps = F.array_sort(F.filter(F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.size("t")), lambda a, b: (b - a) / 1000), lambda d: (d > 0) & (d < most_s)))
    return times.select(F.when(F.size("t") >= 2, F.try_element_at(gaps, (F.floor(F.size(gaps) / 2) + 1).cast("int"))).alias("interval"))


