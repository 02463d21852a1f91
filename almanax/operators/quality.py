"""Completeness, phase arcs, code multipath and cycle slips of observations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from almanax.model import SPEED_OF_LIGHT, frequency, js_round, present, system_rank
from almanax.operators import segments

GAP_INTERVALS, LEAST_ARC = 5, 10
#: Single-frequency threshold in metres; geometry-free in metres per step; Melbourne-Wuebbena in sigmas and in least cycles.
SF_METRES, GF_METRES, MW_SIGMAS, MW_CYCLES, MW_START_SIGMA = 3.0, 0.15, 4.0, 1.0, 0.5


def completeness_cells(obs: DataFrame) -> DataFrame:
    """prn, code, expected, present, percent. A satellite's epochs count for a code from the first sample that is present."""
    seen = present(F.col("value"))
    firsts = obs.where(seen).groupBy("prn", "code").agg(F.min("t_ms").alias("first_ms"), F.count(F.lit(1)).alias("present"))
    epochs = obs.select("prn", "t_ms").distinct()
    counted = epochs.join(firsts, "prn").where(F.col("t_ms") >= F.col("first_ms")).groupBy("prn", "code").agg(F.count(F.lit(1)).alias("expected"), F.first("present").alias("present"))
    return counted.select("prn", "code", "expected", "present", (100 * F.col("present") / F.col("expected")).alias("percent"))


def completeness_signals(cells: DataFrame) -> DataFrame:
    """Per system and code: satellites, expected, present, percent."""
    out = cells.groupBy(F.substring("prn", 1, 1).alias("sys"), "code").agg(F.count(F.lit(1)).alias("satellites"), F.sum("expected").alias("expected"), F.sum("present").alias("present"))
    return out.withColumn("percent", 100 * F.col("present") / F.col("expected"))


def completeness_total(cells: DataFrame) -> DataFrame:
    return cells.where("expected > 0").agg((100 * F.sum("present") / F.sum("expected")).alias("percent"))


def completeness_matrix(cells: DataFrame, codes: list[str]) -> DataFrame:
    """A row per satellite, a column per code."""
    return cells.groupBy("prn").pivot("code", codes).agg(F.first("percent"))


#: Columns that tell receivers apart, which may be null. A table that has one of them is worked on receiver by receiver, here and in all that follows.
RECEIVERS = ("station", "file")


def receivers(rows: DataFrame) -> list[str]:
    return [c for c in RECEIVERS if c in rows.columns]


def pairs(obs: DataFrame) -> DataFrame:
    """t_ms, sys, prn, band, code_m and phase_m: a band's pseudorange and its phase in metres, of the first code that has them."""
    band, kind = F.substring("code", 2, 1), F.substring("code", 1, 1)
    ok = obs.where(present(F.col("value")) & kind.isin("C", "L"))
    wave = SPEED_OF_LIGHT / frequency(F.col("sys"), F.col("band"))
    first = lambda k: F.min_by("value", F.when(kind == k, F.col("code")))
    both = ok.groupBy(*receivers(obs), "t_ms", "sys", "prn", band.alias("band")).agg(first("C").alias("code_m"), first("L").alias("phase"))
    return both.withColumn("phase_m", F.col("phase") * wave)


def dual(obs: DataFrame) -> DataFrame:
    """Pairs of two bands of a satellite at an epoch, each with code and phase: band is the code's, ref the other."""
    p = pairs(obs).where("phase_m is not null").withColumn("hz", frequency(F.col("sys"), F.col("band"))).where("hz is not null")
    keys = [*receivers(obs), "t_ms", "sys", "prn"]
    at = p.groupBy(*keys).agg(F.collect_list(F.struct("band", "hz", "code_m", "phase_m", "phase")).alias("b"))
    two = at.select(*keys, "b", F.explode("b").alias("i")).select(*keys, "i", F.explode("b").alias("j")).where("i.band <> j.band and i.code_m is not null")
    return two.select(*keys, F.col("i.band").alias("band"), F.col("j.band").alias("ref"), "i", "j")


def reference_pairs(obs: DataFrame) -> DataFrame:
    """Of dual(): band 1 with the lowest other band, and every other band with band 1 (or the lowest)."""
    d = dual(obs)
    own = receivers(obs)
    whole, first = segments.whole_key(d, own)
    best = whole.groupBy(*first, "sys", "band").agg(F.min("ref").alias("ref"))
    # a row per band, or per receiver and band, whose number Spark checks by itself
    return whole.join(best if own else F.broadcast(best), [*first, "sys", "band", "ref"]).select(d.columns)


def arcs(rows: DataFrame, keys: list[str], interval_ms: int, broken: Column | None = None) -> DataFrame:
    """rows with arc: a new one after a gap of over five intervals, and at rows that are marked as broken."""
    own = receivers(rows)
    whole, first = segments.whole_key(rows, [k for k in keys if k in own])
    out = segments.numbered(whole, [*first, *[k for k in keys if k not in own]], GAP_INTERVALS * interval_ms, broken)
    return out.select(*rows.columns, "arc")


def multipath(obs: DataFrame, interval_ms: int, slips: DataFrame | None = None, least_arc: int = LEAST_ARC) -> DataFrame:
    """t_ms, sys, prn, band, ref, arc, mp: code minus carrier combination with each arc's mean taken off; short arcs are dropped.

    slips (prn, t_ms, and the receiver's column if obs has one): an arc ends before the epoch of a slip.
    """
    d = reference_pairs(obs)
    alpha = F.pow(F.col("i.hz") / F.col("j.hz"), 2)
    # by differences: the ranges of 2e7 m cancel before they are scaled
    raw = (F.col("i.code_m") - F.col("i.phase_m")) - 2 / (alpha - 1) * (F.col("i.phase_m") - F.col("j.phase_m"))
    own = receivers(obs)
    rows = d.select(*own, "t_ms", "sys", "prn", "band", "ref", raw.alias("raw"))
    rows, first = segments.whole_key(rows, own)
    keys, broken = [*first, "prn", "band", "ref"], None
    if slips is not None:
        at = [*first, "prn", "t_ms"]
        mark = segments.whole_key(slips, own)[0].select(*at).distinct().withColumn("_slip", F.lit(True))
        rows, broken = rows.join(mark, at, "left"), F.col("_slip")
    rows = segments.arc_means(segments.numbered(rows, keys, GAP_INTERVALS * interval_ms, broken), keys, "raw").where(F.col("_n") >= least_arc)
    return rows.select(*own, "t_ms", "sys", "prn", "band", "ref", "arc", (F.col("raw") - F.col("_mean")).alias("mp"))


def multipath_series(mp: DataFrame) -> DataFrame:
    return mp.groupBy(*receivers(mp), "sys", "prn", "band", "ref").agg(F.sqrt(F.avg(F.col("mp") * F.col("mp"))).alias("rms"), F.count(F.lit(1)).alias("count"))


def multipath_signals(mp: DataFrame) -> DataFrame:
    return mp.groupBy(*receivers(mp), "sys", "band", "ref").agg(F.sqrt(F.avg(F.col("mp") * F.col("mp"))).alias("rms"), F.count(F.lit(1)).alias("count"), F.count_distinct("prn").alias("satellites"))


def multipath_by_elevation(points: DataFrame, width: int = 5, least: int = 5) -> DataFrame:
    """sys, low, rms, n of points (mp, el in radians) above the horizon, by bins of elevation; RMS is NULL below least points."""
    deg = F.degrees("el")
    p = points.where("el > 0").select("sys", "mp", (F.least(F.floor(deg / width), F.lit(-(-90 // width) - 1)) * width).cast("int").alias("low"))
    return p.groupBy("sys", "low").agg(F.when(F.count(F.lit(1)) >= least, F.sqrt(F.avg(F.col("mp") * F.col("mp")))).alias("rms"), F.count(F.lit(1)).alias("n"))


def order_statistics(rows: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the value at index floor(n * share) of the sorted column, as no interpolating percentile gives.

    Values are counted once each, ranked within ranges, and the ranges' counts added, so no task sorts the whole column.
    """
    v = rows.groupBy(column).agg(F.count(F.lit(1)).alias("c")).repartitionByRange(column).withColumn("part", F.spark_partition_id())
    sums = v.groupBy("part").agg(F.sum("c").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("m"), F.sum("n").alias("total"))
    w = W.partitionBy("part").orderBy(column).rowsBetween(W.unboundedPreceding, 0)
    ahead = F.aggregate(F.map_entries("m"), F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["key"] < F.col("part"), x["value"]).otherwise(0))
    upto = v.withColumn("upto", F.sum("c").over(w)).crossJoin(F.broadcast(sums)).withColumn("upto", ahead + F.col("upto"))
    return upto.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("total") * share), F.col(column))).alias(name) for name, share in shares.items()])


def multipath_distribution(mp: DataFrame, bins: int = 40) -> DataFrame:
    """mp (centre, 3 digits) and n of 40 bins over the larger of both outer half percents, at least 0.1; outliers at the ends."""
    ends = order_statistics(mp, "mp", {"hi": 0.995, "lo": 0.005})
    reach = F.greatest(F.abs("hi"), F.abs("lo"), F.lit(0.1))
    rows = mp.crossJoin(F.broadcast(ends)).withColumn("r", reach)
    width = 2 * F.col("r") / bins
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("mp") + F.col("r")) / width))).cast("int")
    counts = rows.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    axis = ends.where("hi is not null").select(reach.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return axis.join(counts, "bin", "left").select("bin", js_round(-F.col("r") + (F.col("bin") + 0.5) * width, 3).alias("mp"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def first_series(series: DataFrame) -> DataFrame:
    """Of each satellite the first series by band, with its RMS to 3 digits."""
    own = receivers(series)
    one = series.groupBy(*own, "sys", "prn").agg(F.min_by(F.struct("band", "ref", "rms"), F.struct("band", "ref")).alias("s"))
    return one.select(*own, "sys", "prn", "s.band", "s.ref", js_round(F.col("s.rms"), 3).alias("rms"))


def pooled_rms(mp: DataFrame, least: int = 10) -> DataFrame:
    """RMS per satellite over all its signals, of at least so many points."""
    return mp.groupBy(*receivers(mp), "prn").agg(F.sqrt(F.avg(F.col("mp") * F.col("mp"))).alias("rms"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def multipath_heatmap(mp: DataFrame, columns: int = 600) -> DataFrame:
    """prn, col, mp: mean of the satellite's first series in each of the time columns."""
    first = mp.groupBy("prn").agg(F.min(F.struct("band", "ref")).alias("s")).select("prn", "s.band", "s.ref")
    rows = mp.join(first, ["prn", "band", "ref"])
    ends = rows.agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b"))
    span = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(1)
    col = F.least(F.lit(columns - 1), F.floor((F.col("t_ms") - F.col("a")) / span * columns)).cast("int")
    return rows.crossJoin(F.broadcast(ends)).groupBy("prn", col.alias("col")).agg(F.avg("mp").alias("mp"))


def elevation_cn0(sky_signal: DataFrame, least: int = 2) -> DataFrame:
    """sys, band, bin, el (mean, whole degrees), cn0 (mean, 1 digit) by bins of one degree with at least two points."""
    deg = F.degrees("el")
    rows = sky_signal.groupBy(F.substring("prn", 1, 1).alias("sys"), "band", F.least(F.floor(deg), F.lit(89)).cast("int").alias("bin"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(deg).alias("_el"), F.avg("snr").alias("_cn0")).where(F.col("n") >= least)
    return out.select("sys", "band", "bin", js_round(F.col("_el")).alias("el"), js_round(F.col("_cn0"), 1).alias("cn0"))


def _steps(rows: DataFrame, keys: list[str], column: str, interval_ms: int) -> DataFrame:
    """rows with step: the change of a column since the row before, null where an arc begins."""
    rows = segments.with_previous(rows, keys, ["t_ms", column])
    near = F.col("t_ms") - F.col("_before.t_ms") <= GAP_INTERVALS * interval_ms
    return rows.withColumn("step", F.when(near, F.col(column) - F.col(f"_before.{column}"))).drop("_before")


def phase_jumps(obs: DataFrame, interval_ms: int) -> DataFrame:
    """Single-frequency slips: t_ms, sys, prn, signal, magnitude where phase minus code moves over 3 m within an arc."""
    p = pairs(obs).where("code_m is not null and phase_m is not null").withColumn("d", F.col("phase_m") - F.col("code_m"))
    own = receivers(obs)
    p, first = segments.whole_key(p.select(*own, "t_ms", "sys", "prn", "band", "d"), own)
    p = _steps(p, [*first, "prn", "band"], "d", interval_ms).withColumn("magnitude", F.abs("step"))
    return p.where(F.col("magnitude") > SF_METRES).select(*own, "t_ms", "sys", "prn", F.concat(F.lit("SF "), "band").alias("signal"), "magnitude")


def geometry_free_jumps(obs: DataFrame, interval_ms: int, metres: float = GF_METRES) -> DataFrame:
    """Dual-frequency slips: the change of the difference of both phases departs from its last change by over a bound."""
    d = reference_pairs(obs).where("band < ref").withColumn("gf", F.col("i.phase_m") - F.col("j.phase_m"))
    own = receivers(obs)
    d, first = segments.whole_key(d.select(*own, "t_ms", "sys", "prn", "band", "ref", "gf"), own)
    keys = [*first, "prn", "band", "ref"]
    d = segments.with_previous(_steps(d, keys, "gf", interval_ms), keys, ["step"])
    # an arc's first row has no step, and its second none before
    d = d.where("step is not null").withColumn("before", F.coalesce("_before.step", F.lit(0.0))).withColumn("magnitude", F.abs(F.col("step") - F.col("before")))
    # the step after a slip departs again and isn't one
    return d.where((F.col("magnitude") > metres) & ~(F.abs("before") > metres)).select(*own, "t_ms", "sys", "prn", F.concat(F.lit("GF "), "band", F.lit("-"), "ref").alias("signal"), "magnitude")


def wide_lane_slips(mw: np.ndarray, block: int = 256) -> tuple[list[int], list[float]]:
    """Places and sizes of the slips of one arc: values over both bounds from the mean since the last slip, from the third on.

    With m the mean of the values before, k times the spread grows by (value - m)^2, so that running sums give all figures up to
    the next slip at once.
    """
    at, size, begin = [], [], 0
    while begin + 2 < len(mw):
        wide = block
        while True:
            x = mw[begin : begin + wide] - mw[begin]
            k = np.arange(1, len(x))  # values before
            off = x[1:] - np.cumsum(x)[:-1] / k
            spread = (MW_START_SIGMA**2 + np.concatenate(([0.0], np.cumsum(off[:-1] ** 2)))) / k
            hit = np.flatnonzero((np.abs(off) > np.maximum(MW_SIGMAS * np.sqrt(spread), MW_CYCLES)) & (k >= 2))
            if len(hit) or begin + wide >= len(mw):
                break
            wide *= 4
        if not len(hit):
            break
        at.append(begin + int(hit[0]) + 1)
        size.append(float(abs(off[hit[0]])))
        begin = at[-1]
    return at, size


def _scan_wide_lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by arc and time; the rows of the arc at hand are held."""
    held: list[pa.RecordBatch] = []

    def close() -> Iterator[pa.RecordBatch]:
        at, size = wide_lane_slips(np.concatenate([np.asarray(b.column("mw")) for b in held]))
        if at:
            hit = pa.Table.from_batches(held).take(pa.array(at)).drop_columns(["_g", "mw"]).append_column("magnitude", pa.array(size, pa.float64()))
            yield from hit.combine_chunks().to_batches()

    group = None
    for batch in batches:
        g = np.asarray(batch.column("_g"))
        cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, b in zip(cut, cut[1:], strict=False):
            if b > a:
                if held and g[a] != group:
                    yield from close()
                    held = []
                group = g[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield from close()


def wide_lane_jumps(obs: DataFrame, interval_ms: int) -> DataFrame:
    """Melbourne-Wuebbena slips with adaptive sigma, begun anew after gaps and slips.

    The figures depend on earlier decisions, so each arc of a pair of bands of a receiver's satellite is walked in order, by blocks
    of rows; Spark deals arcs and sorts their rows.
    """
    d = reference_pairs(obs).where("band < ref and j.code_m is not null")
    fi, fj = F.col("i.hz"), F.col("j.hz")
    narrow = (fi * F.col("i.code_m") + fj * F.col("j.code_m")) / (fi + fj)
    mw = F.col("i.phase") - F.col("j.phase") - narrow * (fi - fj) / SPEED_OF_LIGHT
    own = receivers(obs)
    rows = arcs(d.select(*own, "sys", "prn", "band", "ref", "t_ms", mw.alias("mw")), [*own, "prn", "band", "ref"], interval_ms)
    arc = [*own, "sys", "prn", "band", "ref", "arc"]
    rows = rows.withColumn("_g", F.xxhash64(*arc))
    dealt = rows.repartition(*arc).sortWithinPartitions(*arc, "t_ms").select(*own, "sys", "prn", "band", "ref", "t_ms", "_g", "mw")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema if f.name not in ("_g", "mw"))
    found = dealt.mapInArrow(_scan_wide_lane, f"{kept}, magnitude double")
    return found.select(*own, "t_ms", "sys", "prn", F.concat(F.lit("MW "), "band", F.lit("-"), "ref").alias("signal"), "magnitude")


def cycle_slips(obs: DataFrame, interval_ms: int) -> DataFrame:
    """All slips; of one epoch and satellite, wide lane goes before geometry-free before single frequency."""
    found = wide_lane_jumps(obs, interval_ms).withColumn("rank", F.lit(0))
    found = found.unionByName(geometry_free_jumps(obs, interval_ms).withColumn("rank", F.lit(1))).unionByName(phase_jumps(obs, interval_ms).withColumn("rank", F.lit(2)))
    return found.withColumn("_k", F.min("rank").over(W.partitionBy(*receivers(obs), "prn", "t_ms"))).where("rank = _k").select(*receivers(obs), "t_ms", "sys", "prn", "signal", "magnitude")


def slip_counts(slips: DataFrame) -> DataFrame:
    return slips.groupBy(*receivers(slips), "prn").agg(F.count(F.lit(1)).alias("slips"))


def slip_signals(slips: DataFrame, obs: DataFrame) -> DataFrame:
    """Per system and band: slips, epochs with a phase, satellites and slips per thousand epochs."""
    own = receivers(obs)
    p = pairs(obs).where("phase is not null").groupBy(*own, "sys", "band").agg(F.count(F.lit(1)).alias("epochs"), F.count_distinct("prn").alias("satellites"))
    s = slips.select(*own, "sys", F.explode(F.split(F.substring_index("signal", " ", -1), "-")).alias("band")).groupBy(*own, "sys", "band").agg(F.count(F.lit(1)).alias("slips"))
    out = p.join(s, [*own, "sys", "band"], "left").withColumn("slips", F.coalesce("slips", F.lit(0).cast("long")))
    return out.select(*own, "sys", "band", "slips", "epochs", "satellites", (F.col("slips") / F.col("epochs") * 1000).alias("rate"), system_rank(F.col("sys")).alias("place"))


def of_signal(slips: DataFrame, label: str) -> DataFrame:
    """Slips of the signal that a label names before its bracket."""
    return slips.where(F.col("signal").contains(label.split(" (")[0]))


def islands(rows: DataFrame, keys: list[str], joined: Column, order: str = "t_ms") -> DataFrame:
    """rows with segment: a new one wherever joined (over the previous row) isn't true."""
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_j", joined).withColumn("segment", F.sum(F.when(F.coalesce("_j", F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_j")


#: Rules of validation: severity and message by code. Fields that a header lacks are errors each.
RULES = {
    "no_time": ("error", "observation without a time"),
    "duplicate": ("warning", "repeated observation"),
    "bad_satellite": ("warning", "unknown satellite name"),
    "bad_code": ("warning", "unknown observation code"),
    "bad_range": ("warning", "negative pseudorange"),
    "irregular": ("warning", "epoch off the interval"),
    "gap": ("info", "gap in the epochs"),
}
HEADER_FIELDS = ("marker_name", "approx_position", "interval")


def findings(obs: DataFrame, interval_ms: int) -> DataFrame:
    """code, t_ms and example of all that a rule objects to: an observation (a repeated one once), or an epoch by the one before it.

    One aggregate of the observations feeds all rules; epochs meet the one before by pieces of a day.
    """
    cells = obs.groupBy("t_ms", "prn", "code").agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("least"))
    checks = {
        "no_time": F.col("t_ms").isNull(),
        "duplicate": F.col("c") > 1,
        "bad_satellite": ~F.coalesce(F.col("prn").rlike("^[GRECJIS][0-9]{2,3}$"), F.lit(False)),
        "bad_code": ~F.coalesce(F.col("code").rlike("^[CLDS][1-9][A-Z]$"), F.lit(False)),
        "bad_range": F.col("code").startswith("C") & (F.col("least") < 0),  # 0 stands for no value
    }
    broken = F.filter(F.array(*[F.when(check, F.lit(rule)) for rule, check in checks.items()]), lambda x: x.isNotNull())
    text = F.concat_ws(" ", F.coalesce("prn", F.lit("-")), F.coalesce("code", F.lit("-")), F.coalesce(F.col("t_ms").cast("string"), F.lit("-")))
    rows = cells.select(F.explode(broken).alias("code"), "t_ms", text.alias("example"))
    epochs = segments.with_previous(cells.where("t_ms is not null").select("t_ms").distinct(), [], ["t_ms"])
    step = F.col("t_ms") - F.col("_before.t_ms")
    rule = F.when(step > GAP_INTERVALS * interval_ms, "gap").when(step % interval_ms != 0, "irregular")
    off = epochs.select(rule.alias("code"), "t_ms", F.concat(step.cast("string"), F.lit(" ms to "), F.col("t_ms").cast("string")).alias("example")).where("code is not null")
    return rows.unionByName(off)


def warnings(obs: DataFrame, interval_ms: int, header: dict | None = None, most: int = 5) -> DataFrame:
    """code, severity, message, count, first_ms and the first examples of what looks wrong, a row for each rule that objects.

    Examples are the first by time and text, at most so many; Spark drops the others in the tasks that find them.
    """
    found = findings(obs, interval_ms)
    total = found.groupBy("code").agg(F.count(F.lit(1)).alias("count"), F.min("t_ms").alias("first_ms"))
    first = found.withColumn("_n", F.row_number().over(W.partitionBy("code").orderBy("t_ms", "example"))).where(F.col("_n") <= most)
    shown = first.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "example"))), lambda x: x["example"]).alias("examples"))
    pick = lambda k: F.create_map(*[F.lit(x) for rule, text in RULES.items() for x in (rule, text[k])])[F.col("code")]
    out = total.join(shown, "code").select("code", pick(0).alias("severity"), pick(1).alias("message"), "count", "first_ms", "examples")
    missing = [k for k in HEADER_FIELDS if not header.get(k)] if header is not None else []
    if missing:
        rows = [("missing_header", "error", f"header lacks {k}", 1, None, [k]) for k in missing]
        out = out.unionByName(obs.sparkSession.createDataFrame(rows, "code string, severity string, message string, count long, first_ms long, examples array<string>"))
    return out


def severities(found: DataFrame) -> DataFrame:
    """One row: errors, warnings and info, the numbers of objections of each severity."""
    level = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0).cast("long"))
    return found.agg(level("error").alias("errors"), level("warning").alias("warnings"), level("info").alias("info"))
