"""Filters of observations: exclusions, time window, greedy decimation and removal of sparse signals, in that fixed order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanax.operators.greedy import greedy_walk


class AllDataExcluded(ValueError):
    """Nothing is left after filtering."""


@dataclass(frozen=True)
class FilterState:
    systems: tuple[str, ...] = ()
    prns: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()
    signals: dict[str, tuple[str, ...]] = field(default_factory=dict)
    start_ms: int | None = None
    end_ms: int | None = None
    interval_s: float | None = None
    sparse_percent: float = 0.0

    def active(self) -> int:
        """How many filters are on: each excluded item, and each bound, interval or threshold."""
        lists = len(self.systems) + len(self.prns) + len(self.types) + len(self.bands) + sum(map(len, self.signals.values()))
        return lists + (self.start_ms is not None or self.end_ms is not None) + bool(self.interval_s) + (self.sparse_percent > 0)

    def excludes_codes(self) -> bool:
        return bool(self.types or self.bands or any(self.signals.values()))


def satellites_wanted(f: FilterState) -> Column:
    keep = F.lit(True)
    if f.systems:
        keep &= ~F.col("sys").isin(*f.systems)
    if f.prns:
        keep &= ~F.col("prn").isin(*f.prns)
    return keep


def codes_wanted(f: FilterState) -> Column:
    keep = F.lit(True)
    if f.types:
        keep &= ~F.substring("code", 1, 1).isin(*f.types)
    if f.bands:
        keep &= ~F.substring("code", 2, 1).isin(*f.bands)
    for sys, suffixes in f.signals.items():
        if suffixes:
            keep &= ~((F.col("sys") == sys) & F.expr("substring(code, 2)").isin(*suffixes))
    return keep


def in_window(f: FilterState, t: str = "t_ms") -> Column:
    """Both ends belong to the window."""
    keep = F.lit(True)
    if f.start_ms is not None:
        keep &= F.col(t) >= f.start_ms
    if f.end_ms is not None:
        keep &= F.col(t) <= f.end_ms
    return keep


def greedy_epochs(epochs: DataFrame, least_ms: float, slack_ms: float = 1.0, key: str | None = None) -> DataFrame:
    """key and t_ms of the epochs that greedy_walk keeps."""
    return greedy_walk(epochs, least_ms, slack_ms, key).where("t_ms = kept").select("key", "t_ms")


def chunk_starts(epochs: DataFrame, split_ms: float) -> DataFrame:
    """Starts of the files that a split export writes: greedy like greedy_epochs, without slack."""
    return greedy_epochs(epochs, split_ms, 0.0).select("t_ms")


def with_chunks(obs: DataFrame, split_ms: float) -> DataFrame:
    """obs with chunk, the start of its file: each epoch's, joined by its time."""
    walk = greedy_walk(obs.select("t_ms"), split_ms, 0.0).select("t_ms", F.col("kept").alias("chunk"))
    return obs.join(walk, "t_ms").select(*obs.columns, "chunk")


def signal_counts(obs: DataFrame) -> DataFrame:
    return obs.where("value is not null").groupBy("sys", "code").agg(F.count(F.lit(1)).alias("n"))


def _own(obs: DataFrame) -> list[str]:
    return [c for c in ("station", "file") if c in obs.columns][:1]


def _before_codes(obs: DataFrame, f: FilterState) -> DataFrame:
    """obs in the window, decimated; decimation sees the epochs of all satellites, each receiver's by themselves."""
    out = obs.where(in_window(f))
    if f.interval_s:
        own = _own(obs)
        kept = greedy_epochs(out, f.interval_s * 1000, key=own[0] if own else None)
        if own:
            kept = kept.select(F.col("key").alias("_key"), F.col("t_ms").alias("_t"))
            out = out.join(kept, out[own[0]].cast("string").eqNullSafe(F.col("_key")) & (out["t_ms"] == F.col("_t")), "left_semi")
        else:
            out = out.join(kept.select("t_ms"), "t_ms", "left_semi")
    return out.select(obs.columns)


def apply_filters(obs: DataFrame, f: FilterState) -> DataFrame:
    """The observations left. Decimation sees the epochs of all satellites; the sparse threshold sees what is left before it."""
    out = _before_codes(obs, f).where(satellites_wanted(f) & codes_wanted(f))
    if f.sparse_percent > 0:
        epochs = out.select("t_ms").distinct().agg(F.count(F.lit(1)).alias("n_epochs"))
        counts = signal_counts(out).withColumn("n_epochs", epochs.scalar())
        keep = counts.where(F.col("n") >= F.ceil(F.col("n_epochs") * F.lit(f.sparse_percent) / 100)).select("sys", "code")
        out = out.join(F.broadcast(keep), ["sys", "code"], "left_semi").select(obs.columns)
    return out


def satellite_epochs(obs: DataFrame, f: FilterState) -> DataFrame:
    """The receiver's column if there is one, t_ms, sys and prn of the satellites that stay, beside what apply_filters leaves.

    A satellite goes with its time or by its name, and else only if its system has no code left; it stays if all of its own values
    are gone. An epoch stays as long as it has a satellite.
    """
    rows = _before_codes(obs, f).where(satellites_wanted(f)).select(*_own(obs), "t_ms", "sys", "prn").distinct()
    if not (f.excludes_codes() or f.sparse_percent > 0):
        return rows
    return rows.join(apply_filters(obs, f).select("sys").distinct(), "sys", "left_semi").select(rows.columns)


def require_rows(obs: DataFrame) -> DataFrame:
    if obs.isEmpty():
        raise AllDataExcluded("all data excluded by the filters")
    return obs


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any of the columns, in either case."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return rows.where(hit)


def autocomplete(names: DataFrame, typed: str, column: str = "name", order: str = "ord", most: int = 50) -> DataFrame:
    """The first names that contain what was typed, in their own order."""
    return names.where(F.upper(F.col(column)).contains(typed.upper())).orderBy(order).limit(most)


def page(rows: DataFrame, by: str, number: int = 0, size: int = 50, descending: bool = False, *ties: str, collation: str | None = None) -> DataFrame:
    """A page of rows by a column, compared in lower case or by one of Spark's ICU collations.

    UNICODE compares as people sort names: letters first, then accents, then case, small letters before large. Nulls come last of a
    collated column, either way round. Only the rows of the pages up to this one are sorted together.
    """
    if collation:
        key = F.collate(F.col(by).cast("string"), collation)
        order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    else:
        key = F.lower(F.col(by).cast("string"))
        order = key.desc() if descending else key.asc()
    return rows.orderBy(order, *ties).offset(number * size).limit(size)


def above_mask(positions: DataFrame, mask_deg: float = 5.0) -> DataFrame:
    return positions.where(F.col("el") >= F.radians(F.lit(mask_deg)))


def override(header: DataFrame, values: dict[str, object]) -> DataFrame:
    """Header rows with the named fields replaced; an empty string is a value too."""
    return header.withColumns({k: F.lit(v).cast(header.schema[k].dataType) for k, v in values.items()})
