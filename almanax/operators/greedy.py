"""The greedy walk over epochs, in parallel: keep the first, and then each that is an interval after the last one kept.

The choice depends on order, but what a stretch of time does to the walk is a function of one number: the earliest time that may be
kept next. Each hour's function is a short table of steps; functions of hours are composed to those of 64 hours, and so on, and the
numbers go back down the same tree. An hour then walks by itself. So a key's epochs are never in one task: an hour holds at most
3,600,000 distinct milliseconds, and a stretch's table the epochs of its first interval.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanax.session import save_table

HOUR_MS, FAN, LEVELS = 3_600_000, 64, 3
_FIRST = -(1 << 62)
_STEPS = pa.schema([("key", pa.string()), ("b", pa.int64()), ("breaks", pa.list_(pa.int64())), ("outs", pa.list_(pa.int64()))])
_STARTS = pa.schema([("key", pa.string()), ("b", pa.int64()), ("earliest", pa.int64())])


def _values(cell: pa.Scalar) -> np.ndarray:
    return np.asarray(cell.values)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _next(times: np.ndarray, step: int) -> np.ndarray:
    """Index of each epoch's successor in the walk; len(times) if there is none."""
    return np.searchsorted(times, times + step)


def _hour_steps(step: int):
    """The function of an hour: earliest times up to a break, but beyond the one before it, lead to its out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, b, cell in zip(batch.column("key").to_pylist(), batch.column("b").to_pylist(), batch.column("times"), strict=True):
                times = _values(cell)
                last, follow = np.arange(len(times)), np.append(_next(times, step), len(times))
                follow = np.where(follow < len(times), follow, np.arange(len(times) + 1))
                last = follow[:-1]
                while ((more := last[last]) != last).any():
                    last = more
                n = np.searchsorted(times, b * HOUR_MS + step) + 1  # what may come in is at most an interval after the start
                yield _table([(key, b, times[:n], times[last[:n]] + step)], _STEPS)

    return run


def _through(breaks: np.ndarray, outs: np.ndarray, earliest: np.ndarray) -> np.ndarray:
    at = np.searchsorted(breaks, earliest)
    return np.where(at < len(breaks), outs[np.minimum(at, len(outs) - 1)], earliest)


def _groups(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(key, parent, extra values, [(b, breaks, outs)]) of rows that come sorted by key, parent and b."""
    at, extra, rows = None, (), []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "parent", *more, "b")]
        for k, (key, parent, *rest, b) in enumerate(zip(*columns, strict=True)):
            if (key, parent) != at:
                if rows:
                    yield (*at, extra, rows)
                at, extra, rows = (key, parent), rest, []
            rows.append((b, _values(batch.column("breaks")[k]), _values(batch.column("outs")[k])))
    if rows:
        yield (*at, extra, rows)


def _composed(step: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parent, _, rows in _groups(batches):
            breaks = np.concatenate([r[1] for r in rows])
            breaks = breaks[: np.searchsorted(breaks, parent * width + step) + 1]
            outs = breaks
            for _, inner, inner_outs in rows:
                outs = _through(inner, inner_outs, outs)
            yield _table([(key, parent, breaks, outs)], _STEPS)

    return run


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, _, (earliest,), rows in _groups(batches, ("earliest",)):
        x, out = np.array([earliest]), []
        for b, breaks, outs in rows:
            out.append((key, b, int(x[0])))
            x = _through(breaks, outs, x)
        yield _table(out, _STARTS)


def _walked(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, earliest, cell in zip(batch.column("key").to_pylist(), batch.column("earliest").to_pylist(), batch.column("times"), strict=True):
                times = _values(cell)
                follow, kept, k = _next(times, step), np.full(len(times), earliest - step), int(np.searchsorted(times, earliest))
                while k < len(times):
                    kept[k : follow[k]] = times[k]
                    k = int(follow[k])
                for a in range(0, len(times), 100_000):
                    some = times[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.string()), pa.array(some), pa.array(kept[a : a + 100_000])], names=["key", "t_ms", "kept"])

    return run


def greedy_walk(epochs: DataFrame, least_ms: float, slack_ms: float = 1.0, key: str | None = None) -> DataFrame:
    """key, t_ms and kept of distinct epochs: kept is the epoch itself or the last one before it that is kept.

    The first of a key is kept, and then each that is least_ms (less the slack) after the last one kept. Keys (a file's, a stream's)
    are strings; null is a key of its own. Null times are left out. All are kept if the interval is no more than the slack.
    """
    step = max(1, math.ceil(least_ms - slack_ms))
    rows = epochs.where("t_ms is not null").select((F.col(key) if key else F.lit("")).cast("string").alias("key"), F.col("t_ms").cast("long").alias("t_ms")).distinct()
    hours = rows.groupBy("key", F.floor(F.col("t_ms") / HOUR_MS).alias("b")).agg(F.sort_array(F.collect_list("t_ms")).alias("times"))
    hours = save_table(hours, "hours")
    steps, starts = "key string, b long, breaks array<long>, outs array<long>", "key string, b long, earliest long"
    levels = [save_table(hours.mapInArrow(_hour_steps(step), steps), "steps")]

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("key", "parent").sortWithinPartitions("key", "parent", "b")

    above = lambda df: df.withColumn("parent", F.floor(F.col("b") / FAN))
    for level in range(1, LEVELS + 1):
        levels.append(save_table(dealt(above(levels[-1])).mapInArrow(_composed(step, HOUR_MS * FAN**level), steps), "steps"))
    # the top has a row for each thirty years of a key
    top = dealt(levels.pop().withColumns({"parent": F.lit(0).cast("long"), "earliest": F.lit(_FIRST)}))
    found = top.mapInArrow(_handed_down, starts)
    for level in reversed(levels):
        up = found.select(F.col("key").alias("_key"), F.col("b").alias("_b"), "earliest")
        rows = above(level)
        both = rows.join(up, rows["key"].eqNullSafe(up["_key"]) & (rows["parent"] == up["_b"])).drop("_key", "_b")
        found = dealt(both).mapInArrow(_handed_down, starts)
    up = found.select(F.col("key").alias("_key"), F.col("b").alias("_b"), "earliest")
    both = hours.join(up, hours["key"].eqNullSafe(up["_key"]) & (hours["b"] == up["_b"])).drop("_key", "_b")
    return both.mapInArrow(_walked(step), "key string, t_ms long, kept long")
