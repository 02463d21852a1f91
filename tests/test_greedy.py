"""The parallel greedy walk against the walk itself."""

import random

import pytest

from almanax.operators import filters, greedy


def plain(rows, step):
    out, last = [], {}
    for key, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if key not in last or t - last[key] >= step:
            last[key] = t
        out.append((key, t, last[key]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 700, 30_000, 3_600_000, 5 * 3_600_000, 100 * 3_600_000, 9000 * 3_600_000])
def test_walks_of_many_stretches(spark, least):
    """Regular and irregular epochs, gaps of hours and years, times before 1970, and a key that is null."""
    rng = random.Random(least)
    rows = []
    for key in ("a", "b", None):
        t = rng.choice([-10_000_000_000, 1_700_000_000_123])
        for _ in range(1500):
            t += rng.choice([1, 999, 1000, 1000, 29_999, 30_000, 30_001, 1_800_000, rng.randrange(1, 8_000_000)])
            if rng.random() < 0.003:
                t += rng.choice([40 * 86_400_000, 20 * 365 * 86_400_000])
            rows.append((key, t))
    rows += rows[:20]
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows] + [("a", None, 1)], "station string, t_ms long, kept int")
    got = greedy.greedy_walk(frame, least, 1.0, "station").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, max(least - 1, 1))


def test_walks_of_few_epochs(spark):
    frame = spark.createDataFrame([(0,), (29_999,), (59_998,), (60_500,)], "t_ms long")
    assert sorted(r.t_ms for r in filters.greedy_epochs(frame, 30_000).collect()) == [0, 29_999, 59_998]
    assert sorted(r.t_ms for r in filters.chunk_starts(frame, 30_000).collect()) == [0, 59_998]
    assert greedy.greedy_walk(frame.limit(0), 1000).count() == 0


def test_walk_has_no_single_partition(spark):
    frame = spark.createDataFrame([(k * 1000,) for k in range(20_000)], "t_ms long")
    walk = greedy.greedy_walk(frame, 30_000)
    plan = walk._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and walk.where("t_ms = kept").count() == 667
