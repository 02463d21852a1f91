"""Arcs, steps and slips over day cuts, receivers and gaps against plain walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanax.model import FREQUENCIES, SPEED_OF_LIGHT
from almanax.operators import quality, segments

GAP = 5 * 30_000
OBS = "station string, t_ms long, sys string, prn string, code string, value double"


def times(rng, n):
    """Epochs over some days with gaps of minutes and days, the first ones just before a midnight, one exactly at it."""
    t, out = 86_400_000 - 4 * 30_000, []
    for _ in range(n):
        out.append(t)
        t += rng.choice([30_000] * 40 + [GAP, GAP + 1, GAP + 30_000, 3_600_000, 86_400_000, 3 * 86_400_000])
    return out


def plain_arcs(rows, broken=frozenset()):
    out, arc, last = {}, 0, None
    for t in sorted(rows):
        arc += (last is not None and t - last > GAP) or t in broken
        out[t], last = arc, t
    return out


def test_arcs_over_days(spark):
    rng = random.Random(1)
    keys = {(s, p): times(rng, 400) for s in ("A", "B", None) for p in ("G01", "G02")}
    marks = {k: set(rng.sample(t, 12)) | {t[0]} for k, t in keys.items()}
    rows = [(s, t, p, t in marks[s, p] or None) for (s, p), ts in keys.items() for t in ts]
    frame = spark.createDataFrame(rows, "station string, t_ms long, prn string, slip boolean")
    for broken in (None, F.col("slip")):
        got = {(r.station, r.prn, r.t_ms): r.arc for r in quality.arcs(frame, ["station", "prn"], 30_000, broken).collect()}
        assert len(got) == len(rows)
        for (s, p), ts in keys.items():
            want = plain_arcs(ts, marks[s, p] if broken is not None else frozenset())
            assert {t: got[s, p, t] for t in ts} == want
    assert quality.arcs(frame.limit(0), ["station", "prn"], 30_000).count() == 0


def test_values_of_the_row_before(spark):
    rng = random.Random(2)
    ts = times(rng, 300)
    frame = spark.createDataFrame([("G01", t, float(i)) for i, t in enumerate(ts)], "prn string, t_ms long, v double")
    got = {r.t_ms: r._before for r in segments.with_previous(frame, ["prn"], ["t_ms", "v"]).collect()}
    assert got[ts[0]] is None and all((got[b].t_ms, got[b].v) == (a, float(i)) for i, (a, b) in enumerate(zip(ts, ts[1:], strict=False)))


def station_rows(rng, n):
    f1, f2 = FREQUENCIES["G"]["1"], FREQUENCIES["G"]["2"]
    w1, w2 = SPEED_OF_LIGHT / f1, SPEED_OF_LIGHT / f2
    rows, walks = [], {}
    for s in ("A", None):
        for p in ("G01", "G07"):
            ambiguity, walk = [1e6, 2e6], []
            for i, t in enumerate(times(rng, n)):
                if rng.random() < 0.02:
                    ambiguity[rng.randrange(2)] += rng.choice([1, 5, 200, -40])
                reach = 2e7 + i * 10.0
                c1, c2 = reach + rng.random(), reach + rng.random()
                l1, l2 = reach / w1 + ambiguity[0], reach / w2 + ambiguity[1]
                rows += [(s, t, "G", p, "C1C", c1), (s, t, "G", p, "L1C", l1), (s, t, "G", p, "C2W", c2), (s, t, "G", p, "L2W", l2)]
                walk.append((t, c1, l1, c2, l2))
            walks[s, p] = walk
    return rows, walks, (f1, f2, w1, w2)


def test_slips_and_multipath_over_days(spark):
    rows, walks, (f1, f2, w1, w2) = station_rows(random.Random(3), 500)
    obs = spark.createDataFrame(rows, OBS).repartition(7)
    sf = {(r.station, r.prn, r.t_ms, r.signal): r.magnitude for r in quality.phase_jumps(obs, 30_000).collect()}
    gf = {(r.station, r.prn, r.t_ms): r.magnitude for r in quality.geometry_free_jumps(obs, 30_000).collect()}
    mw = {(r.station, r.prn, r.t_ms): r.magnitude for r in quality.wide_lane_jumps(obs, 30_000).collect()}
    mp = {(r.station, r.prn, r.band, r.t_ms): r.mp for r in quality.multipath(obs, 30_000).collect()}
    want_sf, want_gf, want_mw, want_mp = {}, {}, {}, {}
    for (s, p), walk in walks.items():
        arc = plain_arcs([w[0] for w in walk])
        last, n, mean, spread, step, raw = None, 0, 0.0, 0.0, 0.0, {}
        for w in walk:
            t, c1, l1, c2, l2 = w
            new = last is None or arc[t] != arc[last[0]]
            if not new:
                for band, d in (("1", (l1 * w1 - c1) - (last[2] * w1 - last[1])), ("2", (l2 * w2 - c2) - (last[4] * w2 - last[3]))):
                    if abs(d) > 3:
                        want_sf[s, p, t, f"SF {band}"] = abs(d)
                now = (l1 * w1 - l2 * w2) - (last[2] * w1 - last[4] * w2)
                if abs(now - step) > 0.15 and not abs(step) > 0.15:
                    want_gf[s, p, t] = abs(now - step)
                step = now
            else:
                step, n = 0.0, 0
            x = l1 - l2 - (f1 * c1 + f2 * c2) / (f1 + f2) * (f1 - f2) / SPEED_OF_LIGHT
            if n >= 2 and abs(x - mean) > max(4 * np.sqrt(spread), 1):
                want_mw[s, p, t], n = abs(x - mean), 0
            n += 1
            mean, spread = (x, 0.25) if n == 1 else (mean + (x - mean) / n, spread + ((x - mean) ** 2 - spread) / n)
            for band, i, j, a in (("1", l1 * w1, l2 * w2, (f1 / f2) ** 2), ("2", l2 * w2, l1 * w1, (f2 / f1) ** 2)):
                raw.setdefault((band, arc[t]), []).append((t, ((c1 if band == "1" else c2) - i) - 2 / (a - 1) * (i - j)))
            last = w
        for (band, _), points in raw.items():
            if len(points) >= 10:
                want_mp |= {(s, p, band, t): v - np.mean([v for _, v in points]) for t, v in points}
    assert len(want_sf) > 5 and len(want_gf) > 20 and len(want_mw) > 5
    assert sf == pytest.approx(want_sf, abs=1e-6) and gf == pytest.approx(want_gf, abs=1e-6) and mw == pytest.approx(want_mw, abs=1e-6) and mp == pytest.approx(want_mp, abs=1e-6)
    marked = quality.multipath(obs, 30_000, quality.phase_jumps(obs, 30_000), 1)
    assert marked.count() == 2 * sum(map(len, walks.values())) and marked.select("station", "prn", "band", "arc").distinct().count() > len(walks) * 2


def test_wide_lane_by_blocks():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 50, 5000):
        mw = rng.normal(1e6, 0.2, n) + np.cumsum(rng.random(n) < 0.01) * 3
        want, m, mean, spread = [], 0, 0.0, 0.0
        for k, x in enumerate(mw):
            if m >= 2 and abs(x - mean) > max(4 * np.sqrt(spread), 1):
                want.append(k)
                m = 0
            m += 1
            mean, spread = (x, 0.25) if m == 1 else (mean + (x - mean) / m, spread + ((x - mean) ** 2 - spread) / m)
        assert quality.wide_lane_slips(mw, 8)[0] == want == quality.wide_lane_slips(mw)[0]



def test_rules_and_their_examples(spark):
    t = 86_400_000 - 60_000
    rows = [("A", t, "G", "G01", "C1C", 1.0), ("A", t, "G", "G01", "C1C", 2.0), ("A", t + 30_000, "G", "G01", "C1C", -1.0), ("A", t + 60_000, "G", "G1", "C1C", 1.0), ("A", t + 67_000, "G", "G01", "XX", 1.0), ("A", t + 900_000, "G", "G01", "C1C", 0.0), ("A", None, "G", None, None, None)]
    rows += [("A", t + 900_000 + 30_000 * k, "G", "G02", "Z1C", 1.0) for k in range(20)]
    found = quality.warnings(spark.createDataFrame(rows, OBS), 30_000, {"marker_name": "x"}, 2)
    got = {(r.code, r.message if r.code == "missing_header" else ""): r for r in found.collect()}
    counts = {k[0]: r["count"] for k, r in got.items() if k[0] != "missing_header"}
    assert counts == {"duplicate": 1, "bad_range": 1, "bad_satellite": 2, "bad_code": 22, "irregular": 1, "gap": 1, "no_time": 1}
    assert got["bad_code", ""].examples == ["- - -", f"G01 XX {t + 67_000}"] and got["gap", ""].examples == [f"833000 ms to {t + 900_000}"] and got["irregular", ""].first_ms == t + 67_000
    assert sum(k[0] == "missing_header" for k in got) == 2
    assert quality.severities(found).first().asDict() == {"errors": 3, "warnings": 27, "info": 1}
    assert quality.warnings(spark.createDataFrame([], OBS), 30_000).count() == 0
