"""Queries without SQL against brute force, on small tables of their own."""

import math

from almanax.functions import orbit
from almanax.plans import orbits


def carried(state, dt):
    """Runge-Kutta steps of at most a minute in plain Python; metres."""

    def motion(s):
        x, y, z, vx, vy, vz = s
        r2 = x * x + y * y + z * z
        g, k, f = orbit.PZ_MU / r2**1.5, 1.5 * orbit.PZ_J2 * orbit.PZ_A**2 / r2, 5 * z * z / r2
        w = orbit.PZ_OMEGA
        return [vx, vy, vz, -g * x * (1 + k * (1 - f)) + w * w * x + 2 * w * vy, -g * y * (1 + k * (1 - f)) + w * w * y - 2 * w * vx, -g * z * (1 + k * (3 - f))]

    s = list(state)
    while dt:
        h = max(-60.0, min(60.0, dt))
        step = lambda k, c: [a + c * b for a, b in zip(s, k, strict=True)]  # noqa: B023, E731
        k1 = motion(s)
        k2 = motion(step(k1, h / 2))
        k3 = motion(step(k2, h / 2))
        k4 = motion(step(k3, h))
        s = [a + h / 6 * (p + 2 * q + 2 * r + t) for a, p, q, r, t in zip(s, k1, k2, k3, k4, strict=True)]
        dt -= h
    return [v * 1000 for v in s[:3]]


def test_glonass_positions_of_all_suppliers_and_times(spark, tmp_path):
    # two half-hours of the day in full, a third in part, one far off, one that shares a half-hour with the first, and no key
    keys = [*range(1, 61), 24 * 20 + 7, 24 * 48 + 1, None]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {(r.t_ms, r.prn): (r.x, r.y, r.z) for r in orbits.glonass_positions(spark, str(tmp_path)).collect()}
    speed = math.sqrt(orbit.PZ_MU / 25_500)
    want = {}
    for t in range(orbits.START, orbits.START + 96 * 900_000, 900_000):
        for slot in range(24):
            near = []
            for k in keys:
                if k and (k - 1) % 24 == slot:
                    half = (k - 1) // 24
                    toc = orbits.START + 900_000 + half % 48 * 1_800_000 + half // 48 * 1000
                    if abs(t - toc) <= 1_800_000:
                        near.append((abs(t - toc), k, toc))
            if near:
                _, k, toc = min(near)
                c, s = math.cos(k * 0.26), math.sin(k * 0.26)
                state = (25_500 * c, 25_500 * s * 0.43, 25_500 * s * 0.9, -speed * s, speed * c * 0.43, speed * c * 0.9)
                want[t, f"R{slot + 1:02d}"] = carried(state, (t - toc) / 1000 - 18)
    assert got.keys() == want.keys() and len({t for t, _ in got}) > 6
    assert all(math.dist(got[at], want[at]) < 0.05 for at in want)
