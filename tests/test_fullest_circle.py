"""The fullest circle against a plain sweep, and what its plan moves."""

import math
import random

import pytest

from geoloom.operators import poi

R = 6370996.81


def brute(points, metres):
    """latitude, longitude, total of the best circle: all pairs, one event after another."""
    best = None
    for i, y, x in sorted(points):
        events = []
        for j, v, u in points:
            p, q = math.radians(y), math.radians(v)
            d = R * math.acos(max(-1, min(1, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(math.radians(x - u)))))
            if i != j and d <= 2 * metres:
                phi, back, ahead = math.acos(min(1, d / (2 * metres))), math.atan2(x - u, y - v), math.atan2(u - x, v - y)
                events += [(back - phi, -1, j, ahead - phi), (back + phi, 1, j, ahead + phi)]
        total = 1
        for _, turn, _, toward in sorted(events):
            total -= turn
            if total > 1 and (best is None or total > best[2]):
                best = (y + math.degrees(metres / R) * math.cos(toward), x + math.degrees(metres / R) * math.sin(toward), total)
    return best


@pytest.mark.parametrize("part", [3, 1024])
@pytest.mark.parametrize(("middle", "spread", "metres"), [((31.2, 121.4), 0.2, 5_000), ((0.0, 180.0), 0.2, 5_000), ((89.0, 0.0), 0.9, 30_000), ((10.0, 10.0), 60, 6_000_000)])
def test_sweep_is_brute_force(spark, monkeypatch, part, middle, spread, metres):
    monkeypatch.setattr(poi, "PART", part)
    rng = random.Random(9)
    points = [(k, middle[0] + rng.uniform(-spread, spread), (middle[1] + rng.uniform(-spread, spread) + 180) % 360 - 180) for k in range(90)]
    # The same place twice.
    points += [(100 + k, *p[1:]) for k, p in enumerate(points[:5])]
    got = poi._sweep(spark.createDataFrame(points, "id bigint, lat double, lon double"), metres).first()
    want = brute(points, metres)
    assert got.total == want[2] and (got.latitude, got.longitude) == pytest.approx(want[:2], abs=1e-9)


def test_only_points_travel(spark):
    """1,200 points in one another's reach are 2.9 million events, which stay where they are made."""
    rng = random.Random(4)
    points = spark.createDataFrame([(k, 31 + rng.random() / 100, 121 + rng.random() / 100) for k in range(1200)], "id bigint, lat double, lon double")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    assert poi._sweep(points, 5_000).first().total == 1200
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < 2_000_000
